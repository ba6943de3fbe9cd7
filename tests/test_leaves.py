"""Top-k of a tile: exact for any vectors, with few pairs compared."""

import numpy as np
import pytest

from casebrook.operators import leaves as lv


def rows_of(seed, n=900, dim=9, lengths=False):
    """Clumped vectors; some are equal, some zero, one key holds a third."""
    rng = np.random.default_rng(seed)
    vectors = rng.normal(size=(7, dim))[rng.integers(0, 7, n)] + 0.2 * rng.normal(size=(n, dim))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    if lengths:
        vectors *= np.exp2(rng.integers(-10, 11, n))[:, None]
    vectors[100:160] = vectors[5]
    vectors[200:230] = 0
    chunk = rng.permutation(n) * 3
    code = np.where(rng.random(n) < 0.34, 0, rng.integers(-1, 40, n))
    return vectors.astype(np.float32), chunk, code


def brute(vectors, chunk, code, query, own, k, one_per_key):
    scores = np.round(vectors.astype(np.float64) @ query, 6) + 0.0
    seen, out = set(), []
    for j in np.lexsort((chunk, -scores)):
        if code[j] == own or (one_per_key and code[j] in seen):
            continue
        seen.add(code[j])
        out.append((int(chunk[j]), scores[j]))
        if len(out) == k:
            break
    return out


@pytest.mark.parametrize("one_per_key", [False, True])
@pytest.mark.parametrize("lengths", [False, True])
@pytest.mark.parametrize("axes", [3, 12])
def test_equal_to_brute_force(monkeypatch, one_per_key, lengths, axes):
    for name, value in (("LEAF", 16), ("GROUP", 3), ("BLOCK", 70), ("AXES", axes), ("_PENDING", 300), ("_PRODUCTS", 500)):
        monkeypatch.setattr(lv, name, value)
    vectors, chunk, code = rows_of(3, lengths=lengths)
    own = np.where(np.arange(len(code)) % 4, code, -2)
    for telling in (1, 1 << 30):  # by components alone, and by whole vectors
        monkeypatch.setattr(lv, "_TELLING", telling)
        tile = lv.Leaves(vectors, chunk, code, 6, one_per_key)
        query, score, row, bars = tile.best(vectors.astype(np.float64), own, np.full(len(code), -np.inf), 6)
        for q in range(0, len(code), 3):
            mine = np.flatnonzero(query == q)
            got = sorted(((int(chunk[tile.rows[row[i]]]), score[i]) for i in mine), key=lambda x: (-x[1], x[0]))
            wanted = brute(vectors, chunk, code, vectors[q].astype(np.float64), own[q], 6, one_per_key)
            assert [g[0] for g in got] == [w[0] for w in wanted]
            assert bars[q] == wanted[-1][1]


def test_bars_from_elsewhere_leave_out_what_is_below():
    vectors, chunk, code = rows_of(4)
    tile = lv.Leaves(vectors, chunk, code, 5, False)
    none = np.full(len(code), -2)
    _, _, _, bars = tile.best(vectors.astype(np.float64), none, np.full(len(code), -np.inf), 6)
    query, score, _, _ = tile.best(vectors.astype(np.float64), none, bars, 6)
    assert (np.bincount(query, minlength=len(code)) == 5).all()
    assert (score >= bars[query]).all()


def test_few_pairs_are_compared(monkeypatch):
    rng = np.random.default_rng(5)
    near = rng.normal(size=(60, 16))[rng.integers(0, 60, 20_000)]
    vectors = (near + 0.02 * rng.normal(size=near.shape)).astype(np.float32)
    pairs, compare = [], lv._Block._compare

    def counted(self, leaf, rows):
        pairs.append(len(rows) * int(self.leaves.ends[leaf] - self.leaves.starts[leaf]))
        compare(self, leaf, rows)

    monkeypatch.setattr(lv._Block, "_compare", counted)
    code = np.arange(len(vectors))
    tile = lv.Leaves(vectors, code, code, 4, True)
    query, _, _, _ = tile.best(vectors[:2000].astype(np.float64), code[:2000], np.full(2000, -np.inf), 6)
    assert (np.bincount(query) == 4).all()
    assert sum(pairs) < 0.2 * 2000 * len(vectors)


@pytest.mark.parametrize("one_per_key", [False, True])
def test_equal_vectors_are_not_met_one_by_one(one_per_key):
    vectors = np.ones((5000, 4), dtype=np.float32)
    chunk, code = np.arange(5000)[::-1].copy(), np.arange(5000) // 100
    tile = lv.Leaves(vectors, chunk, code, 3, one_per_key)
    assert len(tile.rows) <= 2 * 3
    query, score, row, _ = tile.best(np.ones((50, 4)), np.arange(50), np.full(50, -np.inf), 6)
    for q in range(50):
        got = sorted(chunk[tile.rows[row[query == q]]].tolist())
        assert got == [w[0] for w in brute(vectors, chunk, code, np.ones(4), q, 3, one_per_key)]


def test_vectors_that_are_not_finite_are_never_found():
    vectors = np.array([[1, 0], [np.nan, 1], [0, np.inf], [0, 1]], dtype=np.float32)
    tile = lv.Leaves(vectors, np.arange(4), np.arange(4), 4, False)
    none = np.full(4, -2)
    query, _, row, _ = tile.best(vectors.astype(np.float64), none, np.full(4, -np.inf), 6)
    assert set(zip(query.tolist(), tile.rows[row].tolist())) == {(0, 0), (0, 3), (3, 0), (3, 3)}
    gone = lv.Leaves(vectors[1:3], np.arange(2), np.arange(2), 4, False)
    assert not len(gone.best(vectors.astype(np.float64), none, np.full(4, -np.inf), 6)[0])
