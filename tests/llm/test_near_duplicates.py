"""Near-duplicates against all pairs in plain Python."""

import random
import re

import numpy as np
import pytest

from casebrook.llm import near_duplicates as nd
from casebrook.llm import queries
from casebrook.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_set(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if len(words) < 4:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 4]) for i in range(len(words) - 3)}


def expected(rows):
    """Ids must be unique. Pairs are found by shared shingles, then judged."""
    sets = {k: plain_set(t) for k, t in rows}
    by_shingle = {}
    for k, s in sets.items():
        for x in s:
            by_shingle.setdefault(x, []).append(k)
    up = {k: k for k in sets}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    shared = {}
    for keys in by_shingle.values():
        for i, a in enumerate(keys):
            for b in keys[i + 1 :]:
                shared[a, b] = shared.get((a, b), 0) + 1
    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return sorted((k, len(sets[k]), top(k), top(k) == k) for k in sets)


def found(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


def test_near_duplicates(spark, folder, texts):
    assert found(queries.op3_near_duplicates(spark, folder)) == expected(list(texts.items()))


def test_odd_rows(odd, nothing):
    source = [(r.doc_id, r.text) for r in odd.collect()]
    rows = nd.near_duplicates(odd).collect()
    assert len(rows) == len(source)
    unique = dict(reversed([(k, t) for k, t in source if k is not None]))
    want = {k: (n, c) for k, n, c, _ in expected(list(unique.items()))}
    near_null = {r.doc_id for r in rows if r.component_id is None}
    for r in rows:
        if r.doc_id is not None:
            assert r.n_shingles == want[r.doc_id][0]
            assert r.doc_id in near_null or r.component_id == want[r.doc_id][1]
    assert near_null == {5, 6, 7, 8, None}  # the row without an id is like row 8
    assert nd.near_duplicates(nothing).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_groups_of_edits(spark, seed, monkeypatch):
    monkeypatch.setattr(nd, "TILE", 4)
    rng = random.Random(seed)
    rows = []
    passage = [f"p{i}" for i in range(60)]
    for group in range(6):
        base = [f"{group}w{rng.randint(0, 400)}" for _ in range(rng.choice([3, 6, 12, 60, 200]))]
        for _ in range(rng.randint(1, 25)):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                words[rng.randrange(len(words))] = f"e{rng.randint(0, 10**6)}"
            rows.append(" ".join(words if rng.random() < 0.7 else words + passage))
    rows = list(enumerate(rows))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(nd.near_duplicates(df)) == expected(rows)


def expected_of_shared_ids(rows):
    """Rows that share an id are one document with the links of all."""
    each = expected(list(enumerate(t for _, t in rows)))
    part = {row: top for row, _, top, _ in each}
    up = {}
    top = lambda k: k if up.get(k, k) == k else top(up[k])
    by_part = {}
    for row, (k, t) in enumerate(rows):
        if plain_set(t):
            by_part.setdefault(part[row], []).append(k)
    for keys in by_part.values():
        for k in keys:
            x, y = sorted((top(keys[0]), top(k)))
            up[y] = x
    return sorted((k, len(plain_set(t)), top(k) if plain_set(t) else k) for k, t in rows)


def base(name, n=60):
    return " ".join(f"{name}{i}" for i in range(n))


@pytest.mark.parametrize(
    "rows",
    [
        [(1, base("a")), (5, base("a")), (5, base("b")), (7, base("b"))],
        [(5, base("a")), (5, base("b")), (7, base("a") + " x"), (8, base("b") + " y")],
        [(5, base("a")), (5, base("b")), (5, base("a")), (9, base("b")), (2, base("c")), (2, "")],
        [(4, base("a")), (4, base("a") + " z"), (3, base("c")), (6, base("c") + " q"), (6, base("a", 55))],
    ],
)
def test_rows_that_share_an_id(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in nd.near_duplicates(df).collect())
    assert got == expected_of_shared_ids(rows)


def edits(n, seed, changes):
    """One text with so many words changed, each time others."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(n):
        own = list(words)
        for at in rng.sample(range(120), changes):
            own[at] = f"e{rng.randint(0, 10**9)}"
        rows.append((k, " ".join(own)))
    return rows


def test_pairs_grow_with_members(spark, monkeypatch):
    """Pairs that leave a tile are fewer than its members, at any size of a group."""
    written, seen = nd.written, {}

    def noted(df, name):
        out = written(df, name)
        seen.setdefault(name, []).append(out[0].count())
        return out

    monkeypatch.setattr(nd, "written", noted)
    for n in (100, 200, 400):
        rows = edits(n, n, 4)
        seen.clear()
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert found(nd.near_duplicates(df)) == expected(rows)
        assert all(x < n for x in seen["candidates"][1:])


@pytest.mark.parametrize("shift", [32, 61])
def test_shortened_hashes_that_meet_by_chance(spark, monkeypatch, shift):
    monkeypatch.setattr(nd, "FIRST_SHIFT", shift)  # 61: three bits, nearly all are equal
    monkeypatch.setattr(nd, "TILE", 16)
    rows = edits(40, 3, 3) + [(100 + k, t) for k, t in edits(30, 4, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(nd.near_duplicates(df)) == expected(rows)


def test_estimate_is_unbiased():
    rng = np.random.default_rng(0)
    for size, shared in ((400, 320), (3000, 2000), (40, 36)):
        got = []
        for _ in range(60):
            pool = rng.integers(0, 1 << 63, 2 * size - shared, dtype=np.uint64) * np.uint64(2)
            a, b = np.sort(pool[:size]), np.sort(pool[size - shared :])
            one, two = nd.sketch(a), nd.sketch(b)
            used = ((one > 0) | (two > 0)).sum()
            bound = nd.estimate(one, two, float(size), float(size))
            got.append(bound - nd.SIGMAS * np.sqrt(0.16 / used))
        assert abs(np.mean(got) - shared / (2 * size - shared)) < 0.02


@pytest.mark.parametrize("links", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(9, 1), (9, 2), (5, 9), (7, 8)]])
def test_components(spark, links):
    df = spark.createDataFrame(links, "a long, b long")
    up = {x: x for pair in links for x in pair}
    for _ in up:
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    assert {r.id: r.label for r in components(df).collect()} == up
