"""Vector codebooks and collocations against plain Python and SQL."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from casebrook.llm import codebooks as cb
from casebrook.llm import oracles, phrases, queries
from casebrook.llm.oracles_vectors_phrases import collocations_sql

# ------------------------------------------------------------------ vectors


@pytest.mark.parametrize("width,reach,size", [(16, 300, 256), (2, 6, 256), (1, 3, 40), (3, 2, 1), (4, 0, 9)])
def test_orchard_finds_the_nearest(width, reach, size):
    rng = np.random.default_rng(width)
    entries = rng.integers(-reach, reach + 1, (size, width))
    points = rng.integers(-2 * reach - 1, 2 * reach + 2, (3000, width))
    found, near = cb.Orchard(entries).nearest(points)
    apart = ((points[:, None, :] - entries[None]) ** 2).sum(-1)
    assert (found == apart.argmin(1)).all() and (near == apart.min(1)).all()
    exact, far = cb.Orchard(entries.astype(object)).nearest(points[:300].astype(object))
    assert (exact == found[:300]).all() and list(far) == list(near[:300])


def plain_codes(rows):
    """``rows``: (vec_id, vector, label)."""
    kept = [
        (i, [math.floor(1024 * float(x)) for x in v], label)
        for i, v, label in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    step = len(kept[0][1]) // 4
    cut = lambda v, p: v[p * step : (p + 1) * step]
    books = [[cut(v, p) for _, v, _ in kept[:256]] for p in range(4)]
    for turn in range(5):
        best = [
            [
                min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e)), k) for k, e in enumerate(books[p]))
                for p in range(4)
            ]
            for _, v, _ in kept
        ]
        if turn == 4:
            break
        for p in range(4):
            for k in range(len(books[p])):
                own = [cut(v, p) for (_, v, _), b in zip(kept, best) if b[p][1] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(d for d, _ in b) for b in best]
    sums = Counter()
    for (_, _, label), e in zip(kept, errors):
        sums[label] += e
    return sorted(
        (str(i), "".join(f"{k:02x}" for _, k in b), e, sums[label], digest)
        for (i, _, label), b, e in zip(kept, best, errors)
    )


def found_codes(df):
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


VECTORS = "vec_id long, embedding array<float>, label int, code string, v string, l string, error string, salt int"


def test_odd_vectors(spark):
    rng = random.Random(3)
    rows = [
        (i, [float(np.float32(rng.gauss(i % 5, 1))) for _ in range(8)], [None, 1, 2][i % 3]) for i in range(700)
    ]
    rows += [(800, None, 1), (801, [None] * 8, 1), (802, [math.nan] + [0.0] * 7, 1), (803, [math.inf] * 8, 2)]
    rows += [rows[0], rows[0], rows[3], (None, rows[4][1], None), (5, rows[6][1], 9), (900, [-0.0] * 8, None)]
    rows += [(901, [300000.0] * 8, 1), (-7, [-(2.0**40)] * 4 + [2.0**40] * 4, 2)]
    df = spark.createDataFrame([r + ("c", "v", "l", "e", 1) for r in rows], VECTORS).repartition(5)
    expected = plain_codes(rows)
    clipped = [(i, c, e if e < 1 << 63 else None, None, d) for i, c, e, _, d in expected]
    got = found_codes(cb.compressed(df))
    assert [(i, c, e, None, d) for i, c, e, _, d in got] == clipped
    small = [r for r in rows if r[1] is None or all(x is None or not abs(x) >= 1e6 for x in r[1])]
    df = spark.createDataFrame([r + ("c", "v", "l", "e", 1) for r in small], VECTORS).repartition(5)
    assert found_codes(cb.compressed(df)) == plain_codes(small)


def test_no_vectors_and_few(spark, monkeypatch):
    none = spark.createDataFrame([(1, None, 1, "c", "v", "l", "e", 1)], VECTORS)
    assert cb.compressed(none).collect() == [] and cb.compressed(none.limit(0)).collect() == []
    rows = [(i, [float(i * k) for k in range(4)], 1) for i in range(6)]
    df = spark.createDataFrame([r + ("c", "v", "l", "e", 1) for r in rows], VECTORS)
    assert found_codes(cb.compressed(df)) == plain_codes(rows)
    monkeypatch.setattr(cb, "fits_broadcast", lambda _: False)
    assert found_codes(cb.compressed(df)) == plain_codes(rows)
    with pytest.raises(ValueError):
        cb.compressed(spark.createDataFrame([(1, [1.0, 2.0], 1, "c", "v", "l", "e", 1)], VECTORS))


def test_codes_decode_to_their_entries(spark, folder):
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows, books, width = cb.trained(vectors)
    back = cb.decoded(cb.coded(rows, books, width), books).join(rows.select("vec_id", "v"), "vec_id").collect()
    assert len(back) == vectors.count()
    for r in back:
        assert round(sum((round(1024 * a) - b) ** 2 for a, b in zip(r.vector, r.v))) == r.error


def test_vector_codes_and_sql(spark, folder):
    got = found_codes(queries.op11_vector_codes(spark, folder))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    sql = con.execute(f"SELECT vec_id, code, error, label_error, codebooks_sha256 FROM ({oracles.ORACLES['op11_vector_codes']})")
    assert got == sorted((str(r[0]), *r[1:]) for r in sql.fetchall())


# ------------------------------------------------------------------ phrases


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def plain_pieces(rows):
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lowered(text or "")):
            yield "und" if lang is None else lang, re.findall(r"[^\x20\x09]+", piece)


def plain_collocations(rows, min_count, top):
    counts, totals = Counter(), Counter()
    for lang, words in plain_pieces(rows):
        totals[lang] += len(words)
        for i in range(len(words)):
            for k in range(1, min(5, len(words) - i) + 1):
                counts[lang, tuple(words[i : i + k])] += 1
    often = {p: c for p, c in counts.items() if c >= min_count and len(p[1]) > 1}
    held = set()
    for (lang, p), c in often.items():
        for i in range(len(p)):
            for j in range(i + 2, len(p) + 1):
                if j - i < len(p) and c >= counts[lang, p[i:j]]:
                    held.add((lang, p[i:j]))
    scored = {}
    for (lang, p), a in often.items():
        if (lang, p) in held:
            continue
        cuts = []
        for k in range(1, len(p)):
            left, right = counts[lang, p[:k]], counts[lang, p[k:]]
            cuts.append((1000 * a * totals[lang] // (left * right), k, left, right))
        value, _, left, right = min(cuts)
        scored.setdefault(lang, []).append((-value, -a, " ".join(p).encode(), left, right))
    out = []
    for lang, found in scored.items():
        for rank, (value, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -value))
    return sorted(out)


def found_phrases(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


SCHEMA = "text string, lang string, w string, words string, f string, g string, n string, phrase string"


def frame(spark, rows):
    return spark.createDataFrame([r + ("w", "ws", "f", "g", "n", "p") for r in rows], SCHEMA).repartition(3)


def made_rows(seed, n):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "à", "b", "İ", "c\x85d", "new", "York", "x" * 90, "e\xa0f", "\U0001f600"]
    ends = [". ", ", ", " ", " ", " ", "\t", "\n", "\r\n", "\x0b", "! ", "  ", ";"]
    rows = []
    for _ in range(n):
        words = [rng.choice(vocabulary) + rng.choice(ends) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.3:
            words.append("one fixed phrase of seven words here. ")
        rows.append(("".join(words), rng.choice(["en", "de", None, "und"])))
    return rows + [(None, "en"), ("", None), (" \t ", "fr"), ("..,;", "fr")]


@pytest.mark.parametrize("min_count,top", [(1, 10_000), (2, 50), (7, 2000), (14, 3)])
def test_collocations(spark, min_count, top, monkeypatch):
    rows = made_rows(min_count, 250)
    expected = plain_collocations(rows, min_count, top)
    assert expected
    assert found_phrases(phrases.collocations(frame(spark, rows), min_count, top)) == expected
    if min_count > 2:  # the other join, full filters, and texts cut into small parts
        monkeypatch.setattr(phrases, "MAX_FILTER_BYTES", 1)
        monkeypatch.setattr(phrases, "CHUNK_BYTES", 40)
        monkeypatch.setattr(phrases, "_PLACES", 7)
        assert found_phrases(phrases.collocations(frame(spark, rows), min_count, top, 0)) == expected


def test_long_text_without_pieces_is_cut_between_words(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(phrases, "CHUNK_BYTES", 64)
    rng = random.Random(1)
    text = " ".join(rng.choice(["ab", "Cd", "x" * 70, "é"]) for _ in range(500)) + ". " + "y" * 400 + " z\n" * 40
    units = list(phrases._units(pa.array([None, text, "", "a b"])))
    pairs = Counter()
    for unit in units:
        words, joined = phrases._words(unit)
        pairs.update((int(a), int(b)) for a, b, j in zip(words, words[1:], joined) if j)
    whole, joined = phrases._words([np.frombuffer(text.encode() + b"\na b", dtype=np.uint8)])
    assert pairs == Counter((int(a), int(b)) for a, b, j in zip(whole, whole[1:], joined) if j)


def test_odd_rows_through_collocations(spark, odd, nothing):
    rows = [(r.text, r.lang) for r in odd.collect()]
    assert found_phrases(phrases.collocations(odd, 100)) == plain_collocations(rows, 100, 2000)
    assert phrases.collocations(nothing).collect() == []
    assert phrases.fixed_phrases(nothing).collect() == []


def test_collocations_and_sql(spark, folder, docs):
    got = found_phrases(queries.op13_collocations(spark, folder))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    run = lambda sql: sorted(
        con.execute(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({sql})").fetchall()
    )
    assert got and got == run(oracles.ORACLES["op13_collocations"])
    rows = [(r.text, r.lang) for r in docs.collect()]
    assert run(collocations_sql(min_count=25, top=40)) == plain_collocations(rows, 25, 40)


def plain_paths(rows, min_count):
    edges, nodes = Counter(), Counter()
    for lang, words in plain_pieces(rows):
        edges.update((lang, tuple(words[i : i + 5])) for i in range(len(words) - 4))
        nodes.update((lang, tuple(words[i : i + 4])) for i in range(len(words) - 3))
    often = {e: c for e, c in edges.items() if c >= min_count}
    after = {}
    for (lang, e), c in often.items():
        if nodes[lang, e[1:]] == c:
            for (other, o), d in often.items():
                if other == lang and d == c and o[:4] == e[1:]:
                    after[lang, e] = (lang, o)
    out = []
    for e in set(often) - set(after.values()):
        words, last = list(e[1]), e
        while last in after:
            last = after[last]
            words.append(last[1][-1])
        out.append((e[0], " ".join(words), len(words), often[e]))
    return sorted(out)


def test_fixed_phrases(spark):
    rng = random.Random(8)
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(f"{rng.choice('ab')} {long} {rng.choice('cd')}", "en") for _ in range(30)]
    rows += [(long[: rng.randint(10, 100)], "en") for _ in range(9)]
    rows += [(" ".join(rng.choice("pqr") for _ in range(30)), "de") for _ in range(60)]
    got = phrases.fixed_phrases(frame(spark, rows), 12).collect()
    expected = plain_paths(rows, 12)
    assert sorted((r.lang, r.phrase, r.n_words, r.f) for r in got) == expected
    assert max(n for _, _, n, _ in expected) > 12
