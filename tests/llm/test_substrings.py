"""Repeated passages against plain Python; the FM-index against plain search."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from casebrook.llm import oracles, queries, substrings
from casebrook.llm.fmindex import FMIndex

WORD = re.compile(r"[^\x20\x09-\x0D]+")
W = substrings.WINDOW


def expected(rows):
    first = {}
    words = [WORD.findall(t or "") for _, t in rows]
    order = [(k is not None, k or 0) for k, _ in rows]
    for own, key in zip(words, order):
        for i in range(len(own) - W + 1):
            window = tuple(own[i : i + W])
            first[window] = min(first.get(window, key), key)
    out = []
    for own, key, (doc_id, _) in zip(words, order, rows):
        gone = set()
        for i in range(len(own) - W + 1):
            if first[tuple(own[i : i + W])] < key:
                gone.update(range(i, i + W))
        kept = " ".join(w for i, w in enumerate(own) if i not in gone)
        out.append((str(doc_id), len(own), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def found(df):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def test_substrings(spark, folder, texts):
    assert found(queries.op9_substrings(spark, folder)) == expected(list(texts.items()))


@pytest.mark.parametrize("big", [2000, 1])
def test_odd_rows(odd, nothing, monkeypatch, big):
    monkeypatch.setattr(substrings, "BIG_ANCHOR", big)
    assert found(substrings.without_repeats(odd)) == expected([(r.doc_id, r.text) for r in odd.collect()])
    assert substrings.without_repeats(nothing).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_spliced_documents(spark, seed, monkeypatch):
    monkeypatch.setattr(substrings, "SHARD_WORDS", 300)
    monkeypatch.setattr(substrings, "BIG_ANCHOR", [2000, 3, 1][seed])
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(60)) for _ in range(6)]
    rows = []
    for key in range(60):
        parts = []
        for _ in range(rng.randint(0, 6)):
            words = rng.choice(pool).split()
            low = rng.randint(0, 50)
            parts += words[low : low + rng.randint(1, 30)]
            if rng.random() < 0.3:
                parts += ["x"] * rng.randint(1, 30)
        rows.append((key, rng.choice([" ", "\n", "  "]).join(parts)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(substrings.without_repeats(df)) == expected(rows)


@pytest.mark.parametrize("few", [True, False])
def test_a_passage_amid_other_words_is_indexed_once(spark, monkeypatch, few):
    """Its end windows come from as many segments as there are documents."""
    monkeypatch.setattr(substrings, "BIG_ANCHOR", 20)
    if not few:
        sizes = iter([False, True])
        fits = substrings.fits_broadcast
        choose = lambda df: next(sizes) if {"times", "least"} & set(df.columns) else fits(df)
        monkeypatch.setattr(substrings, "fits_broadcast", choose)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = []
    for key in range(200):
        before, after = (" ".join(f"{s}{key}x{i}" for i in range(20)) for s in "ab")
        rows.append((key, f"{before} {passage} {after}"))
    indexed = []

    def index(routed, shards):
        indexed.extend(r.words for r in routed.collect())
        return real(routed, shards)

    real = substrings.first_documents
    monkeypatch.setattr(substrings, "first_documents", index)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(substrings.without_repeats(df)) == expected(rows)
    held = [w for words in indexed for w in windows_of(words)]
    assert len(held) == len(set(held))


def windows_of(words):
    words = WORD.findall(words.decode() if isinstance(words, (bytes, bytearray)) else words)
    return [tuple(words[i : i + W]) for i in range(len(words) - W + 1)]


@given(
    st.lists(st.lists(st.integers(0, 4), min_size=1, max_size=25), min_size=1, max_size=8),
    st.lists(st.integers(0, 5), min_size=1, max_size=25),
)
@settings(max_examples=150, deadline=None)
def test_matching_statistics(sequences, query):
    flat = np.array([x for s in sequences for x in s], dtype=np.uint64)
    index = FMIndex(flat, np.array([len(s) for s in sequences]))
    codes = index.codes(np.array(query, dtype=np.uint64))
    ends = np.arange(1, len(query) + 1)
    length, low, high = index.match(codes, ends, np.minimum(ends, 15))
    for end, n, a, b in zip(ends, length, low, high):
        times = lambda run: sum(
            s[i : i + len(run)] == run for s in sequences for i in range(len(s) - len(run) + 1)
        )
        assert n == 0 or times(query[end - n : end]) == b - a
        assert n in (end, 15) or times(query[end - n - 1 : end]) == 0


def test_sql(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = sorted((str(a), b, c, d) for a, b, c, d in con.execute(
        "SELECT doc_id, n_words, n_removed, kept_sha256 FROM ("
        + oracles.ORACLES["op9_substrings"] + ")").fetchall())
    assert found(queries.op9_substrings(spark, folder)) == want
