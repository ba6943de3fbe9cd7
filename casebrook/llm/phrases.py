"""Collocations from a weighted de Bruijn graph of word sequences.

Edges are runs of ``LONGEST`` words, nodes the runs of one word less that they
overlap in. Every place of a text is counted once, with the longest run that
starts there: an edge, or a shorter run where its piece ends first. All shorter
counts follow from these. The flow through a node is the weight of its outgoing
edges plus the piece ends on it; summing flows by the words before the last one
gives the counts of the next shorter runs, down to two words.

The graph holds only what can matter. A phrase of ``min_count`` occurrences is
made of words and of pairs that occur as often, so words are counted first, pairs
of frequent words next, and edges only where all pairs are frequent. Bloom filters
of the frequent words and pairs go to the tasks; a false hit lets a rare pair in,
with its true count, and costs a row. A run that ends at a rare pair counts as a
piece end, so the counts of frequent phrases stay exact.

Unary paths are compacted: a node whose whole flow passes along one edge is part
of a longer phrase that is just as frequent, and goes. :func:`fixed_phrases` joins
such edges to whole paths by doubling, in rounds that are the logarithm of the
longest path.

Words are known by 64-bit hashes; texts of words come back from the word counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casebrook.llm import arrowwords, bloom
from casebrook.llm.scratch import discard, written
from casebrook.operators.sizing import MAX_BYTES

LONGEST = 5
MIN_COUNT = 100
TOP = 2000
SALTS = 16
BITS_PER_KEY = 16
MAX_FILTER_BYTES = 64 << 20
CHUNK_BYTES = 1 << 20
_PLACES = 1 << 17  # places of a text in one batch of output

_W = [f"w{k}" for k in range(1, LONGEST + 1)]
_PIECE = np.zeros(256, dtype=bool)
_PIECE[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = True
_OUTSIDE = _PIECE.copy()
_OUTSIDE[[9, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _cuts(data: np.ndarray) -> Iterator[tuple[int, int, bool]]:
    """Parts of a text of about a chunk; true where a piece ends with the part.

    A part ends at the end of a piece if there is one within two chunks, else
    between words.
    """
    low, size = 0, len(data)
    while size - low > 2 * CHUNK_BYTES:
        start = low + CHUNK_BYTES
        ends = np.flatnonzero(_PIECE[data[start : start + CHUNK_BYTES]])
        whole = len(ends) > 0
        if not whole:
            while start < size:
                ends = np.flatnonzero(_OUTSIDE[data[start : start + CHUNK_BYTES]])
                if len(ends):
                    break
                start += CHUNK_BYTES
        end = start + int(ends[0]) if len(ends) else size
        yield low, end, whole
        low = end
    yield low, size, True


def _units(texts: pa.Array) -> Iterator[list[np.ndarray]]:
    """Runs of bytes that no phrase leaves, in parts; rows are separate pieces."""
    raw, at = arrowwords._buffers(texts)
    row, rows = 0, len(texts)
    while row < rows:
        last = int(np.searchsorted(at, at[row] + CHUNK_BYTES, side="right")) - 1
        last = min(max(last, row + 1), rows)
        low, high = int(at[row]), int(at[last])
        if last == row + 1:
            parts: list[np.ndarray] = []
            for a, b, whole in _cuts(raw[low:high]):
                parts.append(raw[low + a : low + b])
                if whole:
                    yield parts
                    parts = []
        else:
            gap = at[row : last + 1] - low + np.arange(last + 1 - row)
            data = np.full(int(gap[-1]), 10, dtype=np.uint8)
            keep = np.ones(len(data), dtype=bool)
            keep[gap[1:] - 1] = False
            data[keep] = raw[low:high]
            yield [data]
        row = last


def _spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = ~_OUTSIDE[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[0::2], edges[1::2]


def _words(unit: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a unit's words, and whether each word and the next share a piece."""
    hashes, pieces, before = [], [], 0
    for part in unit:
        data = _FOLD[part]
        starts, ends = _spans(data)
        hashes.append(arrowwords.hashes(data, starts, ends, False))
        passed = np.cumsum(_PIECE[data], dtype=np.int64)
        pieces.append(passed[starts] + before)
        before += int(passed[-1]) if len(passed) else 0
    found, piece = np.concatenate(hashes), np.concatenate(pieces)
    return found, piece[1:] == piece[:-1]


def _word_keys(group: np.ndarray, words: np.ndarray) -> np.ndarray:
    return arrowwords.mix(words ^ group)


def _pair_keys(group: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return arrowwords.mix(_word_keys(group, first) * np.uint64(0xD6E8FEB86659FD93) + second)


def _by_group(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.Array]]:
    """The texts of a batch, group by group."""
    groups = batch.column(0).to_numpy()
    order = np.argsort(groups, kind="stable")
    cuts = np.flatnonzero(np.diff(groups[order])) + 1
    for rows in np.split(order, cuts) if len(order) else []:
        yield int(groups[rows[0]]), batch.column(1).take(pa.array(rows))


def _unsigned(group: int) -> np.uint64:
    return np.uint64(group & (1 << 64) - 1)


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _prepared(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(docs["lang"].cast("string"), F.lit("und"))
    return docs.select(
        F.xxhash64(lang).alias("g"),
        F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"),
        lang.alias("lang"),
    )


def _word_counts(rows: DataFrame) -> DataFrame:
    """``g, w, word, f``: every word of every group with its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, texts in _by_group(batch):
                for part in (p for unit in _units(texts) for p in unit):
                    data = _FOLD[part]
                    starts, ends = _spans(data)
                    hashes = arrowwords.hashes(data, starts, ends, False)
                    found, first, counts = np.unique(hashes, return_index=True, return_counts=True)
                    raw = data.tobytes()
                    words = [raw[a:b] for a, b in zip(starts[first], ends[first])]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(found), group, dtype=np.int64)),
                            _longs(found),
                            pa.array(words, type=pa.binary()).cast(pa.string()),
                            pa.array(counts.astype(np.int64)),
                        ],
                        names=["g", "w", "word", "f"],
                    )

    parts = rows.select("g", "text").mapInArrow(run, "g long, w long, word string, f long")
    return parts.groupBy("g", "w", "word").agg(F.sum("f").alias("f"))


def _filter(df: DataFrame, key: Callable, *columns: str) -> tuple:
    """A broadcast Bloom filter of rows ``g`` and word hashes."""

    @F.pandas_udf("long")
    def keys(group: pd.Series, *words: pd.Series) -> pd.Series:
        own = group.to_numpy(dtype=np.int64).view(np.uint64)
        found = key(own, *(w.to_numpy(dtype=np.int64).view(np.uint64) for w in words))
        return pd.Series(found.view(np.int64))

    keyed = df.select(keys("g", *columns).alias("key"))
    found = bloom.of_column(keyed, "key", BITS_PER_KEY, MAX_FILTER_BYTES)
    return df.sparkSession.sparkContext.broadcast(found.bits.tobytes())


def _pairs(rows: DataFrame, frequent: DataFrame) -> DataFrame:
    """``g, w1, w2, f``: pairs of frequent words within pieces."""
    held = _filter(frequent, _word_keys, "w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bloom.Bloom(np.frombuffer(held.value, dtype=np.uint8))
        for batch in batches:
            for group, texts in _by_group(batch):
                for unit in _units(texts):
                    words, joined = _words(unit)
                    often = known.contains(_word_keys(_unsigned(group), words))
                    at = np.flatnonzero(joined & often[:-1] & often[1:])
                    for low in range(0, len(at), _PLACES):
                        own = at[low : low + _PLACES]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(len(own), group, dtype=np.int64)),
                                _longs(words[own]),
                                _longs(words[own + 1]),
                            ],
                            names=["g", "w1", "w2"],
                        )

    places = rows.select("g", "text").mapInArrow(run, "g long, w1 long, w2 long")
    return places.groupBy("g", "w1", "w2").agg(F.count("*").alias("f"))


def _edges(rows: DataFrame, frequent: DataFrame) -> DataFrame:
    """``g, w1 .. w5, f``: the longest run of frequent pairs from every place.

    Words past the end of a run are null: such a row is a piece end.
    """
    held = _filter(frequent, _pair_keys, "w1", "w2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bloom.Bloom(np.frombuffer(held.value, dtype=np.uint8))
        for batch in batches:
            for group, texts in _by_group(batch):
                for unit in _units(texts):
                    words, joined = _words(unit)
                    at = np.flatnonzero(joined)
                    hit = known.contains(_pair_keys(_unsigned(group), words[at], words[at + 1]))
                    on = np.zeros(len(words) + LONGEST, dtype=bool)
                    on[at[hit]] = True
                    for low in range(0, int(hit.sum()), _PLACES):
                        own = at[hit][low : low + _PLACES]
                        columns = [pa.array(np.full(len(own), group, dtype=np.int64)), _longs(words[own])]
                        going = np.ones(len(own), dtype=bool)
                        for k in range(1, LONGEST):
                            going &= on[own + k - 1]
                            there = words[np.minimum(own + k, len(words) - 1)]
                            columns.append(pa.array(there.view(np.int64), mask=~going))
                        yield pa.RecordBatch.from_arrays(columns, names=["g", *_W])

    schema = ", ".join(f"{c} long" for c in ["g", *_W])
    return rows.select("g", "text").mapInArrow(run, schema).groupBy("g", *_W).agg(F.count("*").alias("f"))


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """Frequent words and phrases of ``docs(lang, text)``, group by group.

    First ``g, w, word, f, lang, n``: the words with at least ``min_count``
    occurrences, the group's name and all its word occurrences. Second ``g, words,
    f``: phrases of one to ``LONGEST`` words (arrays of hashes) as frequent.
    """
    rows = _prepared(docs)
    counts, _ = written(_word_counts(rows), "word-counts")
    names = rows.select("g", "lang").distinct()
    totals = counts.groupBy("g").agg(F.sum("f").alias("n")).join(names, "g")
    words = counts.where(F.col("f") >= min_count).join(F.broadcast(totals), "g")
    words, _ = written(words, "frequent-words")
    pairs, _ = written(_pairs(rows, words).where(F.col("f") >= min_count), "frequent-pairs")
    runs, at_runs = written(_edges(rows, pairs), "edges")
    found = [words.select("g", F.array("w").alias("words"), "f")]
    for size in range(LONGEST, 1, -1):
        own = _W[:size]
        if size < LONGEST:  # flows of nodes; shorter runs among them are piece ends
            shorter, at = written(runs.groupBy("g", *own).agg(F.sum("f").alias("f")), "flows")
            runs = shorter
        frequent = runs.where(F.col(own[-1]).isNotNull() & (F.col("f") >= min_count))
        found.append(frequent.select("g", F.array(*own).alias("words"), "f"))
    phrases, _ = written(reduce(DataFrame.union, found), "phrases")
    return words, phrases


def _contracted(phrases: DataFrame) -> DataFrame:
    """``g, words, f``: nodes whose whole flow passes along one edge of the graph of their length."""
    ends = F.array(F.expr("slice(words, 1, size(words) - 1)"), F.expr("slice(words, 2, size(words) - 1)"))
    longer = phrases.where(F.size("words") > 2)
    return longer.select("g", F.explode(ends).alias("words"), "f").distinct()


def _with_counts(parts: DataFrame, counts: DataFrame, most_bytes: int) -> DataFrame:
    """``parts`` with ``f`` of ``g, words``; a word in very many phrases is dealt by salt."""
    if 24 * LONGEST * counts.count() <= most_bytes:
        return parts.join(F.broadcast(counts), ["g", "words"])
    salted = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = F.pmod(F.xxhash64("whole"), F.lit(SALTS)).cast("int")
    return parts.withColumn("salt", own).join(salted, ["g", "words", "salt"]).drop("salt")


def score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (l r)), exactly: 38 digits hold the products of 64-bit counts of real corpora."""
    wide = lambda c: c.cast("decimal(18,0)")
    above = wide(a) * F.lit(1000).cast("decimal(4,0)")
    return F.floor(F.call_function("div", above * wide(n), wide(left) * wide(right))).cast("long")


def collocations(
    docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, most_bytes: int = MAX_BYTES
) -> DataFrame:
    """The first ``top`` phrases of every ``lang`` of ``docs(lang, text)``.

    Columns ``lang, rank, phrase, a, l, r, n, score``. A null ``lang`` is ``und``;
    null or empty texts have no words; repeated rows count each; an empty table
    gives no rows; other columns are not read.
    """
    words, phrases = phrase_counts(docs, min_count)
    kept = phrases.where(F.size("words") > 1).join(_contracted(phrases), ["g", "words", "f"], "left_anti")
    cuts = kept.select(
        "g",
        F.col("words").alias("whole"),
        F.col("f").alias("a"),
        F.explode(F.expr("sequence(1, size(words) - 1)")).alias("cut"),
    )
    sides = F.explode(
        F.array(
            F.struct(F.lit(True).alias("first"), F.expr("slice(whole, 1, cut)").alias("words")),
            F.struct(F.lit(False).alias("first"), F.expr("slice(whole, cut + 1, size(whole))").alias("words")),
        )
    ).alias("side")
    parts = cuts.select("g", "whole", "a", "cut", sides).select("g", "whole", "a", "cut", "side.*")
    counted = (
        _with_counts(parts, phrases, most_bytes)
        .groupBy("g", "whole", "a", "cut")
        .agg(F.max(F.when(F.col("first"), F.col("f"))).alias("l"), F.max(F.when(~F.col("first"), F.col("f"))).alias("r"))
    )
    groups = F.broadcast(words.select("g", "lang", "n").distinct())
    scored = (
        counted.join(groups, "g")
        .withColumn("score", score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
        .groupBy("g", "lang", "n", "whole", "a")
        .agg(F.min(F.struct("score", "cut", "l", "r")).alias("least"))
        .select("g", "lang", "n", "whole", "a", "least.score", "least.l", "least.r")
    )
    order = Window.partitionBy("g").orderBy(F.desc("score"), F.desc("a"))
    near = scored.withColumn("place", F.rank().over(order)).where(F.col("place") <= top).drop("place")
    near, _ = written(near, "best-phrases")
    named = _named(near, words, most_bytes)
    order = Window.partitionBy("g").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _named(rows: DataFrame, words: DataFrame, most_bytes: int) -> DataFrame:
    """Add ``phrase``, the words of the hashes ``whole`` in order."""
    at = rows.select("g", "whole", F.posexplode("whole").alias("pos", "w")).distinct()
    own = at.select("g", "w").distinct()
    table = words.join(own, ["g", "w"], "left_semi").select("g", F.array("w").alias("words"), F.col("word").alias("f"))
    at = at.select("g", "whole", "pos", F.array("w").alias("words"))
    texts = (
        _with_counts(at, table, most_bytes)
        .groupBy("g", "whole")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "f"))).alias("parts"))
        .select("g", "whole", F.array_join("parts.f", " ").alias("phrase"))
    )
    return rows.join(texts, ["g", "whole"])


def fixed_phrases(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """``lang, phrase, n_words, f``: the compacted unary paths of every ``lang``.

    A path joins edges (runs of ``LONGEST`` words) whose shared node has no other
    edge, piece end or piece start, so its words always stand together; paths of
    one edge are included. Rounds end when every node knows the head of its path.
    """
    words, phrases = phrase_counts(docs, min_count)
    edges = phrases.where(F.size("words") == LONGEST)
    nodes = phrases.where(F.size("words") == LONGEST - 1)
    tails = edges.select("g", "words", "f", F.expr(f"slice(words, 1, {LONGEST - 1})").alias("u"))
    ends = tails.withColumn("v", F.expr(f"slice(words, 2, {LONGEST - 1})"))
    node = lambda name: nodes.select("g", F.col("words").alias(name), "f")
    # an edge continues the edge before it where all flow of their node is its own and that one's
    after = ends.join(node("u"), ["g", "u", "f"], "left_semi").select("g", F.col("u").alias("x"), F.col("words").alias("e"), "f")
    before = ends.join(node("v"), ["g", "v", "f"], "left_semi").select("g", F.col("v").alias("x"), F.col("words").alias("head"), "f")
    links = after.join(before, ["g", "x", "f"]).select("g", "e", "head")
    state = edges.select("g", F.col("words").alias("e"), "f").join(links, ["g", "e"], "left")
    state = state.select("g", "e", "f", F.coalesce("head", "e").alias("head"), F.when(F.col("head").isNull(), 0).otherwise(1).alias("steps"))
    state, path = written(state, "paths")
    while True:
        step = state.select("g", F.col("e").alias("head"), F.col("head").alias("further"), F.col("steps").alias("more"))
        moved = state.join(step, ["g", "head"]).select(
            "g", "e", "f", F.col("further").alias("head"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("more") > 0).alias("moved")
        )
        moved, new_path = written(moved, "paths")
        discard(docs.sparkSession, path)
        state, path = moved.drop("moved"), new_path
        if moved.where("moved").isEmpty():
            break
    last = F.when(F.col("steps") == 0, F.col("e")).otherwise(F.array(F.element_at("e", LONGEST)))
    whole = (
        state.groupBy("g", "head", "f")
        .agg(F.sort_array(F.collect_list(F.struct("steps", last.alias("w")))).alias("parts"))
        .select("g", "f", F.flatten("parts.w").alias("whole"))
    )
    named = _named(whole, words, MAX_BYTES)
    langs = F.broadcast(words.select("g", "lang").distinct())
    return named.join(langs, "g").select("lang", "phrase", F.size("whole").cast("long").alias("n_words"), "f")
