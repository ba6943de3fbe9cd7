"""Removal of repeated passages, found with an FM-index per shard.

A window of ``WINDOW`` words is removed if it also starts in a document with a
smaller id. Every window has an anchor, the least hash among its ``ANCHOR``-word
runs; equal windows have equal anchors. The work is:

0. A document whose whole text has a smaller id goes whole and takes no part.
1. Anchors of all documents are counted. Those of one document cannot repeat.
2. Runs of windows with one repeated anchor (segments of text) go to the shard
   of their anchor. The repeated anchors are known to tasks as a Bloom filter of
   bounded size; its false hits send more segments and change no result.
3. Equal segments are one, with their smallest id, before anything is gathered;
   so a passage that very many documents share is a few segments. Anchors with
   many different segments (a passage amid texts that differ) are cut into single
   windows, which are grouped by a 128-bit hash: the smallest id of a window comes
   from an aggregation, and no index holds a window more than once.
4. Each shard builds its FM-index and streams its segments against it: backward
   search gives matching statistics and, where they reach the window, the
   interval of suffixes and in it the smallest id.
5. Intervals go back to the documents that hold the segments.

Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebrook.llm import arrowwords, bloom
from casebrook.llm.blobs import cut_by_shard, joined, shards_for
from casebrook.llm.fmindex import FMIndex
from casebrook.llm.scratch import discard, written
from casebrook.operators.sizing import MAX_BYTES, MAX_ROWS, fits_broadcast

WINDOW = 13
ANCHOR = 4
BITS_PER_ANCHOR = 16
MAX_FILTER_BYTES = 64 << 20
SHARD_WORDS = 1 << 18
BIG_ANCHOR = 2000  # segments of one anchor beyond which its windows go singly
_LOWEST = -(1 << 63)
_HELD = 1 << 20
_OTHER = np.uint64(0x452821E638D01377)


def anchors(words: np.ndarray) -> np.ndarray:
    """The anchor of every window of consecutive words."""
    least = arrowwords.windows(words, ANCHOR)
    wide, width = WINDOW - ANCHOR + 1, 1
    if len(least) < wide:
        return np.zeros(0, dtype=np.uint64)
    while width * 2 <= wide:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = wide - width
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    return arrowwords.mix(least)  # least values are low, shards and filters want them spread


def segments(part: arrowwords.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor in one row, ``WINDOW`` windows at most.

    Returned are the row, the anchor, the first window (a place in the slice's
    words) and the number of windows of each.
    """
    rows = part.rows()
    found = anchors(part.words)
    inside = np.flatnonzero(rows[: len(found)] == rows[WINDOW - 1 :][: len(found)])
    if not len(inside):
        none = np.zeros(0, dtype=np.int64)
        return none, none.astype(np.uint64), none, none
    own = found[inside]
    fresh = np.concatenate(([True], (np.diff(inside) != 1) | (own[1:] != own[:-1])))
    first = np.flatnonzero(fresh)
    lengths = np.diff(np.append(first, len(inside)))
    pieces = -(-lengths // WINDOW)
    within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = np.repeat(inside[first], pieces) + within * WINDOW
    counts = np.minimum(np.repeat(inside[first] + lengths, pieces) - starts, WINDOW)
    return rows[starts], found[starts], starts, counts


def _prepared(docs: DataFrame) -> DataFrame:
    """Rows by what identifies them: the id (null: before all) and the text's hash."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        F.coalesce(docs["doc_id"].cast("long"), F.lit(_LOWEST)).alias("key"),
        F.xxhash64(text).alias("print"),
        text.alias("text"),
    )


def with_copies(rows: DataFrame) -> DataFrame:
    """Add ``is_copy``: the same text has a smaller id. All its windows then go."""
    marks = rows.select("key", "print", F.xxhash64("text", F.lit(1)).alias("second"))
    texts = marks.groupBy("print", "second").agg(F.min("key").alias("a"), F.max("key").alias("z"))
    first = texts.where("a < z").select("print", "second", "a")
    first, _ = written(first, "copied-texts")
    first = F.broadcast(first) if fits_broadcast(first) else first
    joined_rows = rows.withColumn("second", F.xxhash64("text", F.lit(1))).join(
        first, ["print", "second"], "left"
    )
    copy = F.coalesce(F.col("key") > F.col("a"), F.lit(False))
    return joined_rows.withColumn("is_copy", copy).drop("second", "a")


def _fits(spans: DataFrame) -> bool:
    size = spans.agg(F.count("*").alias("n"), F.sum(F.size("spans")).alias("spans")).first()
    return size["n"] <= MAX_ROWS and 32 * size["n"] + 8 * (size["spans"] or 0) <= MAX_BYTES


def repeated_anchors(texts: DataFrame, shards: int) -> DataFrame:
    """Anchors (signed 64-bit) that occur in two rows or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def emit() -> pa.RecordBatch:
            keys, times = np.unique(np.concatenate(held), return_counts=True)
            twice = (times > 1).astype(np.uint8)
            cuts = cut_by_shard(keys, shards)
            full = np.flatnonzero(np.diff(cuts))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(full, type=pa.int32()),
                    pa.array([keys[cuts[s] : cuts[s + 1]].tobytes() for s in full], type=pa.binary()),
                    pa.array([twice[cuts[s] : cuts[s + 1]].tobytes() for s in full], type=pa.binary()),
                ],
                names=["shard", "keys", "twice"],
            )

        for batch in batches:
            for part in arrowwords.slices(batch.column(0), False):
                rows, own, _, _ = segments(part)
                order = np.lexsort((rows, own))
                rows, own = rows[order], own[order]
                # once for each row
                new = np.ones(len(own), dtype=bool)
                new[1:] = (own[1:] != own[:-1]) | (rows[1:] != rows[:-1])
                held.append(own[new])
                size += len(held[-1])
                if size >= _HELD:
                    yield emit()
                    held, size = [], 0
        if held:
            yield emit()

    def merge(table: pa.Table) -> pa.Table:
        keys, twice = joined(table.column("keys"), np.uint64), joined(table.column("twice"), np.uint8)
        order = np.argsort(keys, kind="stable")
        keys, twice = keys[order], twice[order] > 0
        equal = keys[1:] == keys[:-1]
        twice[1:] |= equal
        return pa.table({"anchor": pa.array(np.unique(keys[twice]).view(np.int64))})

    partial = texts.mapInArrow(count, "shard int, keys binary, twice binary")
    return partial.groupBy("shard").applyInArrow(merge, "anchor long")


SEGMENT = "anchor long, one long, two long, key long, print long, start int, words binary"


def candidate_segments(rows: DataFrame, found: bloom.Bloom) -> DataFrame:
    """Segments whose anchor may be repeated, with a 128-bit hash of their words."""
    bits = rows.sparkSession.sparkContext.broadcast(found.bits.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = bloom.Bloom(np.frombuffer(bits.value, dtype=np.uint8))
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            prints = batch.column(1).to_numpy(zero_copy_only=False)
            for part in arrowwords.slices(batch.column(2), False):
                rows, own, starts, counts = segments(part)
                hit = probe.contains(own)
                rows, own, starts, counts = rows[hit], own[hit], starts[hit], counts[hit]
                if not len(starts):
                    continue
                hashed = arrowwords.windows(part.words, WINDOW)
                with np.errstate(over="ignore"):
                    # sums of the windows' hashes, in two ways
                    one = np.concatenate(([np.uint64(0)], np.cumsum(hashed)))
                    two = np.concatenate(([np.uint64(0)], np.cumsum(arrowwords.mix(hashed))))
                    one = one[starts + counts] - one[starts] + counts.astype(np.uint64)
                    two = (two[starts + counts] - two[starts]) ^ hashed[starts]
                raw = part.data.tobytes()
                lows = part.starts[starts].tolist()
                highs = part.ends[starts + counts + WINDOW - 2].tolist()
                at = rows + part.first
                numbers = [own.view(np.int64), arrowwords.mix(one).view(np.int64)]
                numbers += [arrowwords.mix(two).view(np.int64), keys[at], prints[at]]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array(c, type=pa.int64()) for c in numbers),
                        pa.array(starts - part.bounds[rows], type=pa.int32()),
                        pa.array([raw[a:b] for a, b in zip(lows, highs)], type=pa.binary()),
                    ],
                    names=[f.split()[0] for f in SEGMENT.split(", ")],
                )

    return rows.select("key", "print", "text").mapInArrow(run, SEGMENT)


def _texts(column: pa.Array | pa.ChunkedArray) -> list[arrowwords.Slice]:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return [part for c in chunks for part in arrowwords.slices(c.cast(pa.string()), False)]


WINDOWS = "route long, second long, one long, two long, skip int, first long, last long"


def _single_windows(big: DataFrame) -> DataFrame:
    """Segments as single windows, each with a 128-bit hash of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _texts(batch.column(4)):
                rows = part.rows()
                routes = arrowwords.windows(part.words, WINDOW)
                seconds = arrowwords.windows(arrowwords.mix(part.words ^ _OTHER), WINDOW)
                inside = np.flatnonzero(rows[: len(routes)] == rows[WINDOW - 1 :][: len(routes)])
                own = rows[inside]
                at = pa.array(own + part.first)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(routes[inside].view(np.int64)),
                        pa.array(seconds[inside].view(np.int64)),
                        batch.column(0).take(at),
                        batch.column(1).take(at),
                        pa.array(inside - part.bounds[own], type=pa.int32()),
                        batch.column(2).take(at),
                        batch.column(3).take(at),
                    ],
                    names=[f.split()[0] for f in WINDOWS.split(", ")],
                )

    return big.select("one", "two", "first", "last", "words").mapInArrow(run, WINDOWS)


def first_of_windows(big: DataFrame) -> tuple[DataFrame, str]:
    """What ``first_documents`` returns, for each window of these segments by itself.

    Equal windows have equal anchors, so all of them are here. A window that very
    many segments hold is joined back by broadcast: there can be only few of them.
    """
    windows = _single_windows(big)
    least = (
        windows.groupBy("route", "second")
        .agg(F.min("first").alias("least"), F.max("last").alias("most"), F.count("*").alias("times"))
        .where("least < most")
        .select("route", "second", "least", "times")
    )
    least, path = written(least, "first-of-windows")
    common = least.where(F.col("times") > BIG_ANCHOR).drop("times")
    usual = least.where(F.col("times") <= BIG_ANCHOR).drop("times")
    if fits_broadcast(least):
        found = windows.join(F.broadcast(least.drop("times")), ["route", "second"])
    elif fits_broadcast(common):
        common, keys = F.broadcast(common), F.broadcast(common.select("route", "second"))
        rest = windows.join(keys, ["route", "second"], "left_anti")
        found = windows.join(common, ["route", "second"]).unionByName(
            rest.join(usual, ["route", "second"])
        )
    else:
        found = windows.join(least.drop("times"), ["route", "second"])
    return found.where("least < last").select("one", "two", "skip", F.array("least").alias("firsts")), path


def first_documents(routed: DataFrame, shards: int) -> DataFrame:
    """For each segment the smallest id that holds each of its windows.

    Only segments are returned of which some document with a greater id has a
    window. Every shard builds one index and streams its segments against it.
    """

    def search(table: pa.Table) -> pa.Table:
        parts = _texts(table.column("words"))
        words = np.concatenate([p.words for p in parts])
        lengths = np.concatenate([np.diff(p.bounds) for p in parts])
        index = FMIndex(words, lengths)
        owner = table.column("first").to_numpy()
        # the id behind each suffix; what starts at a separator is behind none
        place = np.searchsorted(index.starts, index.suffixes, side="right") - 1
        ids = owner[place]
        windows = lengths - WINDOW + 1
        segment = np.repeat(np.arange(len(lengths)), windows)
        within = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        ends = index.starts[segment] + within + WINDOW
        # equal windows need one search
        begins = np.cumsum(lengths) - lengths
        routes = arrowwords.windows(words, WINDOW)[begins[segment] + within]
        _, pick, back = np.unique(routes, return_index=True, return_inverse=True)
        reach = np.full(len(pick), WINDOW, dtype=np.int64)
        # the index holds each of its windows once at least; other documents have
        # only those that it holds twice, so a search ends where one place is left
        statistics, low, high = index.match(index.text, ends[pick], reach, least=2)
        bounds = np.stack([low, high], axis=1).reshape(-1)
        least = np.minimum.reduceat(np.append(ids, np.iinfo(np.int64).max), bounds)[::2]
        least = np.where(statistics >= WINDOW, least, owner[segment[pick]])[back]
        starts = np.cumsum(windows) - windows
        useful = np.flatnonzero(np.minimum.reduceat(least, starts) < table.column("last").to_numpy())
        lists = [least[starts[s] : starts[s] + windows[s]].tolist() for s in useful]
        chosen = table.select(["one", "two", "skip"]).take(pa.array(useful))
        return chosen.append_column("firsts", pa.array(lists, type=pa.list_(pa.int64())))

    shard = F.pmod(F.xxhash64("route"), F.lit(shards)).alias("shard")
    dealt = routed.select(shard, "one", "two", "skip", "first", "last", "words")
    return dealt.groupBy("shard").applyInArrow(
        search, "one long, two long, skip int, firsts array<long>"
    )


def repeated_spans(rows: DataFrame) -> DataFrame:
    """``key, print, spans``: word ranges to remove from each row that has some."""
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    repeated, at_repeated = written(
        repeated_anchors(rows.select("text"), shards_for(int(size))), "anchors"
    )
    found = bloom.of_column(repeated, "anchor", BITS_PER_ANCHOR, MAX_FILTER_BYTES)
    discard(spark, at_repeated)
    held, at_held = written(candidate_segments(rows, found), "segments")
    distinct, at_distinct = written(
        held.groupBy("anchor", "one", "two").agg(
            F.min("key").alias("first"), F.max("key").alias("last"), F.first("words").alias("words")
        ),
        "distinct-segments",
    )
    big = distinct.groupBy("anchor").count().where(F.col("count") > BIG_ANCHOR).select("anchor")
    big = F.broadcast(big) if fits_broadcast(big) else big
    usual = distinct.join(big, "anchor", "left_anti").select(
        F.col("anchor").alias("route"), "one", "two", F.lit(0).alias("skip"), "first", "last", "words"
    )
    words = usual.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    shards = max(1, int(words) // 6 // SHARD_WORDS + 1)
    singly, at_windows = first_of_windows(distinct.join(big, "anchor", "left_semi"))
    firsts, at_firsts = written(
        first_documents(usual, shards).unionByName(singly), "first-documents"
    )
    gone = F.filter(
        F.sequence(F.lit(0), F.size("firsts") - 1), lambda k: F.get("firsts", k) < F.col("key")
    )
    low = F.col("start") + F.col("skip") + F.array_min("gone")
    high = F.col("start") + F.col("skip") + F.array_max("gone") + WINDOW
    spans = (
        held.select("one", "two", "key", "print", "start")
        .join(firsts, ["one", "two"])
        .withColumn("gone", gone)
        .where(F.size("gone") > 0)
        .groupBy("key", "print")
        .agg(F.collect_set(F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"))).alias("spans"))
    )
    spans, _ = written(spans, "repeated-spans")
    for path in (at_held, at_distinct, at_windows, at_firsts):
        discard(spark, path)
    return spans


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def without_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept_text`` of each row.

    Windows are judged on ``docs(doc_id, text)`` as it is, not on what is left.
    Null texts have no words; null ids come before all others and are equal to
    each other, as are rows that repeat an id; an empty table gives no rows;
    other columns are not read. ``kept_text`` is the kept words with one space
    between them.
    """
    rows = with_copies(_prepared(docs))
    spans = repeated_spans(rows.where("not is_copy").drop("is_copy"))
    if _fits(spans):
        spans = F.broadcast(spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            held = 0

            def emit() -> pa.RecordBatch:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                return pa.RecordBatch.from_arrays(
                    [pa.array(c, type=t) for c, t in zip(zip(*out), types)],
                    names=[f.split()[0] for f in RESULT.split(", ")],
                )

            for doc_id, text, ranges, copy in zip(*(batch.column(i) for i in range(4))):
                words = text.as_py().encode().split()
                gone = np.zeros(len(words) + 1, dtype=np.int64)
                for r in ranges.as_py() or ():
                    gone[r["low"]] += 1
                    gone[r["high"]] -= 1
                if copy.as_py() and len(words) >= WINDOW:
                    gone[0] += 1
                kept = np.cumsum(gone)[: len(words)] == 0
                if kept.all():
                    left = b" ".join(words)
                else:
                    left = b" ".join(words[k] for k in np.flatnonzero(kept))
                removed = len(words) - int(kept.sum())
                digest = hashlib.sha256(left).hexdigest()
                out.append((doc_id.as_py(), len(words), removed, digest, left.decode()))
                held += len(left)
                if held > 8 << 20:
                    yield emit()
                    out, held = [], 0
            if out:
                yield emit()

    joined_rows = rows.join(spans, ["key", "print"], "left")
    joined_rows = joined_rows.select("doc_id", "text", "spans", "is_copy")
    return joined_rows.mapInArrow(run, RESULT)
