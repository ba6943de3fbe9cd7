"""Document fingerprints by consistent weighted sampling.

A text is a bag of words with counts as weights (A-Z lower-cased). For each of
the samples every word has two gamma(2, 1) values r, c and a uniform b, all
derived from its hash. With t = floor(ln w / r + b) its score is
ln c - r (t - b + 1); the lowest score of a text is its sample. Two texts agree
in a sample with a chance equal to the generalised Jaccard similarity of their
weights, the sum of the lesser over the sum of the greater counts.

A word and its t fix the score to the bit, so the score itself stands for the
sample: a fingerprint is the scores' bits in hex, eight digits for each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebrook.llm import arrowwords

SAMPLES = 64
BIN_BYTES = 16 << 20
MAX_BINS = 1 << 16
BLOCK_CHARS = 1 << 20  # texts and edits worked on at a time
_TOGETHER = 16  # samples worked on at a time,
_CELLS = 1 << 20  # and scores, to bound memory
_LOWEST = -(1 << 63)


def _parameters(terms: np.ndarray, samples: range) -> tuple[np.ndarray, ...]:
    """r, ln c and b of each term (rows) and sample (columns)."""
    seeds = arrowwords.series(2, samples.stop)[samples.start :]
    one = arrowwords.mix(terms[:, None] ^ seeds)
    two = arrowwords.mix(one + np.uint64(0x9E3779B97F4A7C15))
    half = np.float32(0.5)
    u1 = ((one >> np.uint64(40)).astype(np.float32) + half) * np.float32(2.0**-24)
    u2 = ((one & np.uint64(0xFFFFFF)).astype(np.float32) + half) * np.float32(2.0**-24)
    u3 = ((two >> np.uint64(43)).astype(np.float32) + half) * np.float32(2.0**-21)
    u4 = ((two >> np.uint64(22) & np.uint64(0x1FFFFF)).astype(np.float32) + half) * np.float32(2.0**-21)
    b = (two & np.uint64(0x3FFFFF)).astype(np.float32) * np.float32(2.0**-22)
    r = -np.log(u1 * u2)
    return r, np.log(-np.log(u3 * u4)), b


def signatures(bags: list[np.ndarray], samples: int = SAMPLES) -> np.ndarray:
    """One row of 32-bit samples per bag of word hashes; all ones if it is empty."""
    out = np.full((len(bags), samples), 0xFFFFFFFF, dtype=np.uint32)
    counted = [np.unique(bag, return_counts=True) for bag in bags]
    sizes = np.array([len(c[0]) for c in counted], dtype=np.int64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    terms, row = np.unique(np.concatenate([counted[i][0] for i in full]), return_inverse=True)
    weights = np.concatenate([counted[i][1] for i in full])
    heavy = np.flatnonzero(weights > 1)
    logs = np.log(weights[heavy]).astype(np.float32)[:, None]
    starts = np.cumsum(sizes[full]) - sizes[full]
    one = np.float32(1)
    width = max(1, min(_TOGETHER, _CELLS // len(row)))
    for low in range(0, samples, width):
        high = min(low + width, samples)
        r, c, b = _parameters(terms, range(low, high))
        scores = (c - r * ((np.float32(0) - b) + one))[row]
        r, c, b = r[row[heavy]], c[row[heavy]], b[row[heavy]]
        scores[heavy] = c - r * ((np.floor(logs / r + b) - b) + one)
        lowest = np.minimum.reduceat(scores, starts, axis=0)
        out[full, low:high] = lowest.view(np.uint32)
    return out


def likeness(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Share of equal samples, row by row."""
    return (one == two).mean(axis=1)


def fingerprint_hex(samples: np.ndarray) -> str:
    return samples.astype(">u4").tobytes().hex()


def fingerprint(docs: DataFrame, text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Add ``fingerprint`` to each row, replacing a column of that name.

    A null or empty text has the fingerprint of an empty bag, equal to no other.
    """

    @F.pandas_udf("string")
    def of_text(texts: pd.Series) -> pd.Series:
        bags: list[np.ndarray] = []
        for _, found in arrowwords.documents(pa.Array.from_pandas(texts, type=pa.string()), True):
            bags += found
        return pd.Series([fingerprint_hex(s) for s in signatures(bags, samples)], dtype="object")

    return docs.withColumn("fingerprint", of_text(F.col(text_col).cast("string")))


def _neighbour_bins(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows in bins of consecutive ids, each bin with the row that follows it.

    Bounds are at most ``MAX_BINS`` quantiles of the ids; the first id of each
    bin is gathered from the id column alone. The row after a bin's last one is
    copied to it with ``after`` true; the first of all follows the last.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(min(MAX_BINS, max(24, total // BIN_BYTES)))
    ids = docs.select(F.col("key").cast("double").alias("key"))
    cuts = ids.approxQuantile("key", [k / n for k in range(1, n)], 0.25 / n) if n > 1 else []
    bounds = np.array(sorted(set(cuts)), dtype=np.float64)

    @F.pandas_udf("long")
    def bin_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, keys.astype("float64"), side="right"))

    binned = docs.withColumn("bin", bin_of(F.col("key")))
    rows = docs.select("key").withColumn("bin", bin_of(F.col("key"))).groupBy("bin").agg(F.min("key").alias("first"))
    order = sorted((r["first"], r["bin"]) for r in rows.collect())  # one row per bin
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(
        (np.array([f for f, _ in order], dtype=np.int64), np.array([b for _, b in order], dtype=np.int64))
    )

    @F.pandas_udf("long")
    def bin_before(keys: pd.Series) -> pd.Series:
        """For the first id of a bin the bin before it (of the first bin: the last one)."""
        firsts, numbers = held.value
        own = keys.to_numpy(dtype=np.int64)
        at = np.minimum(np.searchsorted(firsts, own), len(firsts) - 1)
        return pd.Series(numbers[at - 1], dtype="Int64").where(firsts[at] == own)

    before = bin_before(F.col("key"))
    own = F.struct(F.col("bin").cast("long").alias("bin"), F.lit(False).alias("after"))
    copy = F.struct(F.col("before").alias("bin"), F.lit(True).alias("after"))
    places = F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, copy))
    rows = binned.select("doc_id", "key", "text", before.alias("before"), "bin")
    rows = rows.select("doc_id", "key", "text", F.explode(places).alias("at"))
    return rows.select("at.bin", "at.after", "key", "doc_id", "text"), max(1, len(order))


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def edited_fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text of ``docs(doc_id, text)`` and of its edit.

    An edit replaces the last quarter of a text by the first code points of the
    next one in ``doc_id`` order. Null texts are empty; null ids come first;
    equal ids are ordered by text; a lone row follows itself; an empty table
    gives no rows; other columns are not read.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("key"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    placed, bins = _neighbour_bins(rows)

    def finish(queue: list[tuple], ends: list[bool]) -> pa.RecordBatch:
        """Rows of ``queue`` whose successor is the entry after them."""
        texts = [text for _, text in queue]
        done = [k for k in range(len(queue) - 1) if not ends[k]]
        edits = []
        for k in done:
            cut = len(texts[k]) // 4
            edits.append(texts[k][: len(texts[k]) - cut] + texts[k + 1][:cut])
        bags: list[np.ndarray] = []
        for _, found in arrowwords.documents(pa.array(texts + edits, type=pa.large_string()), True):
            bags += found
        made = signatures(bags, samples)
        own, edited = made[: len(texts)], made[len(texts) :]
        at = np.array(done, dtype=np.int64)
        columns = [
            pa.array([queue[k][0] for k in done], type=pa.int64()),
            pa.array([len(texts[k]) for k in done], type=pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edits], type=pa.string()),
            pa.array([fingerprint_hex(own[k]) for k in done], type=pa.string()),
            pa.array([fingerprint_hex(e) for e in edited], type=pa.string()),
            pa.array(likeness(own[at], edited), type=pa.float64()),
            pa.array(likeness(own[at], own[at + 1]), type=pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue: list[tuple] = []  # a chain of successive rows; ends[k]: nothing follows queue[k]
        ends: list[bool] = []
        closed: int | None = None  # the bin whose following row has been met
        size = 0
        for batch in batches:
            for row in range(batch.num_rows):
                b, after, key, text = (batch.column(i)[row].as_py() for i in range(4))
                if closed == b:
                    continue  # a further row with the id that follows the bin
                queue.append((key, text))
                ends.append(after)
                size += len(text)
                if after:
                    closed = b
                if size > BLOCK_CHARS:
                    yield finish(queue, ends)
                    queue, ends = ([], []) if after else ([queue[-1]], [False])
                    size = len(queue[0][1]) if queue else 0
        if len(queue) > 1:
            yield finish(queue, ends)

    together = placed.repartition(bins, "bin").sortWithinPartitions("bin", "after", "key", "text")
    return together.select("bin", "after", "doc_id", "text").mapInArrow(run, SCHEMA)
