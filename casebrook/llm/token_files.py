"""Token counts of documents in flat token files that have no index.

A flat file is nothing but ids, each document ended by a separator id. It is
read in blocks: a block is a range of bytes, which a task reads from the shared
file system by itself, so a file may be of any size. Each task searches its blocks for the separator with one NumPy
comparison per block; a prefix scan over the blocks of a file (running sums and
a running maximum, as window functions over a few numbers per block) then gives
every block its offset, its first document number and where the document began
that runs into it. A document may span any number of blocks.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casebrook.llm import tokens
from casebrook.sources.storage import materialise

BLOCK_IDS = 1 << 20
SEPARATOR = 50256
BLOCKS = "file string, block long, ids binary, labels array<long>"
FILES = "file string, path string, length long, first_no long, labels array<long>"
TASK_BYTES = 64 << 20  # of raw files


def write_blocks(
    docs: DataFrame,
    path: str | None = None,
    pattern: str | None = None,
    separator: int = SEPARATOR,
    block_ids: int = BLOCK_IDS,
) -> DataFrame:
    """Tokenise ``docs(doc_id, text)`` into flat files of 16-bit ids, in blocks.

    Each task writes one file, its documents one after another without regard
    to block ends. ``labels`` names the documents that end in a block; the scan
    hands them on but never needs them. A null text is its separator alone.
    """
    path = path or tokens.vocabulary_path()
    pattern = pattern or tokens.vocabulary_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tokens.encoder(path, pattern)
        context = TaskContext.get()
        file = f"tokens-{context.partitionId() if context else 0:08d}"
        end = np.array([separator], dtype="<u2")
        held: list[np.ndarray] = []
        ends: list[int] = []
        labels: list[int | None] = []
        total = block = 0

        def emit(whole: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, ends, labels, total, block
            flat = np.concatenate(held)
            cuts = range(0, total, block_ids) if whole else range(0, total - block_ids + 1, block_ids)
            done = 0
            for low in cuts:
                high = min(low + block_ids, total)
                n = int(np.searchsorted(ends, high)) - done
                own, done = labels[done : done + n], done + n
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([file]),
                        pa.array([block], type=pa.int64()),
                        pa.array([flat[low:high].tobytes()], type=pa.binary()),
                        pa.array([own], type=pa.list_(pa.int64())),
                    ],
                    names=["file", "block", "ids", "labels"],
                )
                block += 1
            kept = min(len(cuts) * block_ids, total)
            held, labels = [flat[kept:]], labels[done:]
            ends, total = [e - kept for e in ends[done:]], total - kept

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held += [tokens.ids(encoding, text.as_py()).astype("<u2"), end]
                total += len(held[-2]) + 1
                ends.append(total - 1)
                labels.append(key)
                if total >= block_ids:
                    yield from emit(False)
        if total:
            yield from emit(True)

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(
        run, BLOCKS
    )


def _local(path: str) -> str | None:
    """The plain path of a file in a mounted file system, else nothing."""
    if path.startswith("file:"):
        return "/" + path[len("file:") :].lstrip("/")
    return None if "://" in path else path


def _to_write(path: str) -> BinaryIO:
    local = _local(path)
    if local is not None:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        return open(local, "wb")
    store, name = pyarrow.fs.FileSystem.from_uri(path)
    store.create_dir(os.path.dirname(name), recursive=True)
    return store.open_output_stream(name)


def _to_read(path: str) -> BinaryIO:
    local = _local(path)
    if local is not None:
        return open(local, "rb")
    store, name = pyarrow.fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def write_files(
    docs: DataFrame,
    folder: str,
    path: str | None = None,
    pattern: str | None = None,
    separator: int = SEPARATOR,
) -> DataFrame:
    """Tokenise ``docs(doc_id, text)`` into raw files of 16-bit ids in a shared folder.

    Each task writes one file when the result is computed, which should be once.
    A row is a file with its ``path`` and ``length`` in bytes, or the ``labels`` of
    its documents from number ``first_no`` on. A null text is its separator alone.
    """
    path = path or tokens.vocabulary_path()
    pattern = pattern or tokens.vocabulary_pattern()
    names = [f.split()[0] for f in FILES.split(", ")]
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def row(*values: object) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(values, types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tokens.encoder(path, pattern)
        context = TaskContext.get()
        file = f"tokens-{context.partitionId() if context else 0:08d}"
        target = f"{folder}/{file}-{uuid.uuid4().hex}.bin"  # each attempt has its own
        end = np.array([separator], dtype="<u2").tobytes()
        out = None
        length = number = 0
        try:
            for batch in batches:
                if batch.num_rows and out is None:
                    out = _to_write(target)
                for text in batch.column(1):
                    ids = tokens.ids(encoding, text.as_py()).astype("<u2").tobytes()
                    out.write(ids)
                    out.write(end)
                    length += len(ids) + len(end)
                yield row(file, None, None, number, batch.column(0).to_pylist())
                number += batch.num_rows
        finally:
            if out is not None:
                out.close()
        if out is not None:
            yield row(file, target, length, None, None)

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(
        run, FILES
    )


def read_ranges(files: DataFrame, block_ids: int = BLOCK_IDS, width: int = 2) -> DataFrame:
    """Blocks of the raw files ``file, path, length`` (ids of ``width`` bytes).

    Each task reads its own ranges of bytes, no more than one at a time; a file of
    another length than whole ids is an error.
    """
    step = block_ids * width
    total = files.agg(F.sum("length")).first()[0] or 0
    parts = max(files.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    ranges = (
        files.where("length > 0")
        .select("file", "path", "length", F.explode(F.sequence(F.lit(0), F.expr(f"(length - 1) div {step}"))).alias("block"))
        .repartition(int(min(parts, max(1, -(-total // step) + files.count()))))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, path, length, block in zip(*(c.to_pylist() for c in batch.columns)):
                if length % width:
                    raise ValueError(f"{file}: {length} bytes are not whole ids")
                wanted = min(step, length - block * step)
                with _to_read(path) as content:
                    content.seek(block * step)
                    part = content.read(wanted)
                if len(part) != wanted:
                    raise ValueError(f"{file}: shorter than it was listed")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([file]),
                        pa.array([block], type=pa.int64()),
                        pa.array([part], type=pa.binary()),
                        pa.array([None], type=pa.list_(pa.int64())),
                    ],
                    names=["file", "block", "ids", "labels"],
                )

    return ranges.mapInArrow(run, BLOCKS)


def read_blocks(spark: SparkSession, path: str, block_ids: int = BLOCK_IDS, width: int = 2) -> DataFrame:
    """Blocks of raw token files at ``path``; Spark only lists them with their sizes."""
    listed = spark.read.format("binaryFile").load(path)
    return read_ranges(listed.select(F.col("path").alias("file"), "path", "length"), block_ids, width)


def count_documents(docs: DataFrame, folder: str) -> DataFrame:
    """``doc_id, file, doc_no, start, n_tokens``, counted in raw files in ``folder``."""
    made = materialise(write_files(docs, folder), "token-files")
    counted = count_tokens(read_ranges(made.where("path is not null").select("file", "path", "length")))
    labels = made.where("path is null").select("file", "first_no", F.posexplode("labels").alias("k", "doc_id"))
    labels = labels.select("file", (F.col("first_no") + F.col("k")).alias("doc_no"), "doc_id")
    return counted.join(labels, ["file", "doc_no"], "left").select(
        "doc_id", "file", "doc_no", "start", "n_tokens"
    )


def count_tokens(blocks: DataFrame, separator: int = SEPARATOR, width: int = 2) -> DataFrame:
    """One row per document: ``file, doc_no, start, n_tokens, closed, label``.

    ``start`` is the document's first id in its file and ``n_tokens`` leaves the
    separator out. Ids after a file's last separator are a document with
    ``closed`` false; a file that ends in a separator has none. Empty files and
    tables give no rows; ``label`` is null where blocks carry none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found = [], []
            for content in batch.column(2):
                raw = content.as_buffer() if content.is_valid else pa.py_buffer(b"")
                ids = np.frombuffer(raw, dtype=f"<u{width}")
                sizes.append(len(ids))
                found.append(np.flatnonzero(ids == separator).astype(np.int64))
            counts = np.cumsum([0, *map(len, found)]).astype(np.int32)
            flat = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(sizes, type=pa.int64()),
                    pa.ListArray.from_arrays(pa.array(counts), pa.array(flat)),
                    batch.column(3),
                ],
                names=["file", "block", "n_ids", "ends", "labels"],
            )

    searched = blocks.select("file", "block", "ids", "labels").mapInArrow(
        run, "file string, block long, n_ids long, ends array<long>, labels array<long>"
    )
    ordered = W.partitionBy("file").orderBy("block")
    before = ordered.rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    n_ends = F.size("ends").cast("long")
    placed = searched.withColumns(
        {
            "base": F.coalesce(F.sum("n_ids").over(before), zero),
            "first_no": F.coalesce(F.sum(n_ends).over(before), zero),
            "is_last": F.lead("block").over(ordered).isNull(),
        }
    )
    # where the document began that runs into a block: after the last separator before it
    begun = F.when(n_ends > 0, F.col("base") + F.element_at("ends", -1) + 1)
    placed = placed.withColumn("after", begun).withColumn(
        "open_from", F.coalesce(F.max("after").over(before), zero)
    )
    closed = placed.select(
        "file",
        "base",
        "first_no",
        "open_from",
        "ends",
        "labels",
        F.posexplode("ends").alias("k", "end"),
    ).select(
        "file",
        (F.col("first_no") + F.col("k")).alias("doc_no"),
        F.when(F.col("k") == 0, F.col("open_from"))
        .otherwise(F.col("base") + F.get("ends", F.col("k") - 1) + 1)
        .alias("start"),
        (F.col("base") + F.col("end")).alias("stop"),
        F.lit(True).alias("closed"),
        F.get("labels", F.col("k")).alias("label"),
    )
    stop = F.col("base") + F.col("n_ids")
    rest = placed.where("is_last").select(
        "file",
        (F.col("first_no") + n_ends).alias("doc_no"),
        F.coalesce("after", "open_from").alias("start"),
        stop.alias("stop"),
        F.lit(False).alias("closed"),
        F.lit(None).cast("long").alias("label"),
    ).where("stop > start")
    return closed.unionByName(rest).select(
        "file", "doc_no", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), "closed", "label"
    )
