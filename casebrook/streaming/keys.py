"""First record and number of records of each key, on a stream of records.

Records are reduced to one row per key inside every Arrow batch, so a key that
holds a third of all rows sends a few rows to its state and not all of them. The
state of a key is two numbers. After each micro-batch a key that came in it gets
one row with its totals so far, appended to parquet files; ``read_keys`` takes
the last of them.

There is no watermark: no record is too late. One that arrives late with a
smaller ordinal becomes the first of its key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from casebrook.sources.corpus import documents

KEYS = "reference_number string, first_ord long, n_documents long"
_STATE = "first_ord long, n_documents long"


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per key of each batch."""
    for batch in batches:
        table = pa.Table.from_batches([batch]).group_by("reference_number")
        totals = table.aggregate([("doc_ord", "min"), ("doc_ord", "count")])
        totals = totals.select(["reference_number", "doc_ord_min", "doc_ord_count"])
        yield from totals.rename_columns(["reference_number", "first_ord", "n_documents"]).to_batches()


def _add_up(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    first, count = state.get if state.exists else (None, 0)
    known = state.exists
    for part in parts:
        # plain numbers: a key is a few rows, and pandas costs more than the sums
        low = int(part["first_ord"].to_numpy().min())
        first = low if first is None else min(first, low)
        count += int(part["n_documents"].to_numpy().sum())
        alone = part if not known and len(part) == 1 else None
        known = True
    state.update((first, count))
    if alone is not None:
        yield alone  # a new key's one row is its totals
    else:
        yield pd.DataFrame({"reference_number": [key[0]], "first_ord": [first], "n_documents": [count]})


def key_stream(records: DataFrame) -> DataFrame:
    """Totals so far of each key that a micro-batch brings, one row a key.

    ``records`` has ``all_columns`` and a unique ``doc_ord`` that is not null.
    """
    narrow = documents(records).select("reference_number", "doc_ord")
    return (
        narrow.mapInArrow(_combine, KEYS)
        .groupBy("reference_number")
        .applyInPandasWithState(_add_up, KEYS, _STATE, "append", GroupStateTimeout.NoTimeout)
    )


def start_key_ingest(records: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Add all records now available to the keys in ``sink``, each record once.

    The sink's own log makes a repeated micro-batch replace its first attempt, so
    a stream that was stopped goes on from its checkpoint without counting twice.
    """
    return (
        key_stream(records)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(sink)
    )


def read_keys(spark: SparkSession, sink: str) -> DataFrame:
    """Each key once, as ``corpus.distinct_keys`` of all records so far.

    Totals only move one way, so the least ordinal and the greatest count are
    those of the last row, in whatever order files are read.
    """
    rows = spark.read.schema(KEYS).parquet(sink)
    return rows.groupBy("reference_number").agg(
        F.min("first_ord").alias("first_ord"), F.max("n_documents").alias("n_documents")
    )
