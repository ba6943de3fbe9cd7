"""Counts of a corpus, kept per input partition and merged without its texts.

For each partition two small tables are kept: its keys, each once, and one row
with its numbers and a HyperLogLog sketch of its keys. Adding a partition reads
that partition; adding it again replaces it, whole or not at all. Totals come
from the rows alone (keys estimated by the merged sketches) or, exactly, from the
stored keys; either way no record is read again.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebrook.sources.commits import CommitLog

KEYS = "reference_number string, n_documents long, snapshot string, part string"
NUMBERS = "n_documents long, n_chunks long, keys binary, snapshot string, part string"
LOG_REGISTERS = 14  # a standard error of about 0.6 %
_TABLE = "counts"


class CountStore:
    """Counts per input partition below one root folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self.log = CommitLog(spark, self.root)

    def add(self, docs: DataFrame, chunks: DataFrame) -> list[str]:
        """Count ``docs(part, reference_number)`` and ``chunks(part)``; return the parts.

        Every part named in ``docs`` is replaced. Chunks of other parts, and rows
        whose part is null, are an error of the caller and refused.
        """
        snapshot = uuid.uuid4().hex
        keys = docs.groupBy("part", "reference_number").agg(F.count("*").alias("n_documents"))
        keys.write.partitionBy("part").parquet(f"{self.root}/keys/snapshot={snapshot}")
        own = self._read("keys", KEYS).filter(F.col("snapshot") == snapshot)
        records = own.select(
            "part", "reference_number", "n_documents", F.lit(0).cast("long").alias("n_chunks")
        ).unionByName(
            chunks.groupBy("part").agg(F.count("*").alias("n_chunks")),
            allowMissingColumns=True,
        )
        numbers = records.groupBy("part").agg(
            F.sum("n_documents").alias("n_documents"),
            F.sum("n_chunks").alias("n_chunks"),
            F.hll_sketch_agg("reference_number", LOG_REGISTERS).alias("keys"),
        )
        numbers.coalesce(1).write.parquet(f"{self.root}/numbers/snapshot={snapshot}")
        written = self.spark.read.parquet(f"{self.root}/numbers/snapshot={snapshot}")
        # one row a part
        found = written.select("part", "n_documents").collect()
        for row in found:
            if row["n_documents"] is None or not re.fullmatch(r"[\w-][\w.-]*", row["part"] or ""):
                raise ValueError(f"not a partition of the documents: {row['part']!r}")
        parts = sorted(row["part"] for row in found)
        if parts:
            self.log.commit(snapshot, {_TABLE: parts})
        return parts

    def remove(self, parts: list[str]) -> None:
        """Take partitions out of all counts."""
        self.log.commit(None, {_TABLE: parts})

    def _read(self, table: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{table}")

    def _current(self, table: str, schema: str) -> DataFrame:
        parts: dict[str, list[str]] = {}
        for (_, part), snapshot in self.log.current().items():
            parts.setdefault(snapshot, []).append(part)
        if not parts:
            return self.spark.createDataFrame([], schema)
        current = [
            (F.col("snapshot") == snapshot) & F.col("part").isin(names)
            for snapshot, names in sorted(parts.items())
        ]
        return self._read(table, schema).filter(reduce(or_, current))

    def per_part(self) -> DataFrame:
        """``part, n_documents, n_chunks, n_complaints`` with keys estimated."""
        return self._current("numbers", NUMBERS).select(
            "part",
            "n_documents",
            "n_chunks",
            F.hll_sketch_estimate("keys").alias("n_complaints"),
        )

    def totals(self, exact: bool = True) -> DataFrame:
        """One row as of ``corpus.corpus_stats``; without ``exact`` the number of
        different keys is estimated, and only one row per partition is read."""
        numbers = self._current("numbers", NUMBERS).select(
            "n_documents", "n_chunks", "keys", F.lit(None).cast("long").alias("one")
        )
        if exact:
            # distinct first: a key of many partitions counts once
            keys = self._current("keys", KEYS).select("reference_number").distinct()
            numbers = numbers.unionByName(
                keys.select(F.lit(1).cast("long").alias("one")), allowMissingColumns=True
            )
        different = (
            F.count("one") if exact else F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("keys")), F.lit(0))
        )
        return numbers.agg(
            F.coalesce(F.sum("n_documents"), F.lit(0)).alias("n_documents"),
            different.cast("long").alias("n_complaints"),
            F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("n_chunks"),
            F.try_divide(F.sum("n_chunks"), F.sum("n_documents")).alias("chunks_per_document"),
        )
