"""Intermediate tables in the shared folder that go when they are used up."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from casebrook.sources.storage import shared_dir


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written and read back, and where it lies."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/casebrook/{name}-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that no result reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def short_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs started inside send at most ``rows`` rows at a time to Python.

    Rows that hold a text or a whole set are kilobytes each: at the usual 10,000 a
    batch is tens of megabytes, held by the JVM, the socket and Python at once.
    """
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)
