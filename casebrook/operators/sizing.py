"""Broadcasting a side of a join only after its size has been measured."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_ROWS = 1_000_000
MAX_BYTES = 32 << 20


def fits_broadcast(df: DataFrame) -> bool:
    """One distributed count: are rows and bytes within the bound?"""
    width = F.lit(0).cast("long")
    for field in df.schema:
        text = isinstance(field.dataType, T.StringType)
        width = width + (F.coalesce(F.octet_length(field.name), F.lit(0)) if text else 8)
    size = df.agg(
        F.count("*").alias("rows"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes")
    ).first()
    return size["rows"] <= MAX_ROWS and size["bytes"] <= MAX_BYTES
