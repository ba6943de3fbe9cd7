"""Rows picked by a long list of numbers, read where they lie.

The list becomes bitmaps, 4 KiB for 32,768 consecutive numbers, which Spark builds
by aggregation of the narrow list and broadcasts. Wide rows are tested in place and
never shuffled. Dense numbers cost a bit each. Bitmaps beyond the bound are dealt
to slices of consecutive numbers; every slice reads the rows of its range, which a
sorted table prunes to its own files.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebrook.operators import sizing
from casebrook.sources.storage import materialise

BITMAP_BYTES = 4096


def _bit(bits: Column, position: Column) -> Column:
    """Is this bit of a bitmap set? Bytes in order, the lowest bit of each first."""
    byte = F.substring(bits, F.floor(position / 8).cast("int") + 1, F.lit(1))
    value = F.conv(F.hex(byte), 16, 10).cast("int")
    return F.call_function("shiftright", value, F.pmod(position, F.lit(8)).cast("int")).bitwiseAND(F.lit(1)) == 1


def rows_with(rows: DataFrame, numbers: DataFrame, column: str, most_bytes: int | None = None) -> DataFrame:
    """``rows`` whose ``column`` (64-bit) is among ``numbers[column]``.

    NULL is never found. Repeated numbers count once, so rows are not multiplied.
    """
    most_bytes = sizing.MAX_BYTES if most_bytes is None else most_bytes
    number = F.col(column)
    bucket, position = F.bitmap_bucket_number(number), F.bitmap_bit_position(number)
    maps = numbers.filter(number.isNotNull()).select(bucket.alias("_bucket"), position.alias("_at"))
    maps = materialise(
        maps.groupBy("_bucket").agg(F.bitmap_construct_agg("_at").alias("_bits")), "bitmaps"
    )
    slices = math.ceil(2 * maps.count() * BITMAP_BYTES / max(1, most_bytes))
    cuts = []
    if slices > 2:
        found = maps.approxQuantile("_bucket", [k / slices for k in range(1, slices)], 0.25 / slices)
        cuts = sorted({int(c) for c in found})
    parts = []
    for low, high in zip([None, *cuts], [*cuts, None]):
        own, near = maps, rows
        if low is not None:
            own, near = own.filter(F.col("_bucket") > low), near.filter(bucket > low)
        if high is not None:
            own, near = own.filter(F.col("_bucket") <= high), near.filter(bucket <= high)
        met = near.withColumn("_bucket", bucket).join(F.broadcast(own), "_bucket")
        parts.append(met.filter(_bit(F.col("_bits"), position)).select(*rows.columns))
    return reduce(DataFrame.unionAll, parts)
