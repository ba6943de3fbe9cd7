"""Reading the record table: one flattened text per record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casebrook.functions.text import or_no_content, reference_key
from casebrook.sources.storage import materialise


def quoted(*parts: str) -> str:
    """A catalog name from its parts, each safely quoted."""
    return ".".join("`" + part.replace("`", "``") + "`" for part in parts)


def read_records(spark: SparkSession, source: str, fmt: str | None = None) -> DataFrame:
    """A catalog table or view by name, or files of ``fmt`` by path.

    Nothing is selected here: ``documents`` names the columns it needs and the
    scan reads only those.
    """
    return spark.read.format(fmt).load(source) if fmt else spark.table(source)


def number_rows(df: DataFrame, ord_col: str = "doc_ord") -> DataFrame:
    """Give rows a stable, dense ordinal when the table has no ordering column.

    The numbers depend on how the scan was split, so rows are written with their
    split and place and read back; one count per split then makes them dense.
    """
    part, place = f"_part_{ord_col}", f"_place_{ord_col}"
    low = (1 << 33) - 1
    rows = materialise(
        df.withColumns(
            {
                part: F.spark_partition_id(),
                place: F.monotonically_increasing_id().bitwiseAND(F.lit(low)),
            }
        ),
        "rows",
    )
    counts = rows.groupBy(part).agg(F.count("*").alias("n"))
    before = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    numbered = rows.join(F.broadcast(offsets), part)  # one row per split of the scan
    return numbered.withColumn(ord_col, F.col("_offset") + F.col(place)).drop(part, place, "_offset")


def documents(
    records: DataFrame, text_col: str = "all_columns", ord_col: str = "doc_ord"
) -> DataFrame:
    """``(doc_ord, reference_number, doc_text)`` of every record.

    ``ord_col`` is any unique integer that gives the order of the records; it
    stands for the position in which a serial reader would meet them.
    """
    text = F.col(text_col)
    return records.select(
        F.col(ord_col).cast("long").alias("doc_ord"),
        reference_key(text).alias("reference_number"),
        or_no_content(text).alias("doc_text"),
    )
