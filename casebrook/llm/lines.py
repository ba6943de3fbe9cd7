"""Removal of boilerplate lines, by the number of sites that have them.

Every line long enough to say something gets a HyperLogLog sketch of its sites,
merged by aggregation: tasks merge what they hold, so a line that stands in a
third of all rows is one sketch per task. Lines whose estimate is near the
threshold get an exact distinct count; for the others the estimate decides.

Lines of at least ``MIN_SITES`` sites are taken out of a document where they
make up no more than half of it. A document that mostly consists of such lines
is a copy, not a page with boilerplate, and is left whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebrook.llm.scratch import written
from casebrook.operators.sizing import MAX_BYTES, MAX_ROWS, fits_broadcast

MIN_SITES = 8
MIN_CHARS = 20
SKETCH_BITS = 12
_LOWEST = -(1 << 63)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if fits_broadcast(df) else df


def _lines(rows: DataFrame) -> DataFrame:
    """Lines of at least ``MIN_CHARS`` characters with a 128-bit hash."""
    lines = rows.select("key", "print", "site", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.where(F.length("line") >= MIN_CHARS).select(
        "key",
        "print",
        "site",
        "pos",
        F.length("line").alias("chars"),
        F.xxhash64("line").alias("one"),
        F.xxhash64("line", F.lit(1)).alias("two"),
    )


def widespread_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``one, two`` of the lines (``one, two, site``) that so many sites have."""
    low, high = 0.9 * min_sites - 1, 1.1 * min_sites + 1
    spread = (
        lines.where(F.col("site").isNotNull())
        .groupBy("one", "two")
        .agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(SKETCH_BITS))).alias("sites"))
        .where(F.col("sites") >= low)
    )
    spread, _ = written(spread, "line-spread")
    near = spread.where(F.col("sites") <= high).select("one", "two")
    exact = (
        lines.where(F.col("site").isNotNull())
        .join(_small(near), ["one", "two"], "left_semi")
        .groupBy("one", "two", "site")
        .agg(F.lit(1).alias("seen"))
        .groupBy("one", "two")
        .agg(F.count("*").alias("sites"))
        .where(F.col("sites") >= min_sites)
    )
    found = spread.where(F.col("sites") > high).select("one", "two").union(exact.select("one", "two"))
    return written(found, "widespread-lines")[0]


def _removed(rows: DataFrame, min_sites: int) -> DataFrame:
    """``rows`` with ``gone``: places of the lines to take out, null if none."""
    lines = _lines(rows)
    wide = _small(widespread_lines(lines, min_sites))
    hits = (
        lines.join(wide, ["one", "two"], "left_semi")
        .select("key", "print", "pos", "chars")
        .distinct()  # repeated rows are alike
        .groupBy("key", "print")
        .agg(F.collect_list("pos").alias("gone"), F.sum("chars").alias("chars"))
    )
    hits, _ = written(hits, "line-hits")
    size = hits.agg(F.count("*").alias("n"), F.sum(F.size("gone")).alias("places")).first()
    if size["n"] <= MAX_ROWS and 32 * size["n"] + 4 * (size["places"] or 0) <= MAX_BYTES:
        hits = F.broadcast(hits)
    joined = rows.join(hits, ["key", "print"], "left")
    some = 2 * F.col("chars") <= F.length("text")
    return joined.withColumn("gone", F.when(some, F.col("gone"))).drop("chars")


def _prepared(docs: DataFrame, site: Column, *more: Column) -> DataFrame:
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(
        F.coalesce(docs["doc_id"].cast("long"), F.lit(_LOWEST)).alias("key"),
        F.xxhash64(text).alias("print"),
        text.alias("text"),
        site.alias("site"),
        *more,
    )


def _left(gone: Column) -> Column:
    """The text without the lines at these places."""
    kept = F.filter(F.split("text", "\n"), lambda s, i: ~F.array_contains(gone, i))
    return F.when(gone.isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))


def line_report(docs: DataFrame, site: Column, min_sites: int = MIN_SITES) -> DataFrame:
    """``doc_id, n_lines, n_removed, kept_text`` of each row of ``docs(doc_id, text)``.

    A null text is one empty line; rows without a site count for none but lose
    lines like others; repeated rows are reported each; an empty table gives no
    rows; other columns are not read.
    """
    rows = _removed(_prepared(docs, site, docs["doc_id"].cast("long").alias("doc_id")), min_sites)
    return rows.select(
        "doc_id",
        F.size(F.split("text", "\n")).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        _left(F.col("gone")).alias("kept_text"),
    )


def without_boilerplate(docs: DataFrame, site: Column, min_sites: int = MIN_SITES) -> DataFrame:
    """All rows and columns of ``docs``, boilerplate lines taken out of ``text``.

    Texts that lose nothing, null ones among them, are unchanged to the byte.
    ``n_chars``, where present, is the length of the new text.
    """
    row = F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row")
    rows = _removed(_prepared(docs, site, row), min_sites)
    lost = F.col("gone").isNotNull()
    rows = rows.withColumn("new", F.when(lost, _left(F.col("gone"))))
    out = []
    for name in docs.columns:
        old = F.col(f"row.`{name}`")
        if name == "text":
            old = F.when(lost, F.col("new")).otherwise(old)
        elif name == "n_chars":
            old = F.when(lost, F.length("new").cast(docs.schema[name].dataType)).otherwise(old)
        out.append(old.alias(name))
    return rows.select(*out)
