"""Keys, lookups and counts over the document table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebrook.functions.text import fill_template
from casebrook.operators.fetch import rows_with
from casebrook.operators.sizing import fits_broadcast
from casebrook.sources.corpus import number_rows

NOT_FOUND = "Complaint {key} not found."  # fixed value


def distinct_keys(docs: DataFrame) -> DataFrame:
    """Each key once, with the ordinal at which it first appears.

    Hash-aggregated on two narrow columns; a key that holds a third of all
    rows is reduced to one row per input partition before the shuffle.
    """
    return docs.groupBy("reference_number").agg(
        F.min("doc_ord").alias("first_ord"), F.count("*").alias("n_documents")
    )


def first_keys(docs: DataFrame, n: int = 10) -> DataFrame:
    """The default test set: the first ``n`` keys, with their list position."""
    head = distinct_keys(docs).orderBy("first_ord").limit(n)
    packed = head.agg(
        F.array_sort(F.collect_list(F.struct("first_ord", "reference_number"))).alias("k")
    )
    return packed.select(F.posexplode("k").alias("position", "k")).select(
        F.col("position").cast("int").alias("position"), "k.reference_number"
    )


def key_positions(docs: DataFrame) -> DataFrame:
    """Every key with its place, from 0, in the order of first records."""
    ordered = distinct_keys(docs).orderBy("first_ord")
    return number_rows(ordered.select("reference_number"), "position").select(
        "position", "reference_number"
    )


def keys_in_order(spark, keys: list[str]) -> DataFrame:
    """A caller's list of keys with its positions, as a frame."""
    return spark.createDataFrame(
        list(enumerate(keys)), "position int, reference_number string"
    )


def _wanted(keys: DataFrame) -> DataFrame:
    return keys.select("reference_number").distinct()


def lookup_documents(docs: DataFrame, keys: DataFrame, in_place: bool | None = None) -> DataFrame:
    """The document of each wanted key: the first record that carries it.

    The winner of each key is found on narrow columns, and full texts are then
    picked out by the unique ordinal where they lie: no text is ever shuffled. A
    key list of checked size is broadcast; of a longer one (or with ``in_place``)
    the winners become bitmaps of ordinals.
    """
    wanted = _wanted(keys)
    narrow = docs.select("reference_number", "doc_ord")
    first = F.min("doc_ord").alias("doc_ord")
    if not in_place and fits_broadcast(wanted):
        kept = narrow.join(F.broadcast(wanted), "reference_number", "left_semi")
        # one row per wanted key: within the same bound
        winners = F.broadcast(kept.groupBy("reference_number").agg(first))
        texts = docs.select("doc_ord", "doc_text")
        found = texts.join(winners, "doc_ord")
    else:
        reduced = narrow.groupBy("reference_number").agg(first)
        winners = reduced.join(wanted, "reference_number", "left_semi")
        found = rows_with(docs, winners, "doc_ord")
    return found.select("reference_number", "doc_ord", "doc_text")


def split_known(keys: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Wanted keys that exist, and those that do not with the reason.

    The record table is reduced to distinct wanted keys before it meets the
    list, so a hot key costs one row per input partition.
    """
    wanted = _wanted(keys)
    names = docs.select("reference_number")
    if fits_broadcast(wanted):
        known = F.broadcast(
            names.join(F.broadcast(wanted), "reference_number", "left_semi").distinct()
        )
    else:
        known = names.distinct().join(wanted, "reference_number", "left_semi")
    found = keys.join(known, "reference_number", "left_semi")
    missing = keys.join(known, "reference_number", "left_anti").withColumn(
        "message", fill_template(NOT_FOUND, key=F.col("reference_number"))
    )
    return found, missing


def corpus_stats(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents, distinct keys, chunks and chunks per document in one row."""
    tagged = docs.select(
        "reference_number", F.lit(1).alias("doc"), F.lit(0).alias("chunk")
    ).unionByName(
        chunks.select(
            F.lit(None).cast("string").alias("reference_number"),
            F.lit(0).alias("doc"),
            F.lit(1).alias("chunk"),
        )
    )
    counts = tagged.groupBy("reference_number").agg(
        F.sum("doc").alias("doc"), F.sum("chunk").alias("chunk")
    )
    return counts.agg(
        F.coalesce(F.sum("doc"), F.lit(0)).alias("n_documents"),
        F.count("reference_number").alias("n_complaints"),
        F.coalesce(F.sum("chunk"), F.lit(0)).alias("n_chunks"),
        (F.try_divide(F.sum("chunk"), F.sum("doc"))).alias("chunks_per_document"),
    )
