"""Registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebrook.llm import (
    codebooks,
    fingerprints,
    host_rules,
    lines,
    lm,
    near_duplicates,
    packing,
    phrases,
    secrets,
    segmentation,
    site_templates,
    substrings,
    token_files,
)
from casebrook.sources.storage import shared_dir

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def op1_lm_scores(spark: SparkSession, sf: str) -> DataFrame:
    return lm.score_held_out(documents(spark, sf))


def op2_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.edited_fingerprints(documents(spark, sf))


def op3_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates.near_duplicates(documents(spark, sf))


def op4_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of every document, counted in flat files that know no documents."""
    folder = f"{shared_dir(spark)}/casebrook/raw-tokens-{uuid.uuid4().hex}"
    return token_files.count_documents(documents(spark, sf), folder)


def op5_line_spread(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of every document without those that many sources share."""
    report = lines.line_report(documents(spark, sf), F.col("source"))
    return report.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf))


def op7_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.scan_documents(documents(spark, sf))


def op8_host_rules(spark: SparkSession, sf: str) -> DataFrame:
    return host_rules.judged_documents(documents(spark, sf), F.col("source"))


def op9_substrings(spark: SparkSession, sf: str) -> DataFrame:
    return substrings.without_repeats(documents(spark, sf)).drop("kept_text")


def op10_segmentation(spark: SparkSession, sf: str) -> DataFrame:
    return segmentation.segment_documents(documents(spark, sf)).drop("ids")


def op11_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    return codebooks.compressed(spark.read.parquet(f"{sf}/embeddings.parquet"))


def op12_main_texts(spark: SparkSession, sf: str) -> DataFrame:
    return site_templates.main_texts(spark.read.parquet(f"{sf}/pages.parquet"))


def op13_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf))


QUERIES: dict[str, Query] = {
    "op1_lm_scores": op1_lm_scores,
    "op2_fingerprints": op2_fingerprints,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_token_counts": op4_token_counts,
    "op5_line_spread": op5_line_spread,
    "op6_packing": op6_packing,
    "op7_secrets": op7_secrets,
    "op8_host_rules": op8_host_rules,
    "op9_substrings": op9_substrings,
    "op10_segmentation": op10_segmentation,
    "op11_vector_codes": op11_vector_codes,
    "op12_main_texts": op12_main_texts,
    "op13_collocations": op13_collocations,
}
