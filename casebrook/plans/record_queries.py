"""Registered queries of what is recorded: calls, replaced runs, any keys, and
the contents of an experiment's tables; with their SQL in ``record_oracles``."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebrook.functions.text import or_no_content, reference_key
from casebrook.operators import corpus, reports
from casebrook.operators.chunking import chunk_documents
from casebrook.operators.experiment import run_experiment
from casebrook.plans import fixtures as fx
from casebrook.plans.stand_ins import answer
from casebrook.schemas import METRICS
from casebrook.sources.corpus import documents, read_records
from casebrook.sources.counts import CountStore
from casebrook.sources.inference import complete
from casebrook.sources.ledger import AnswerLedger, request_of
from casebrook.sources.run_source import FORMAT, register
from casebrook.sources.runs import (
    AVERAGE_KEYS,
    PARAM_KEYS,
    RunStore,
    all_keys,
    wide_runs,
    without_items,
)
from casebrook.sources.storage import materialise, shared_dir
from casebrook.streaming.keys import read_keys, start_key_ingest

REQUEST = {"endpoint": "writer-one", "temperature": 0.15, "max_tokens": 1800}


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/casebrook/{name}-{uuid.uuid4().hex}"


# ------------------------------------------------------------------ records


def null_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Keys and texts of records of which some have no text at all."""
    return documents(fx.null_complaints(spark, sf))


def catalog_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records read from the catalog by name, counted by key."""
    name = f"records_{uuid.uuid4().hex}"
    fx.complaints(spark, sf).createOrReplaceTempView(name)
    return corpus.distinct_keys(documents(read_records(spark, name)))


def list_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Every key with its place, from 0, in the list of keys by first record."""
    docs = fx.complaint_documents(spark, sf)
    keys = corpus.key_positions(docs)
    return keys.withColumn("position", F.col("position").cast("long"))


def lookup_in_place(spark: SparkSession, sf: str) -> DataFrame:
    """The first document of every key, picked out by bitmaps of ordinals."""
    docs = fx.complaint_documents(spark, sf)
    return corpus.lookup_documents(docs, docs, in_place=True)


def streamed_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Every key with its first record, kept by a stream over several
    micro-batches that do not follow the order of the records."""
    records = fx.complaints(spark, sf)
    source, sink, progress = (_folder(spark, n) for n in ("arrivals", "keys", "progress"))
    records.repartition(4).write.parquet(source)
    stream = spark.readStream.schema(records.schema).option("maxFilesPerTrigger", 1).parquet(source)
    start_key_ingest(stream, sink, progress).awaitTermination()
    return read_keys(spark, sink)


def merged_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts kept per source, one source counted again later, merged from the store."""
    rows = fx.document_table(spark, sf).withColumn("all_columns", F.expr(fx.COMPLAINT_TEXT))
    store = CountStore(spark, _folder(spark, "counts"))
    for some in (rows, rows.where("source = 'src3'")):
        docs = some.select(
            F.col("source").alias("part"), "doc_id", reference_key(F.col("all_columns")).alias("reference_number")
        )
        # chunks carry a key: here that of their part
        texts = some.select(
            F.col("doc_id").alias("doc_ord"),
            F.col("source").alias("reference_number"),
            or_no_content(F.col("all_columns")).alias("doc_text"),
        )
        chunks = chunk_documents(texts, preserve_sections=False)
        store.add(docs, chunks.select(F.col("reference_number").alias("part")))
    return store.totals().withColumn("chunks_per_document", F.round("chunks_per_document", 6))


# -------------------------------------------------------------------- calls


def busy_at_times(requests: Sequence[dict]) -> list:
    """Answers, but for prompts of every seventh length."""
    return [
        RuntimeError("busy") if len(r["prompt"]) % 7 == 0 else a for r, a in zip(requests, answer(requests))
    ]


def resumed_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Calls made twice: the second pass asks only what the first left open."""
    rows = fx.document_table(spark, sf).select(
        "doc_id", F.col("text").alias("prompt"), *[F.lit(v).alias(k) for k, v in REQUEST.items()]
    )
    request = request_of(*(F.col(c) for c in ("prompt", *REQUEST))).alias("request")
    ledger = AnswerLedger(spark, _folder(spark, "ledger"))
    first = materialise(complete(rows, busy_at_times, 16, ledger=ledger), "first-pass")
    second = materialise(complete(rows, answer, 16, ledger=ledger), "second-pass")
    calls = ledger.entries().groupBy("request").agg(F.count("*").alias("calls"))
    return (
        rows.select("doc_id", request)
        .join(calls, "request")
        .join(first.select("doc_id", F.col("error").alias("first_error")), "doc_id")
        .join(second.select("doc_id", "response", "error"), "doc_id")
        .select("doc_id", "calls", "first_error", "response", "error")
    )


# --------------------------------------------------------------------- runs


def _counts(spark: SparkSession, sf: str, more: int) -> DataFrame:
    """``run_metrics`` rows: how many documents every language has, as a run."""
    return fx.document_table(spark, sf).groupBy(F.col("lang").alias("run_id")).agg(
        (F.count("*") + more).cast("double").alias("value")
    ).select("run_id", F.lit("n_documents").alias("key"), "value")


def replaced_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs written, some replaced, one cleared, and a writer that dies half-way."""
    store = RunStore(spark, _folder(spark, "runs"))
    store.write("run_metrics", _counts(spark, sf, 0))
    with store.replacing(["en", "fr"]) as snapshot:
        snapshot.write("run_metrics", _counts(spark, sf, 1000).filter("run_id = 'en'"))
    store.clear(["es"])
    try:
        with store.replacing(["de", "en"]) as snapshot:
            snapshot.write("run_metrics", _counts(spark, sf, 5).filter("run_id IN ('de', 'en')"))
            raise ConnectionError("lost")
    except ConnectionError:
        pass
    store.vacuum()
    return store.read("run_metrics")


def runs_by_source(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs, one of them replaced, read through the data source."""
    root = _folder(spark, "runs")
    store = RunStore(spark, root)
    store.write("run_metrics", _counts(spark, sf, 0))
    store.write("run_metrics", _counts(spark, sf, 1000).filter("run_id = 'en'"))
    register(spark)
    rows = spark.read.format(FORMAT).option("table", "run_metrics").load(root)
    return rows.filter("run_id IN ('en', 'fr') AND key = 'n_documents'")


def runs_any_key(spark: SparkSession, sf: str) -> DataFrame:
    """Runs with every parameter and average recorded, whatever its name."""
    made = fx.run_summaries(spark, sf).groupBy("run_id")
    longest = made.agg(F.max("summary_length").cast("double").alias("value"))
    items = made.agg(F.lit(1.0).alias("value")).withColumn("key", F.lit("accuracy_12"))
    metrics = longest.withColumn("key", F.lit("max_summary_length")).unionByName(items)
    seeds = fx.run_list(spark).select("run_id", F.lit("seed").alias("key"), F.concat(F.lit("s-"), "run_id").alias("value"))
    params = fx.run_params(spark).unionByName(seeds)
    whole = without_items(metrics)
    wide = wide_runs(
        fx.run_list(spark), params, whole, all_keys(params, PARAM_KEYS), all_keys(whole, AVERAGE_KEYS)
    )
    return reports.strip_prefixes(wide).select("run_id", "llm_name", "temperature", "seed", "max_summary_length")


def missing_experiment(spark: SparkSession, sf: str) -> DataFrame:
    """An experiment nobody recorded: no rows, and all columns, beside one that is."""
    store = RunStore(spark, _folder(spark, "runs"))
    store.write("runs", fx.run_list(spark))
    counted = lambda name: store.wide_runs(name).agg(
        F.lit(name).alias("experiment"),
        F.count("*").alias("n_runs"),
        F.count("`metrics.avg_accuracy`").alias("n_judged"),
    )
    return counted(fx.EXPERIMENT).unionByName(counted("no such experiment"))


# --------------------------------------------------------------- experiment

CONFIGS = {
    "plain": {"endpoint": "writer-one", "temperature": 0.15, "max_tokens": 1800},
    "brief": {"endpoint": "writer-no-three", "temperature": 0.45, "max_tokens": 700},
}
PANEL = {"first": "grader-a", "second": "grader-bb"}


def faulty(requests: Sequence[dict]) -> list:
    """Writers fail on every fifth prompt length, the first grader on every ninth."""
    out = []
    for r, a in zip(requests, answer(requests)):
        size, endpoint = len(r["prompt"]), r["endpoint"]
        bad = size % 5 == 0 if endpoint.startswith("writer") else size % 9 == 0 and endpoint == "grader-a"
        out.append(TimeoutError(f"{endpoint} at {size}") if bad else a)
    return out


def _recorded(spark: SparkSession, sf: str, judges: dict[str, str] | str) -> RunStore:
    """An experiment over every label's record, one key twice, one unknown."""
    docs = materialise(fx.complaint_documents(spark, sf), "documents")
    chunks = fx.complaint_chunks(spark, sf)
    keys = fx.experiment_keys(spark, sf)
    store = RunStore(spark, _folder(spark, "runs"))
    run_experiment(
        store, "labelled", docs, chunks, CONFIGS, judges, faulty,
        test_keys=keys, started_at=datetime(2024, 6, 1, 8, 0, 0), call_batch=16,
    )
    return store


def _named(store: RunStore, table: str) -> DataFrame:
    names = store.read("run_params").filter("key = 'llm_name'").select("run_id", F.col("value").alias("llm_name"))
    return store.read(table).join(F.broadcast(names), "run_id").drop("run_id")


def experiment_params(spark: SparkSession, sf: str) -> DataFrame:
    return _named(_recorded(spark, sf, PANEL), "run_params")


def experiment_failures(spark: SparkSession, sf: str) -> DataFrame:
    """Every record of a run without a whole evaluation, and why."""
    return _named(_recorded(spark, sf, PANEL), "failures")


def experiment_evaluations(spark: SparkSession, sf: str) -> DataFrame:
    """Stored evaluations, read back from the CSV that was exported of each run."""
    store = _recorded(spark, sf, PANEL)
    parts = []
    for row in store.read("run_params").filter("key = 'llm_name'").sort("value").collect():
        path = _folder(spark, "csv")
        store.export_csv("evaluations", row["run_id"], path)
        back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
        parts.append(back.withColumn("llm_name", F.lit(row["value"])))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    number = lambda name: F.round(F.col(name).cast("double"), 6).alias(name)
    return rows.select(
        "llm_name",
        "complaint_id",
        *[number(m) for m in METRICS],
        number("overall_score_std"),
        number("judge_agreement"),
        F.col("num_judges").cast("long").alias("num_judges"),
        F.col("n_failed_judges").cast("long").alias("n_failed_judges"),
        F.get_json_object("individual_judge_scores", "$.second.clarity").cast("double").alias("second_clarity"),
        F.get_json_object("overall_assessments", "$.first").alias("first_assessment"),
    )


def single_judge(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of an experiment with one judge, items at their list positions."""
    metrics = _named(_recorded(spark, sf, "grader-a"), "run_metrics")
    return metrics.withColumn("value", F.round("value", 6))


QUERIES = {
    f.__name__: f
    for f in (
        null_texts,
        catalog_records,
        list_positions,
        lookup_in_place,
        streamed_keys,
        merged_counts,
        resumed_answers,
        replaced_runs,
        runs_by_source,
        runs_any_key,
        missing_experiment,
        experiment_params,
        experiment_failures,
        experiment_evaluations,
        single_judge,
    )
}
