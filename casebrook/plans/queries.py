"""The registered queries: operators applied to the given tables.

Numbers are rounded and timestamps shown as text, so that results compare
across engines; nothing else is done to the operators' output.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casebrook.functions.vectors import dimension, l2_norm, l2_normalise
from casebrook.operators import corpus, judging, neighbours, prompts, reports, signatures
from casebrook.operators.chunking import chunk_documents, chunk_id
from casebrook.operators.experiment import run_experiment
from casebrook.plans import fixtures as fx
from casebrook.plans.stand_ins import answer, letter_counts
from casebrook.schemas import METRICS
from casebrook.sources.inference import (
    COMPLETE_FAILED,
    content_of_response,
    embeddings_of_response,
    failure_text,
)
from casebrook.sources.runs import (
    AVERAGE_KEYS,
    RunStore,
    average_metrics,
    item_metric_rows,
    to_metric_rows,
    wide_runs,
)
from casebrook.sources.storage import materialise, shared_dir

Query = Callable[[SparkSession, str], DataFrame]

CONFIGS = {
    "plain": {"endpoint": "writer-one", "temperature": 0.15, "max_tokens": 1800},
    "vivid": {"endpoint": "writer-second", "temperature": 0.95, "max_tokens": 2600},
    "brief": {"endpoint": "writer-no-three", "temperature": 0.45, "max_tokens": 700},
}
PANEL = {"first": "grader-a", "second": "grader-bb", "third": "grader-cccc"}


def _r(name: str, digits: int = 6) -> Column:
    return F.round(F.col(name), digits).alias(name)


# ------------------------------------------------------------------- corpus


def extract_keys(spark: SparkSession, sf: str) -> DataFrame:
    return fx.complaint_documents(spark, sf)


def distinct_keys(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.distinct_keys(fx.complaint_documents(spark, sf))


def first_keys(spark: SparkSession, sf: str) -> DataFrame:
    keys = corpus.first_keys(fx.complaint_documents(spark, sf))
    return keys.withColumn("position", F.col("position").cast("long"))


def known_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Wanted keys (one per label row), found or rejected with a message."""
    docs = fx.complaint_documents(spark, sf)
    wanted = fx.table(spark, sf, "labels").select(
        F.expr(f"concat('DOC-', {fx.PADDED_ID})").alias("reference_number")
    )
    found, missing = corpus.split_known(wanted, docs)
    return found.withColumn("message", F.lit("")).unionByName(missing)


def lookup_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = fx.complaint_documents(spark, sf)
    return corpus.lookup_documents(docs, docs)


def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    docs = fx.complaint_documents(spark, sf)
    stats = corpus.corpus_stats(docs, chunk_documents(docs, preserve_sections=False))
    return stats.withColumn("chunks_per_document", F.round("chunks_per_document", 6))


# ----------------------------------------------------------------- chunking


def _plain_documents(spark: SparkSession, sf: str, text: str) -> DataFrame:
    return fx.document_table(spark, sf).select(
        F.col("doc_id").alias("doc_ord"),
        F.col("source").alias("reference_number"),
        F.expr(text).alias("doc_text"),
    )


def _chunk_columns(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        "doc_ord",
        F.col("chunk_ord").cast("long").alias("chunk_ord"),
        "section",
        "chunk_index",
        "total_chunks",
        "chunk_text",
    )


def chunks_whole(spark: SparkSession, sf: str) -> DataFrame:
    docs = _plain_documents(spark, sf, "text")
    return _chunk_columns(chunk_documents(docs, preserve_sections=False))


def chunks_sections(spark: SparkSession, sf: str) -> DataFrame:
    return _chunk_columns(chunk_documents(_plain_documents(spark, sf, fx.SECTION_TEXT)))


def chunks_literal(spark: SparkSession, sf: str) -> DataFrame:
    docs = _plain_documents(spark, sf, fx.LITERAL_TEXT)
    return _chunk_columns(chunk_documents(docs, literal=True))


# ---------------------------------------------------------- vectors, search


def normalise(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of many lengths (zero among them) brought to unit length."""
    scaled = fx.table(spark, sf, "embeddings").select(
        "vec_id",
        F.transform("embedding", lambda x: (x * F.col("label")).cast("float")).alias("v"),
    )
    unit = scaled.select(
        "vec_id", F.posexplode(l2_normalise(F.col("v"))).alias("pos", "value")
    )
    return unit.select(
        "vec_id",
        F.col("pos").cast("long").alias("pos"),
        F.round(F.col("value").cast("double"), 5).alias("value"),
    )


def seeds(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.seed_vectors(fx.vector_chunks(spark, sf)).select(
        "query_id", "seed_chunk_id"
    )


def attached_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks joined with a vector table that covers the first chunk of some
    documents."""
    chunks = chunk_documents(_plain_documents(spark, sf, "text"))
    vectors = fx.table(spark, sf, "embeddings").select(
        chunk_id(F.col("vec_id"), F.lit(0)).alias("chunk_id"), "embedding"
    )
    joined = neighbours.attach_vectors(chunks, vectors)
    return joined.select(
        "chunk_id",
        F.when(F.col("embedding").isNotNull(), dimension(F.col("embedding")))
        .cast("long")
        .alias("dimension"),
        F.round(l2_norm(F.col("embedding")), 5).alias("norm"),
    )


def embedding_responses(spark: SparkSession, sf: str) -> DataFrame:
    """The given vectors as service answers of three shapes, read back."""
    rows = fx.table(spark, sf, "embeddings").select(
        "vec_id", F.expr(fx.EMBEDDING_RESPONSE).alias("response")
    )
    vectors = rows.select(
        "vec_id", embeddings_of_response(F.col("response"))[0].alias("v")
    )
    return vectors.select(
        "vec_id", F.posexplode("v").alias("pos", "value")
    ).select(
        "vec_id",
        F.col("pos").cast("long").alias("pos"),
        F.round(F.col("value").cast("double"), 5).alias("value"),
    )


def completion_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation turn as a chat answer, and as an error body."""
    rows = fx.table(spark, sf, "conversations")
    message = F.struct(F.struct("role", F.col("text").alias("content")).alias("message"))
    answers = rows.withColumn("response", F.to_json(F.struct(F.array(message).alias("choices"))))
    return answers.select(
        "conv_id",
        "turn",
        content_of_response(F.col("response")).alias("content"),
        failure_text(COMPLETE_FAILED, F.col("text")).alias("failure"),
    )


def _hit_columns(hits: DataFrame) -> DataFrame:
    return hits.select(
        "query_id",
        F.col("rank").cast("long").alias("rank"),
        "reference_number",
        "chunk_id",
        "score",
        "text",
        "meta.chunk_index",
    )


def topk_chunks(spark: SparkSession, sf: str) -> DataFrame:
    chunks = fx.vector_chunks(spark, sf)
    return _hit_columns(
        neighbours.similar_chunks(neighbours.seed_vectors(chunks), chunks, k=10)
    )


def _label_documents(spark: SparkSession, sf: str) -> DataFrame:
    """All documents under two keys (by the length of the source's name), so
    that most labels have no document and a key is carried by many records."""
    return fx.table(spark, sf, "documents").select(
        F.col("doc_id").alias("doc_ord"),
        F.concat(F.lit("L"), F.length("source").cast("string")).alias("reference_number"),
        F.col("text").alias("doc_text"),
    )


def topk_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents; labels without a document fall back to the chunk."""
    chunks = fx.vector_chunks(spark, sf)
    docs = _label_documents(spark, sf)
    return _hit_columns(
        neighbours.similar_chunks(neighbours.seed_vectors(chunks), chunks, k=4, docs=docs)
    )


def topk_overfetch(spark: SparkSession, sf: str) -> DataFrame:
    """Ranked first and filtered afterwards; fewer than ``k`` may remain."""
    chunks = fx.vector_chunks(spark, sf)
    hits = neighbours.similar_chunks(
        neighbours.seed_vectors(chunks),
        chunks,
        k=4,
        docs=_label_documents(spark, sf),
        overfetch=neighbours.usual_overfetch(),
    )
    return _hit_columns(hits)


def copied_chunks(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk ids of records whose text also occurs in an earlier record."""
    first = docs.groupBy(F.sha2("doc_text", 256).alias("h")).agg(F.min("doc_ord").alias("first"))
    later = (
        docs.select("doc_ord", F.sha2("doc_text", 256).alias("h"))
        .join(first, "h")
        .filter("doc_ord > first")
    )
    return chunks.join(later.select("doc_ord"), "doc_ord", "left_semi").select("chunk_id")


def topk_without_copies(spark: SparkSession, sf: str) -> DataFrame:
    """Every record against all chunks, chunks of exact copies barred."""
    chunks = fx.complaint_chunks(spark, sf)
    raw = fx.table(spark, sf, "documents").select(
        F.col("doc_id").alias("doc_ord"), F.col("text").alias("doc_text")
    )
    hits = neighbours.similar_chunks(
        neighbours.seed_vectors(chunks), chunks, k=5, duplicates=copied_chunks(raw, chunks)
    )
    return hits.select(
        "query_id",
        F.col("rank").cast("long").alias("rank"),
        "reference_number",
        "chunk_id",
        "score",
        "text",
    )


def _as_queries(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        F.col("chunk_id").cast("string").alias("query_id"),
        F.col("reference_number").alias("own_key"),
        F.col("embedding").alias("query_vector"),
    )


def _routed_hits(chunks: DataFrame) -> DataFrame:
    """Many cells, and tiles far smaller than the larger ones of them."""
    hits = neighbours.search(
        _as_queries(chunks),
        chunks,
        k=5,
        route="routed",
        n_pivots=48,
        tile_chunks=32,
        tile_queries=128,
    )
    return hits.select(
        "query_id",
        F.col("rank").cast("long").alias("rank"),
        "reference_number",
        "chunk_id",
        "score",
    )


def topk_routed(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector as a query, through the route for large query sets."""
    return _routed_hits(fx.vector_chunks(spark, sf))


def topk_any_length(spark: SparkSession, sf: str) -> DataFrame:
    """The same for vectors of very different lengths, zeros among them."""
    return _routed_hits(materialise(fx.scaled_chunks(spark, sf), "scaled-chunks"))


def topk_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours that the approximate route finds of those of the exact one."""
    chunks = materialise(fx.vector_chunks(spark, sf), "chunks")
    queries = _as_queries(chunks)
    exact = neighbours.search(queries, chunks, k=5, route="routed")
    found = neighbours.search(queries, chunks, k=5, route="approximate")
    counts = signatures.recall(found, exact)
    return counts.select("n_exact", (10 * F.col("n_found") >= 9 * F.col("n_exact")).alias("reached"))


def topk_free_text(spark: SparkSession, sf: str) -> DataFrame:
    """Search by text: each benchmark passage is embedded and looked up."""
    chunks = fx.complaint_chunks(spark, sf)
    asked = fx.table(spark, sf, "benchmark").select(
        F.col("item_id").cast("string").alias("query_id"),
        F.lit(None).cast("string").alias("own_key"),
        F.col("text").alias("query_text"),
    )
    queries = neighbours.text_queries(asked, letter_counts)
    hits = neighbours.similar_chunks(queries, chunks, k=3)
    return hits.select(
        "query_id",
        F.col("rank").cast("long").alias("rank"),
        "reference_number",
        "chunk_id",
        "score",
    )


# ------------------------------------------------------- prompts, summaries


def summary_prompts(spark: SparkSession, sf: str) -> DataFrame:
    docs = materialise(fx.complaint_documents(spark, sf), "documents")
    chunks = fx.complaint_chunks(spark, sf)
    return prompts.retrieval_prompts(docs, docs, chunks, neighbours.seed_vectors(chunks))


def summaries(spark: SparkSession, sf: str) -> DataFrame:
    docs = materialise(fx.complaint_documents(spark, sf), "documents")
    chunks = fx.complaint_chunks(spark, sf)
    wanted = fx.table(spark, sf, "labels").select(
        F.expr(f"concat('DOC-', {fx.PADDED_ID})").alias("reference_number")
    )
    return prompts.summarise(
        wanted,
        docs,
        chunks,
        neighbours.seed_vectors(chunks, wanted),
        answer,
        endpoint="writer-one",
    ).select("reference_number", "summary")


# ------------------------------------------------------------------ judging


def _verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return judging.parse_verdicts(fx.verdict_answers(spark, sf))


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return _verdicts(spark, sf).select(
        "run_id", "complaint_id", "judge", *METRICS, "overall_assessment", "failed"
    ).withColumn("failed", F.col("failed").cast("int"))


def single_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    answers = fx.verdict_answers(spark, sf)
    rows = judging.single_verdicts(answers)
    return rows.select(
        "run_id", "complaint_id", "judge", *METRICS, "overall_assessment", "raw_response"
    )


def _evaluations(spark: SparkSession, sf: str) -> DataFrame:
    return judging.panel(_verdicts(spark, sf), ["run_id", "complaint_id"])


def panel(spark: SparkSession, sf: str) -> DataFrame:
    rows = _evaluations(spark, sf)
    return rows.select(
        "run_id",
        "complaint_id",
        *[_r(name) for name in METRICS],
        *[_r(f"{name}_std") for name in METRICS],
        *[F.col(f"{name}_range.min").alias(f"{name}_min") for name in METRICS],
        *[F.col(f"{name}_range.max").alias(f"{name}_max") for name in METRICS],
        "num_judges",
        "n_failed_judges",
        _r("judge_agreement"),
        "overall_assessment",
    )


def panel_texts(spark: SparkSession, sf: str) -> DataFrame:
    rows = _evaluations(spark, sf).withColumn(
        "all_texts",
        F.map_concat(
            "reasoning_by_judge",
            F.create_map(F.lit("overall_assessment"), F.col("overall_assessments")),
        ),
    )
    by_topic = rows.select(
        "run_id", "complaint_id", F.explode("all_texts").alias("topic", "by_judge")
    )
    return by_topic.select(
        "run_id", "complaint_id", "topic", F.explode("by_judge").alias("judge", "text")
    )


def _breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return judging.judge_breakdown(_evaluations(spark, sf), ["run_id", "complaint_id"])


def judge_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return _breakdown(spark, sf)


# --------------------------------------------------------------------- runs


def _metric_rows(
    spark: SparkSession, sf: str, evaluations: DataFrame | None = None
) -> DataFrame:
    if evaluations is None:
        evaluations = _evaluations(spark, sf)
    averages = average_metrics(evaluations, fx.run_summaries(spark, sf))
    return to_metric_rows(averages, AVERAGE_KEYS)


def run_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _metric_rows(spark, sf).withColumn("value", F.round("value", 6))


def item_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Per-record metrics, numbered by the record's place in the test list."""
    positions = fx.table(spark, sf, "documents").select(
        F.expr(f"concat('DOC-', {fx.PADDED_ID})").alias("complaint_id"),
        F.col("doc_id").alias("position"),
    )
    rows = item_metric_rows(_evaluations(spark, sf).join(positions, "complaint_id"))
    return rows.withColumn("value", F.round("value", 6))


def _runs(
    spark: SparkSession, sf: str, evaluations: DataFrame | None = None
) -> DataFrame:
    metrics = _metric_rows(spark, sf, evaluations)
    return wide_runs(fx.run_list(spark), fx.run_params(spark), metrics)


def _shown(df: DataFrame) -> DataFrame:
    """Plain names, text timestamps, rounded numbers."""
    df = reports.strip_prefixes(df)
    out = []
    for f in df.schema:
        name, kind = f.name, f.dataType.simpleString()
        if kind == "timestamp":
            out.append(F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name))
        elif kind == "double":
            out.append(F.round(name, 6).alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def runs_wide(spark: SparkSession, sf: str) -> DataFrame:
    shown = _shown(_runs(spark, sf))
    return shown.select(
        "run_id", "run_name", "start_time", "status", "llm_name", "temperature", *AVERAGE_KEYS
    )


def recent_runs(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(reports.recent_runs(_runs(spark, sf), 5))


def latest_runs(spark: SparkSession, sf: str) -> DataFrame:
    latest = _shown(reports.latest_per_model(_runs(spark, sf)))
    return latest.select("llm_name", "run_id", "start_time", "avg_overall_score")


def comparison(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(reports.comparison(_runs(spark, sf)))


def overall_bars(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(reports.overall_bars(reports.comparison(_runs(spark, sf))))


def radar(spark: SparkSession, sf: str) -> DataFrame:
    points = _shown(reports.radar(reports.comparison(_runs(spark, sf))))
    return points.withColumn("point", F.col("point").cast("long"))


def small_multiples(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(reports.small_multiples(reports.comparison(_runs(spark, sf))))


def temperature(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(reports.temperature_analysis(_runs(spark, sf), "model-a"))


def length_quality(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(reports.length_quality(reports.comparison(_runs(spark, sf))))


def winner(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(reports.winner(reports.comparison(_runs(spark, sf))))


def recommendations(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(reports.recommendations(reports.comparison(_runs(spark, sf))))


def agreement(spark: SparkSession, sf: str) -> DataFrame:
    rows = _shown(reports.agreement_report(reports.comparison(_runs(spark, sf))))
    return rows.withColumn("high", F.col("high").cast("int"))


def judge_means(spark: SparkSession, sf: str) -> DataFrame:
    """Judges of the best run; the evaluations serve both sides of the lookup."""
    evaluations = materialise(_evaluations(spark, sf), "evaluations")
    breakdown = judging.judge_breakdown(evaluations, ["run_id", "complaint_id"])
    return reports.judge_means(
        reports.breakdown_of(_runs(spark, sf, evaluations), breakdown, "best")
    )


def judge_bars(spark: SparkSession, sf: str) -> DataFrame:
    return reports.judge_bars(_breakdown(spark, sf))


def judge_strictness(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(reports.judge_strictness(_breakdown(spark, sf)))


def exported_results(spark: SparkSession, sf: str) -> DataFrame:
    """The comparison saved as a table and queried by name."""
    name = f"results_{uuid.uuid4().hex}"
    reports.export_comparison(
        reports.comparison(_runs(spark, sf)), name, f"{shared_dir(spark)}/casebrook/{name}"
    )
    return _shown(reports.exported_results(spark, name))


def sample_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(
        reports.sample_summaries(
            _runs(spark, sf), fx.run_summaries(spark, sf), latest_only=True
        )
    )


# --------------------------------------------------------------- experiment


def _experiment(spark: SparkSession, sf: str) -> tuple[RunStore, DataFrame]:
    docs = materialise(fx.complaint_documents(spark, sf), "documents")
    chunks = fx.complaint_chunks(spark, sf)
    keys = corpus.distinct_keys(docs).select(
        F.col("first_ord").alias("position"), "reference_number"
    )
    store = RunStore(spark, f"{shared_dir(spark)}/casebrook/runs-{uuid.uuid4().hex}")
    ranked = run_experiment(
        store,
        "all-records",
        docs,
        chunks,
        CONFIGS,
        PANEL,
        answer,
        test_keys=keys,
        started_at=datetime(2024, 5, 1, 12, 0, 0),
    )
    return store, ranked


def experiment(spark: SparkSession, sf: str) -> DataFrame:
    """Retrieval, summaries, panel verdicts and averages over all records."""
    _, ranked = _experiment(spark, sf)
    return _shown(ranked)


def experiment_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The recorded run tables read back: rows per run and table."""
    store, _ = _experiment(spark, sf)
    names = store.read("run_params").filter("key = 'llm_name'").select(
        "run_id", F.col("value").alias("llm_name")
    )
    counts = [
        store.read(name).select("run_id", F.lit(name).alias("table_name"))
        for name in ("run_params", "run_metrics", "summaries", "evaluations", "judge_breakdown")
    ]
    rows = counts[0]
    for more in counts[1:]:
        rows = rows.unionByName(more)
    return (
        rows.groupBy("run_id", "table_name")
        .agg(F.count("*").alias("n_rows"))
        .join(names, "run_id")
        .select("llm_name", "table_name", "n_rows")
    )


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        extract_keys,
        distinct_keys,
        first_keys,
        known_keys,
        lookup_documents,
        corpus_stats,
        chunks_whole,
        chunks_sections,
        chunks_literal,
        normalise,
        seeds,
        attached_vectors,
        embedding_responses,
        completion_responses,
        topk_chunks,
        topk_documents,
        topk_overfetch,
        topk_without_copies,
        topk_routed,
        topk_any_length,
        topk_recall,
        topk_free_text,
        summary_prompts,
        summaries,
        verdicts,
        single_verdicts,
        panel,
        panel_texts,
        judge_breakdown,
        run_metrics,
        item_metrics,
        runs_wide,
        recent_runs,
        latest_runs,
        comparison,
        overall_bars,
        radar,
        small_multiples,
        temperature,
        length_quality,
        winner,
        recommendations,
        agreement,
        judge_means,
        judge_bars,
        judge_strictness,
        exported_results,
        sample_summaries,
        experiment,
        experiment_tables,
    )
}
