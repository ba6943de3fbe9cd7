"""Inputs of the registered queries, derived from the given tables.

The SQL fragments below are valid in Spark and in DuckDB alike and are used on
both sides; every row and every whole text of the source table is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebrook.operators.chunking import chunk_documents
from casebrook.plans.stand_ins import letter_counts
from casebrook.schemas import CRITERIA, METRICS
from casebrook.sources.corpus import documents
from casebrook.sources.inference import embed_texts
from casebrook.sources.runs import run_name
from casebrook.sources.storage import materialise

PADDED_ID = "lpad(CAST(doc_id AS STRING), 8, '0')"

# Records in four forms: no label, a pattern only, an empty label, a label
# shared by many records, and (mostly) a label of their own.
COMPLAINT_TEXT = f"""CASE
  WHEN source = 'src0' THEN concat('CDCR-', {PADDED_ID}, ' note: ', text)
  WHEN source = 'src1' THEN text
  WHEN source = 'src2' THEN concat('reference_number:   | ', text)
  WHEN source = 'src3' THEN concat('REFERENCE_NUMBER: LANG-', lang, '| ', text)
  ELSE concat('Reference_Number:  DOC-', {PADDED_ID}, ' | source: ', source, ' | ', text)
END"""

SECTION_TEXT = (
    "concat('lead ', CAST(doc_id AS STRING), chr(10), '## Intake', chr(10), text, "
    "chr(10), '## Detail ', source, chr(10), text)"
)
LITERAL_TEXT = "concat(text, chr(10), '## $', chr(10), text)"

_NUMBERS = "array_join(transform(embedding, x -> CAST(x AS STRING)), ', ')"
EMBEDDING_RESPONSE = f"""CASE label % 3
  WHEN 0 THEN concat('{{"embeddings": [[', {_NUMBERS}, ']]}}')
  WHEN 1 THEN concat('{{"data": [{{"index": 0, "embedding": [', {_NUMBERS}, ']}}]}}')
  ELSE concat('{{"data": {{"embeddings": [[', {_NUMBERS}, ']]}}}}')
END"""

RUNS = (
    # run_id, llm_name, temperature, start_time, judged
    ("r1", "model-a-warm", "0.6", "2024-03-01 08:00:00", True),
    ("r2", "model-a-cold", "0.3", "2024-03-01 09:00:00", True),
    ("r3", "model-b", "10.0", "2024-03-01 10:00:00", True),
    ("r4", "model-c", "0.6", "2024-03-02 08:00:00", True),
    ("r5", "model-a-warm", "0.7", "2024-03-03 08:00:00", True),
    ("r6", "model-b", "0.6", "2024-03-03 08:00:00", True),
    ("r7", "model-c", "0.9", "2024-03-04 08:00:00", False),
)
JUDGES = ("judge-x", "judge-y", "judge-z")
EXPERIMENT = "comparison"

MARK_WEIGHTS = dict(zip(METRICS, (1, 2, 3, 4, 7, 6)))


def mark(name: str) -> str:
    weight = MARK_WEIGHTS[name]
    return (
        f"1 + (n_chars * {weight} + run_no * {weight + 1}"
        f" + judge_no * (1 + doc_id % 3)) % 5"
    )


def _verdict_body() -> str:
    """JSON text of a verdict; one criterion is missing from some."""
    parts = []
    for name in METRICS:
        item = f"""concat('"{name}": ', CAST({mark(name)} AS STRING), ', ')"""
        if name == "clarity":
            item = f"CASE WHEN n_chars % 7 = 0 THEN '' ELSE {item} END"
        parts.append(item)
    for name in CRITERIA:
        parts.append(
            f"""concat('"{name}_reasoning": "{name} in ', lang, '", ')"""
        )
    parts.append("""concat('"overall_assessment": "by ', judge, '"')""")
    return "concat('{', " + ", ".join(parts) + ", '}')"


# Answers as judges give them: plain, fenced, cut short, or with prose after.
VERDICT_RESPONSE = f"""CASE
  WHEN n_chars % 19 = 0 THEN concat('{{"accuracy": ', CAST(n_chars AS STRING))
  WHEN n_chars % 29 = 0 THEN concat({_verdict_body()}, ' as asked')
  WHEN n_chars % 3 = 0 THEN concat('```json', chr(10), {_verdict_body()}, chr(10), '```')
  WHEN n_chars % 3 = 1 THEN concat('```', {_verdict_body()}, '```', chr(10))
  ELSE {_verdict_body()}
END"""
VERDICT_ERROR = "CASE WHEN n_chars % 31 = 0 THEN 'timeout' ELSE CAST(NULL AS STRING) END"
SUMMARY_TEXT = "concat(llm_name, ' on ', source, ': ', text)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def complaints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record table: one flattened text per record."""
    return document_table(spark, sf_dir).select(
        F.col("doc_id").alias("doc_ord"), F.expr(COMPLAINT_TEXT).alias("all_columns")
    )


#: One record in seventeen has no text.
NULL_TEXT = f"CASE WHEN doc_id % 17 = 0 THEN NULL ELSE {COMPLAINT_TEXT} END"


def null_complaints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_table(spark, sf_dir).select(
        F.col("doc_id").alias("doc_ord"), F.expr(NULL_TEXT).alias("all_columns")
    )


#: A test list: the record of every label, some listed twice, one unknown.
EXPERIMENT_KEYS = f"""SELECT doc_id AS position, concat('DOC-', {PADDED_ID}) AS reference_number
  FROM labels
  UNION ALL SELECT doc_id + 1000000, concat('DOC-', {PADDED_ID}) FROM labels WHERE doc_id % 50 < 3
  UNION ALL SELECT 2000000, 'NO-SUCH-KEY'"""


def experiment_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    rows = spark.sql(EXPERIMENT_KEYS.replace("FROM labels", "FROM {labels}"), labels=labels)
    return rows.select(F.col("position").cast("int").alias("position"), "reference_number")


def complaint_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(complaints(spark, sf_dir))


def complaint_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all records with their vectors, written once."""
    chunks = chunk_documents(complaint_documents(spark, sf_dir))
    return materialise(embed_texts(chunks, letter_counts), "chunk-vectors")


def vector_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given vectors as a chunk table: ten records, many chunks each."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("chunk_id"),
        F.concat(F.lit("L"), F.col("label").cast("string")).alias("reference_number"),
        F.lit("Main").alias("section"),
        F.col("label").alias("chunk_index"),
        F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("chunk_text"),
        "embedding",
    )


#: Lengths from a hundredth to about a hundred; every eleventh vector is zero.
SCALE = """CASE WHEN vec_id % 11 = 3 THEN 0.0 ELSE power(CAST(2 AS DOUBLE), vec_id % 14 - 7) END"""


def scaled_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given vectors with lengths of their own, some of them zero."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.expr(SCALE).alias("by"))
    chunks = vector_chunks(spark, sf_dir).join(rows, F.col("chunk_id") == F.col("vec_id"))
    longer = F.transform("embedding", lambda x: (x.cast("double") * F.col("by")).cast("float"))
    return chunks.withColumn("embedding", longer).drop("vec_id", "by")


def run_list(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(r, EXPERIMENT, m, t, "FINISHED" if j else "FAILED") for r, m, _, t, j in RUNS],
        "run_id string, experiment string, llm_name string, start string, status string",
    ).select(
        "run_id",
        "experiment",
        run_name(F.col("llm_name"), F.to_timestamp("start")).alias("run_name"),
        F.to_timestamp("start").alias("start_time"),
        "status",
    )


def run_params(spark: SparkSession) -> DataFrame:
    rows = []
    for run_id, model, temperature, _, _ in RUNS:
        rows += [(run_id, "llm_name", model), (run_id, "temperature", temperature)]
    return spark.createDataFrame(rows, "run_id string, key string, value string")


def judged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document once per judged run, with the run's number and name."""
    runs = F.array(
        *[
            F.struct(
                F.lit(r).alias("run_id"),
                F.lit(m).alias("llm_name"),
                F.lit(i).alias("run_no"),
            )
            for i, (r, m, _, _, judged) in enumerate(RUNS)
            if judged
        ]
    )
    return (
        document_table(spark, sf_dir)
        .withColumn("run", F.explode(runs))
        .select("doc_id", "text", "lang", "source", "n_chars", "run.*")
        .withColumn("complaint_id", F.expr(f"concat('DOC-', {PADDED_ID})"))
    )


def run_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        judged_runs(spark, sf_dir)
        .withColumn("summary", F.expr(SUMMARY_TEXT))
        .select("run_id", "complaint_id", "summary", F.length("summary").alias("summary_length"))
    )


def verdict_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw judge answers: document x run x judge."""
    judges = F.array(
        *[
            F.struct(F.lit(name).alias("judge"), F.lit(i).alias("judge_no"))
            for i, name in enumerate(JUDGES)
        ]
    )
    rows = (
        judged_runs(spark, sf_dir)
        .drop("text")
        .withColumn("j", F.explode(judges))
        .select("*", "j.judge", "j.judge_no")
    )
    return rows.select(
        "run_id",
        "complaint_id",
        "judge",
        F.expr(VERDICT_RESPONSE).alias("response"),
        F.expr(VERDICT_ERROR).alias("error"),
    )
