"""Reports over recorded runs: frames in, frames out.

A runs frame (``wide_runs``) has one row per run. Sorted heads use a bounded
top-n, and best-of picks one aggregate, so no report needs a global window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casebrook.functions.numbers import (
    HIGH_AGREEMENT,
    SCORE_SCALE,
    agreement_band,
    fixed,
    nan_as_null,
    round_half_even,
)
from casebrook.schemas import CRITERIA, METRICS
from casebrook.operators.sizing import fits_broadcast
from casebrook.sources.runs import RunStore

# --- fixed values -----------------------------------------------------------
COMPARED_PARAMS = ("llm_name", "temperature")
COMPARED_METRICS = (
    "avg_accuracy",
    "avg_completeness",
    "avg_chronology",
    "avg_clarity",
    "avg_conciseness",
    "avg_overall_score",
    "avg_summary_length",
    "std_overall_score",
    "avg_judge_agreement",
)
RECENT = 10
TOP_MODELS = 4
RECOMMENDED = (
    ("maximum accuracy", "avg_accuracy"),
    ("best clarity", "avg_clarity"),
    ("conciseness", "avg_conciseness"),
    ("overall balance", "avg_overall_score"),
)
# ----------------------------------------------------------------------------


def param(name: str) -> Column:
    return F.col(f"`params.{name}`")


def metric(name: str) -> Column:
    return F.col(f"`metrics.{name}`")


def _best_first(name: str = "avg_overall_score") -> list[Column]:
    """Descending, missing values last, then the newer run, then the id."""
    return [
        nan_as_null(metric(name)).desc_nulls_last(),
        F.desc("start_time"),
        F.asc("run_id"),
    ]


def recent_runs(runs: DataFrame, n: int = RECENT) -> DataFrame:
    return (
        runs.orderBy(F.desc("start_time"), "run_id")
        .limit(n)
        .select(
            "run_id", "start_time", "status", param("llm_name"), metric("avg_overall_score")
        )
    )


def comparison(runs: DataFrame) -> DataFrame:
    """All runs of the experiment, best overall score first."""
    return runs.select(
        "run_id",
        "start_time",
        *[param(name) for name in COMPARED_PARAMS],
        *[metric(name) for name in COMPARED_METRICS],
    ).orderBy(*_best_first())


def top_models(compared: DataFrame, n: int = TOP_MODELS) -> DataFrame:
    return compared.orderBy(*_best_first()).limit(n)


def overall_bars(compared: DataFrame) -> DataFrame:
    return compared.select(
        "run_id",
        param("llm_name").alias("model"),
        metric("avg_overall_score").alias("score"),
        metric("std_overall_score").alias("std_dev"),
        fixed(metric("avg_overall_score"), 2).alias("label"),
    )


def _unpivoted(compared: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``(run_id, model, metric, value)`` of the averages of ``names``."""
    wide = compared.select(
        "run_id",
        param("llm_name").alias("model"),
        *[metric(f"avg_{name}").alias(name) for name in names],
    )
    return wide.unpivot(["run_id", "model"], list(names), "metric", "value")


def radar(compared: DataFrame, n: int = TOP_MODELS) -> DataFrame:
    """Polygon points of the best ``n`` runs; the first point closes it."""
    spokes = len(CRITERIA)
    points = F.array(
        *[
            F.struct(
                F.lit(i).alias("point"),
                F.lit(CRITERIA[i % spokes]).alias("metric"),
                F.lit((i % spokes) / spokes * 2 * math.pi).alias("angle"),
                metric(f"avg_{CRITERIA[i % spokes]}").alias("value"),
            )
            for i in range(spokes + 1)
        ]
    )
    return top_models(compared, n).select(
        "run_id", param("llm_name").alias("model"), F.explode(points).alias("p")
    ).select("run_id", "model", "p.*")


def small_multiples(compared: DataFrame, n: int = TOP_MODELS) -> DataFrame:
    return _unpivoted(top_models(compared, n), METRICS)


def temperature_analysis(runs: DataFrame, name_pattern: str) -> DataFrame:
    """Runs whose model name matches, by temperature as a number."""
    chosen = runs.filter(F.coalesce(param("llm_name").rlike(name_pattern), F.lit(False)))
    return chosen.select(
        "run_id",
        param("llm_name").alias("llm_name"),
        param("temperature").try_cast("double").alias("temperature"),
        *[
            metric(name).alias(name)
            for name in ("avg_overall_score", "avg_accuracy", "avg_clarity", "std_overall_score")
        ],
    ).orderBy("temperature", "run_id")


def length_quality(compared: DataFrame) -> DataFrame:
    return compared.select(
        "run_id",
        param("llm_name").alias("llm_name"),
        metric("avg_summary_length").alias("avg_summary_length"),
        metric("avg_overall_score").alias("avg_overall_score"),
    )


def winner(compared: DataFrame) -> DataFrame:
    return compared.orderBy(*_best_first()).limit(1)


def recommendations(compared: DataFrame) -> DataFrame:
    """The best run per category in one aggregate; ties go to the run that the
    comparison lists first."""

    def down(name: str) -> Column:
        return F.coalesce(-nan_as_null(metric(name)), F.lit(math.inf))

    def best(name: str) -> Column:
        place = F.struct(
            down(name),
            down("avg_overall_score"),
            -F.unix_micros("start_time"),
            F.col("run_id"),
        )
        row = F.struct(
            F.col("run_id").alias("run_id"),
            param("llm_name").alias("llm_name"),
            metric(name).alias("score"),
        )
        return F.min_by(row, place)

    picks = compared.agg(
        *[best(name).alias(f"c{i}") for i, (_, name) in enumerate(RECOMMENDED)]
    )
    rows = F.array(
        *[
            F.struct(F.lit(label).alias("category"), F.col(f"c{i}").alias("pick"))
            for i, (label, _) in enumerate(RECOMMENDED)
        ]
    )
    return (
        picks.select(F.explode(rows).alias("r"))
        .select("r.category", "r.pick.*")
        .filter(F.col("run_id").isNotNull())
    )


def agreement_report(compared: DataFrame) -> DataFrame:
    agreed = metric("avg_judge_agreement")
    return compared.select(
        "run_id",
        param("llm_name").alias("llm_name"),
        metric("avg_overall_score").alias("avg_overall_score"),
        agreed.alias("avg_judge_agreement"),
        F.concat(fixed(agreed * 100, 1), F.lit("%")).alias("label"),
        agreement_band(agreed).alias("band"),
        (agreed >= HIGH_AGREEMENT).alias("high"),
    )


def judge_means(breakdown: DataFrame) -> DataFrame:
    return (
        breakdown.groupBy("judge")
        .agg(*[round_half_even(F.avg(name)).alias(name) for name in METRICS])
        .orderBy("judge")
    )


def judge_bars(breakdown: DataFrame) -> DataFrame:
    return judge_means(breakdown).unpivot("judge", list(METRICS), "metric", "value")


def judge_strictness(breakdown: DataFrame) -> DataFrame:
    """Mean and sample deviation of the overall mark; strict judges first."""
    stats = breakdown.groupBy("judge").agg(
        round_half_even(F.avg("overall_score")).alias("mean_score"),
        round_half_even(F.stddev_samp("overall_score")).alias("std_dev"),
    )
    return stats.withColumn("strictness", F.lit(SCORE_SCALE) - F.col("mean_score")).orderBy(
        F.desc("strictness"), "judge"
    )


def pick_run(runs: DataFrame, which: str = "latest") -> DataFrame:
    """``(run_id)`` of the newest run, or of the best by overall score."""
    order = {
        "latest": [F.desc("start_time"), F.asc("run_id")],
        "best": _best_first(),
    }[which]
    return runs.orderBy(*order).limit(1).select("run_id")


def breakdown_of(runs: DataFrame, breakdown: DataFrame, which: str = "latest") -> DataFrame:
    """Judge rows of one run; the picked id is a single row."""
    return breakdown.join(F.broadcast(pick_run(runs, which)), "run_id", "left_semi")


def latest_per_model(runs: DataFrame) -> DataFrame:
    """The newest run of each model name."""
    newest = Window.partitionBy(param("llm_name")).orderBy(F.desc("start_time"), F.asc("run_id"))
    return runs.withColumn("rn", F.row_number().over(newest)).filter("rn = 1").drop("rn")


def sample_summaries(
    runs: DataFrame, summaries: DataFrame, complaint_id: str | None = None,
    latest_only: bool = False,
) -> DataFrame:
    """Side by side: each run's own summary of one record, best run first, or of
    all records in no order. Runs are broadcast, texts stay where they are."""
    shown = latest_per_model(runs) if latest_only else runs
    wanted = (
        summaries
        if complaint_id is None
        else summaries.filter(F.col("complaint_id") == complaint_id)
    )
    scored = shown.select(
        "run_id",
        param("llm_name").alias("llm_name"),
        metric("avg_overall_score").alias("avg_overall_score"),
    )
    scored = F.broadcast(scored) if fits_broadcast(scored) else scored
    rows = wanted.join(scored, "run_id").select(
        "complaint_id", "run_id", "llm_name", "avg_overall_score", "summary"
    )
    if complaint_id is None:
        return rows
    return rows.orderBy(
        nan_as_null(F.col("avg_overall_score")).desc_nulls_last(), "run_id"
    )


def strip_prefixes(compared: DataFrame) -> DataFrame:
    renamed = {
        name: name.replace("params.", "").replace("metrics.", "") for name in compared.columns
    }
    return compared.withColumnsRenamed(renamed)


def export_comparison(compared: DataFrame, table: str, path: str | None = None) -> None:
    """Replace the result table by the comparison, without a driver hop.

    ``path`` places the table's files; without it they go to the warehouse.
    """
    writer = strip_prefixes(compared).write.mode("overwrite")
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def exported_results(spark: SparkSession, table: str) -> DataFrame:
    """The exported comparison, best overall score first."""
    return spark.sql(
        "SELECT * FROM IDENTIFIER(:table) ORDER BY avg_overall_score DESC NULLS LAST",
        args={"table": table},
    )


def experiment_runs(store: RunStore, experiment: str) -> DataFrame:
    """The experiment's runs, newest first; empty when it does not exist."""
    return store.wide_runs(experiment)
