"""Judging summaries with one judge or a panel, and condensing the verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebrook.functions.numbers import agreement, fixed
from casebrook.functions.text import clip, fill_template
from casebrook.functions.verdicts import (
    NEUTRAL_SCORE,
    NO_REASON,
    read_verdicts,
    verdict_fields,
)
from casebrook.operators.corpus import lookup_documents
from casebrook.schemas import METRICS, REASONINGS

# --- fixed values -----------------------------------------------------------
CONTEXT_CHARS = 20000
JUDGE_TEMPERATURE = 0.1
JUDGE_TOKENS = 2000
CALL_FAILED = "Error with {judge}: {error}"
UNREADABLE = "Failed to parse {judge} evaluation"
UNREADABLE_SINGLE = "Failed to parse evaluation"
PANEL_TEXT = "Average of {count} judges. Agreement: {percent}%"
# ----------------------------------------------------------------------------

# One JSON key per metric and per reason, as the reader of verdicts expects them.
_KEYS = ", ".join(f'"{name}"' for name in (*METRICS, *REASONINGS, "overall_assessment"))
JUDGE_TEMPLATE = f"""How well does the second text sum up the first? Give marks of 1 to 5.

First text:
{{original_context}}

Second text:
{{summary}}

Reply with a JSON object that has these keys: {_KEYS}
"""


def judge_prompts(
    summaries: DataFrame, docs: DataFrame, template: str = JUDGE_TEMPLATE
) -> DataFrame:
    """Add ``prompt`` to rows with ``reference_number`` and ``summary``; rows
    whose key has no document are left out."""
    budgeted = docs.withColumn("doc_text", clip(F.col("doc_text"), CONTEXT_CHARS))
    context = lookup_documents(budgeted, summaries).select(
        "reference_number", F.col("doc_text").alias("context")
    )
    prompt = fill_template(
        template, original_context=F.col("context"), summary=F.col("summary")
    )
    return summaries.join(context, "reference_number").withColumn("prompt", prompt).drop(
        "context"
    )


def with_judges(prompts: DataFrame, judges: dict[str, str]) -> DataFrame:
    """Each prompt once per judge, from a short literal list."""
    panel = F.array(
        *[
            F.struct(F.lit(name).alias("judge"), F.lit(endpoint).alias("endpoint"))
            for name, endpoint in judges.items()
        ]
    )
    return (
        prompts.withColumn("j", F.explode(panel))
        .select(
            *prompts.columns,
            "j.judge",
            "j.endpoint",
            F.lit(JUDGE_TEMPERATURE).alias("temperature"),
            F.lit(JUDGE_TOKENS).alias("max_tokens"),
        )
    )


def parse_verdicts(answers: DataFrame) -> DataFrame:
    """Replace ``response`` and ``error`` by the verdict's fields.

    A call that failed and an answer that cannot be read both count as neutral
    marks, flagged in ``failed``.
    """
    judge, error = F.col("judge"), F.col("error")
    failure = F.when(
        error.isNotNull(), fill_template(CALL_FAILED, judge=judge, error=error)
    ).otherwise(fill_template(UNREADABLE, judge=judge))
    given = answers.withColumn("response", F.when(F.col("error").isNull(), F.col("response")))
    return read_verdicts(given).select(
        *[c for c in answers.columns if c not in ("response", "error")],
        *verdict_fields(failure),
        (~F.col("_ok")).alias("failed"),
    )


def single_verdicts(answers: DataFrame) -> DataFrame:
    """Verdicts of one judge: unreadable answers turn neutral and keep the raw
    text; rows whose call failed are dropped, as the caller never sees them."""
    made = answers.filter(F.col("error").isNull())
    return read_verdicts(made).select(
        *[c for c in answers.columns if c not in ("response", "error")],
        *verdict_fields(F.lit(UNREADABLE_SINGLE)),
        F.when(~F.col("_ok"), F.col("response")).alias("raw_response"),
    )


def _score_aggregates() -> list[Column]:
    defaults = {"avg": NEUTRAL_SCORE, "std": 0.0, "min": NEUTRAL_SCORE, "max": NEUTRAL_SCORE}
    take = {"avg": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max}
    return [
        F.coalesce(take[kind](name), F.lit(default)).alias(f"{kind}_{name}")
        for name in METRICS
        for kind, default in defaults.items()
    ] + [
        F.count("*").alias("num_judges"),
        F.sum(F.col("failed").cast("long")).alias("n_failed_judges"),
    ]


def panel_scores(verdicts: DataFrame, by: list[str]) -> DataFrame:
    """Mean, population deviation, least and greatest mark per metric.

    Judges that did not give a metric are skipped; a metric nobody gave reads
    3, 0, 3, 3. Everything is a partial hash aggregate on ``by``.
    """
    return verdicts.groupBy(*by).agg(*_score_aggregates())


def panel(verdicts: DataFrame, by: list[str]) -> DataFrame:
    """The full panel evaluation, one row per ``by`` group, in one shuffle.

    Besides the numbers each row holds the verdicts, reasons and assessments
    as maps by judge; a group is one panel, a short list the caller wrote down.
    """
    verdict = F.struct(*METRICS, *REASONINGS, "overall_assessment")
    entries = F.array_sort(F.collect_list(F.struct("judge", verdict.alias("verdict"))))
    grouped = verdicts.groupBy(*by).agg(
        *_score_aggregates(),
        F.map_from_entries(entries).alias("individual_judge_scores"),
    )

    def by_judge(name: str) -> Column:
        return F.transform_values(
            "individual_judge_scores",
            lambda _, v: F.coalesce(v[name], F.lit(NO_REASON)),
        )

    reasons = F.create_map(
        *[part for name in REASONINGS for part in (F.lit(name), by_judge(name))]
    )
    agreed = agreement(F.col("std_overall_score"))
    text = fill_template(
        PANEL_TEXT,
        count=F.col("num_judges").cast("string"),
        percent=fixed(agreed * 100, 2),
    )
    return grouped.select(
        *by,
        *[F.col(f"avg_{name}").alias(name) for name in METRICS],
        *[F.col(f"std_{name}").alias(f"{name}_std") for name in METRICS],
        *[
            F.struct(
                F.col(f"min_{name}").alias("min"), F.col(f"max_{name}").alias("max")
            ).alias(f"{name}_range")
            for name in METRICS
        ],
        "individual_judge_scores",
        "num_judges",
        "n_failed_judges",
        reasons.alias("reasoning_by_judge"),
        by_judge("overall_assessment").alias("overall_assessments"),
        agreed.alias("judge_agreement"),
        text.alias("overall_assessment"),
    )


def judge_breakdown(evaluations: DataFrame, by: list[str]) -> DataFrame:
    """One row per judge from the nested scores of ``panel`` rows."""
    return evaluations.select(
        *by, F.explode("individual_judge_scores").alias("judge", "v")
    ).select(
        *by,
        "judge",
        *[F.col("v")[name].alias(name) for name in METRICS],
        F.coalesce(F.col("v")["overall_assessment"], F.lit("")).alias("overall_assessment"),
    )

