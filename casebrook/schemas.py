"""Declared schemas of the tables the operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

METRICS = (
    "accuracy",
    "completeness",
    "chronology",
    "clarity",
    "conciseness",
    "overall_score",
)
CRITERIA = METRICS[:-1]
REASONINGS = tuple(f"{name}_reasoning" for name in CRITERIA)

VERDICT = T.StructType(
    [T.StructField(name, T.DoubleType()) for name in METRICS]
    + [T.StructField(name, T.StringType()) for name in REASONINGS]
    + [T.StructField("overall_assessment", T.StringType())]
)

RUNS = T.StructType(
    [
        T.StructField("run_id", T.StringType(), False),
        T.StructField("experiment", T.StringType(), False),
        T.StructField("run_name", T.StringType(), False),
        T.StructField("start_time", T.TimestampType(), False),
        T.StructField("status", T.StringType(), False),
    ]
)
RUN_PARAMS = T.StructType(
    [
        T.StructField("run_id", T.StringType(), False),
        T.StructField("key", T.StringType(), False),
        T.StructField("value", T.StringType()),
    ]
)
RUN_METRICS = T.StructType(
    [
        T.StructField("run_id", T.StringType(), False),
        T.StructField("key", T.StringType(), False),
        T.StructField("value", T.DoubleType()),
    ]
)
SUMMARIES = T.StructType(
    [
        T.StructField("run_id", T.StringType(), False),
        T.StructField("complaint_id", T.StringType(), False),
        T.StructField("summary", T.StringType()),
        T.StructField("summary_length", T.IntegerType()),
    ]
)
JUDGE_BREAKDOWN = T.StructType(
    [
        T.StructField("run_id", T.StringType(), False),
        T.StructField("complaint_id", T.StringType(), False),
        T.StructField("judge", T.StringType(), False),
        *[T.StructField(name, T.DoubleType()) for name in METRICS],
        T.StructField("overall_assessment", T.StringType()),
    ]
)

_RANGE = T.StructType(
    [T.StructField("min", T.DoubleType()), T.StructField("max", T.DoubleType())]
)
_TEXT_BY_JUDGE = T.MapType(T.StringType(), T.StringType())
EVALUATIONS = T.StructType(
    [
        T.StructField("run_id", T.StringType(), False),
        T.StructField("complaint_id", T.StringType(), False),
        *[T.StructField(name, T.DoubleType()) for name in METRICS],
        *[T.StructField(f"{name}_std", T.DoubleType()) for name in METRICS],
        *[T.StructField(f"{name}_range", _RANGE) for name in METRICS],
        T.StructField(
            "individual_judge_scores", T.MapType(T.StringType(), VERDICT)
        ),
        T.StructField("num_judges", T.LongType()),
        T.StructField("n_failed_judges", T.LongType()),
        T.StructField(
            "reasoning_by_judge", T.MapType(T.StringType(), _TEXT_BY_JUDGE)
        ),
        T.StructField("overall_assessments", _TEXT_BY_JUDGE),
        T.StructField("judge_agreement", T.DoubleType()),
        T.StructField("overall_assessment", T.StringType()),
    ]
)
FAILURES = T.StructType(
    [
        T.StructField("run_id", T.StringType(), False),
        T.StructField("complaint_id", T.StringType(), False),
        T.StructField("step", T.StringType(), False),
        T.StructField("judge", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)
