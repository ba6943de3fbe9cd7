"""Reading a judge's JSON answer strictly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casebrook.functions.text import strip_code_fence
from casebrook.schemas import METRICS, REASONINGS, VERDICT

# --- fixed values -----------------------------------------------------------
NEUTRAL_SCORE = 3.0
NO_REASON = "N/A"
# ----------------------------------------------------------------------------
_BAD = "_bad"
_PARSED = T.StructType([*VERDICT.fields, T.StructField(_BAD, T.StringType())])
_OPTIONS = {
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": _BAD,
    "allowSingleQuotes": "false",
}


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def is_one_object(text: Column) -> Column:
    """True when the text, which parses from its start, is a single JSON object
    with nothing around it.

    ``from_json`` stops after the first value. One opening brace at the start
    and one closing brace at the end settle the usual flat answer. Otherwise
    quoted strings are blanked and the braces counted: one object closes its
    first brace once, at the end, however deep it is; two in a row do not.
    """
    framed = F.startswith(text, F.lit("{")) & F.endswith(text, F.lit("}"))
    flat = (_count(text, "{") == 1) & (_count(text, "}") == 1)
    folded = F.regexp_replace(text, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', "0")
    braces = F.split(F.regexp_replace(folded, r"[^{}]++", ""), "")
    step = lambda c: F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
    closed = F.aggregate(
        braces,
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("ends")),
        lambda a, c: F.struct(
            (a["depth"] + step(c)).alias("depth"),
            (a["ends"] + F.when((c == "}") & (a["depth"] == 1), 1).otherwise(0)).alias("ends"),
        ),
        lambda a: (a["depth"] == 0) & (a["ends"] == 1),
    )
    return F.when(~framed, False).when(flat, True).otherwise(closed)


def read_verdicts(answers: DataFrame, response_col: str = "response") -> DataFrame:
    """Add ``_parsed`` (the verdict struct) and ``_ok`` to raw answers.

    ``_ok`` is false when the text is not one valid object, when a score is not
    a number, or when a score is given as null. A score or text that is simply
    absent is fine. The steps are columns of their own, so each text is
    cleaned and parsed once.
    """
    text, parsed = F.col("_text"), F.col("_parsed")
    staged = answers.withColumn(
        "_text", strip_code_fence(F.col(response_col))
    ).withColumn("_parsed", F.from_json(text, _PARSED, _OPTIONS))
    complete = F.lit(True)
    null_score = F.lit(False)
    names = F.map_keys(F.from_json(text, "map<string,string>", _OPTIONS))
    for name in METRICS:
        complete = complete & parsed[name].isNotNull()
        null_score = null_score | (
            parsed[name].isNull() & F.array_contains(names, name)
        )
    sound = is_one_object(text) & parsed.isNotNull() & parsed[_BAD].isNull()
    ok = sound & F.when(complete, True).otherwise(~null_score)
    return staged.withColumn("_ok", F.coalesce(ok, F.lit(False))).drop("_text")


def verdict_fields(failure: Column) -> list[Column]:
    """The verdict's columns after ``read_verdicts``: as parsed, or neutral
    scores with ``failure`` as assessment. Absent reasons read ``N/A``; an
    absent assessment stays NULL."""
    ok, parsed = F.col("_ok"), F.col("_parsed")
    fields = [
        F.when(ok, parsed[name]).otherwise(F.lit(NEUTRAL_SCORE)).alias(name)
        for name in METRICS
    ]
    fields += [
        F.coalesce(F.when(ok, parsed[name]), F.lit(NO_REASON)).alias(name)
        for name in REASONINGS
    ]
    fields.append(
        F.when(ok, parsed["overall_assessment"]).otherwise(failure).alias("overall_assessment")
    )
    return fields
