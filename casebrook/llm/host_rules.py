"""Quality rules of documents, judged together with their hosts.

Every document is measured by built-in functions alone. Failures of the soft
rules are counted by host; each host's rate is shrunk towards a beta prior that
is fitted to the rates of all hosts (method of moments), so a host with few
documents counts for little. A host is bad in a rule if its shrunk rate is above
``HOST_LIMIT``.

A document is rejected if it fails a base rule, if it fails a soft rule badly,
or if it fails a soft rule slightly and its host is bad in that rule. One that
fails no rule stays, whatever its host.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebrook.operators.sizing import fits_broadcast
from casebrook.sources.storage import materialise

MIN_WORDS = 50
REPEAT_PERCENT = 50
HOST_LIMIT = 0.5
MIN_PRIOR = 2.0  # no prior is weaker than a uniform one
_SPACE = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class SoftRule:
    """A rule with two limits; both are conditions on the measures."""

    name: str
    slight: str
    bad: str


SOFT_RULES = (
    SoftRule("symbols", "10 * n_symbols > n_words", "2 * n_symbols > n_words"),
    SoftRule("lines", "100 * n_dup_lines > 30 * n_lines", "100 * n_dup_lines > 60 * n_lines"),
    SoftRule(
        "word_length",
        "word_chars > 10 * n_words OR word_chars < 3 * n_words",
        "word_chars > 20 * n_words OR word_chars < 2 * n_words",
    ),
)
BASE_FAILED = f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _repeated_words(starts: Column) -> Column:
    """Words covered by three-word windows at these ascending starts."""
    reach = F.transform(
        starts, lambda p, i: F.least(F.coalesce(F.get(starts, i + 1) - p, F.lit(3)), F.lit(3))
    )
    return F.aggregate(reach, F.lit(0), lambda total, n: total + n)


def measure(rows: DataFrame, text: Column, keep: list[str]) -> DataFrame:
    """``keep`` and a struct ``measures`` of each row; a null text has no words.

    Windows are compared by 64-bit hashes of their words, in sorted order, so a
    text of any length takes time in proportion to n log n.
    """
    words = F.array_remove(F.split(F.col("_text"), "[ \\t-\\r]+"), "")
    lines = F.filter(F.split(F.col("_text"), "\n"), lambda s: F.length(_without(s, _SPACE)) > 0)
    window = lambda i: F.xxhash64(
        F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)
    )
    windows = F.when(
        F.size("_words") > 3,
        F.sort_array(
            F.transform(
                F.sequence(F.lit(0), F.size("_words") - 3),
                lambda i: F.struct(window(i).alias("h"), i.alias("p")),
            )
        ),
    )
    same = lambda w, k: F.get("_windows", k)["h"] == w["h"]
    repeated = F.filter(
        F.col("_windows"),
        lambda w, k: F.coalesce((k > 0) & same(w, F.greatest(k - 1, F.lit(0))), F.lit(False))
        | F.coalesce(same(w, k + 1), F.lit(False)),
    )
    staged = (
        rows.select(*keep, F.coalesce(text.cast("string"), F.lit("")).alias("_text"))
        .select(*keep, "_text", words.alias("_words"), lines.alias("_lines"))
        .select(
            *keep,
            F.size("_words").cast("long").alias("n_words"),
            F.length(_without(F.col("_text"), _SPACE)).cast("long").alias("word_chars"),
            (F.length("_text") - F.length(_without(F.col("_text"), _SYMBOLS)))
            .cast("long")
            .alias("n_symbols"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            F.size("_lines").cast("long").alias("n_lines"),
            windows.alias("_windows"),
        )
        .withColumn("_windows", F.transform(repeated, lambda w: w["p"]))
        .withColumn("_windows", F.sort_array("_windows"))
        .withColumn(
            "n_repeat_words",
            F.coalesce(_repeated_words(F.col("_windows")), F.lit(0)).cast("long"),
        )
    )
    return staged.select(*keep, F.struct(*MEASURES).alias("measures"))


def _flag(condition: str) -> Column:
    """A condition on the fields of ``measures``."""
    for name in sorted(MEASURES, key=len, reverse=True):
        condition = condition.replace(name, f"measures.{name}")
    return F.expr(condition)


def with_flags(measured: DataFrame) -> DataFrame:
    """Add ``flags``: base failure, and slight and bad failure of each soft rule."""
    flags = [_flag(BASE_FAILED).alias("base_failed")]
    for rule in SOFT_RULES:
        flags += [_flag(rule.slight).alias(f"{rule.name}_slight")]
        flags += [_flag(rule.bad).alias(f"{rule.name}_bad")]
    return measured.withColumn("flags", F.struct(*flags))


def host_verdicts(flagged: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """Hosts that are bad in some rule: ``host`` and one boolean per rule.

    Rows without a host belong to none. The prior is fitted from one row of
    sums over the hosts. Alike rates (or a lone host) give a strong prior at
    their mean, so single hosts cannot stand out by chance.
    """
    names = [rule.name for rule in SOFT_RULES]
    hosts = materialise(
        flagged.where(F.col("host").isNotNull())
        .groupBy("host")
        .agg(
            F.count("*").alias("n_docs"),
            *(F.sum(F.col(f"flags.{n}_slight").cast("long")).alias(n) for n in names),
        ),
        "hosts",
    )
    rate = lambda n: F.col(n) / F.col("n_docs")
    sums = hosts.agg(
        F.count("*").alias("hosts"),
        F.sum("n_docs").alias("docs"),
        F.avg(1 / F.col("n_docs")).alias("inverse"),
        *(F.sum(n).alias(f"{n}_failed") for n in names),
        *(F.var_samp(rate(n)).alias(f"{n}_spread") for n in names),
    ).first()
    columns = []
    for n in names:
        mean = (sums[f"{n}_failed"] or 0) / (sums["docs"] or 1)
        chance = mean * (1 - mean)
        extra = (sums[f"{n}_spread"] or 0.0) - chance * (sums["inverse"] or 0.0)
        weight = min(1e6, max(MIN_PRIOR, chance / extra - 1)) if extra > 0 else 1e6
        shrunk = (F.col(n) + mean * weight) / (F.col("n_docs") + weight)
        columns.append((shrunk > host_limit).alias(n))
    bad = hosts.select("host", *columns)
    return bad.where(" OR ".join(names))


def judge(flagged: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """Join host verdicts back and add ``kept``.

    Only bad hosts are joined. They are broadcast if their measured size is
    small; else Spark joins by host and splits a host with very many rows.
    """
    bad = host_verdicts(flagged, host_limit).select(
        F.col("host").alias("_host"), F.struct(*(r.name for r in SOFT_RULES)).alias("_bad")
    )
    side = F.broadcast(bad) if fits_broadcast(bad) else bad
    failed = F.col("flags.base_failed")
    for rule in SOFT_RULES:
        by_host = F.col(f"flags.{rule.name}_slight") & F.coalesce(f"_bad.{rule.name}", F.lit(False))
        failed = failed | F.col(f"flags.{rule.name}_bad") | by_host
    joined = flagged.join(side, F.col("host") == F.col("_host"), "left")
    return joined.withColumn("kept", ~failed).drop("_host", "_bad")


def judged_documents(docs: DataFrame, host: Column) -> DataFrame:
    """Measures and verdict of each row of ``docs(doc_id, text)``.

    Null or empty texts have no words and fail; null hosts have no verdict of
    their own; repeated rows are judged (and counted) each; an empty table gives
    no rows. Other columns are not read.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), host.alias("host"), F.col("text").alias("_t")
    )
    flagged = with_flags(measure(rows, F.col("_t"), ["doc_id", "host"]))
    judged = judge(materialise(flagged, "measures"))
    return judged.select(
        "doc_id",
        *(F.col(f"measures.{m}").alias(m) for m in MEASURES[:5]),
        F.col("flags.base_failed").alias("base_failed"),
        "kept",
    )


def accepted_documents(docs: DataFrame, host: Column) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns as they were.

    Rows and their flags are written once; the host verdicts are then joined to
    them, so no text is measured twice or shuffled.
    """
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), host.alias("host")
    )
    flagged = with_flags(measure(rows, F.col("row.text"), ["row", "host"]))
    return judge(materialise(flagged, "flagged")).where("kept").select("row.*")
