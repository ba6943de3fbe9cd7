import pytest
from pyspark.sql import functions as F

from casebrook.functions import numbers, text
from casebrook.sources.corpus import documents, number_rows, quoted


def column(spark, values, build):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    out = rows.select("i", build(F.col("t")).alias("v")).orderBy("i").collect()
    return [r["v"] for r in out]


@pytest.mark.parametrize(
    "value, key",
    [
        (None, "unknown"),
        ("", "unknown"),
        ("no label here", "unknown"),
        ("reference_number: A-1 | x", "A-1"),
        ("REFERENCE_Number:\tA 2 | x", "A 2"),
        ("reference_number:    | x", ""),
        ("reference_number:| x", "unknown"),
        ("reference_number:| reference_number: second |", "second"),
        ("reference_number: one | reference_number: two", "one"),
        ("reference_number: line\nbreak | x", "line\nbreak"),
        ("see CDCR-12345 there", "CDCR-12345"),
        ("see CDCR-12 there", "unknown"),
        ("CDCR-99999 reference_number: L", "L"),
    ],
)
def test_reference_key(spark, value, key):
    assert column(spark, [value], text.reference_key) == [key]


def test_strip_like_python(spark):
    values = [
        " a ", " a b　", "\x1c\x1fa", "\n\t", "", "a", "  é\U0001f600  ",
        "​a​", "x" + " " * 5000 + "y",
    ]
    assert column(spark, values, text.strip) == [v.strip() for v in values]
    assert column(spark, values, text.is_blank) == [not v.strip() for v in values]


def test_last_index(spark):
    values = ["", "a. b. c", ". ", "\U0001f600. x", "none", "a | b\nc", " | "]
    assert column(spark, values, lambda t: text.last_index(t, ". ")) == [
        v.rfind(". ") for v in values
    ]
    assert column(spark, values, lambda t: text.last_index(t, ". ", "\n", " | ")) == [
        max(v.rfind(x) for x in (". ", "\n", " | ")) for v in values
    ]


def test_clip_counts_code_points(spark):
    assert column(spark, ["\U0001f600éab"], lambda t: text.clip(t, 3)) == ["\U0001f600éa"]


@pytest.mark.parametrize(
    "value, bare",
    [
        ("{}", "{}"),
        (" ```json\n{}\n``` \n", "{}"),
        ("```{}```", "{}"),
        ("```json```{}```", "{}"),
        ("{}```", "{}"),
        ("a ```json b", "a ```json b"),
        ("``````", ""),
    ],
)
def test_code_fence(spark, value, bare):
    assert column(spark, [value], text.strip_code_fence) == [bare]


def test_template_slots_in_documents_stay_text(spark):
    filled = column(
        spark,
        ["has {b} inside"],
        lambda t: text.fill_template("{{x}} {a}-{b}.", a=t, b=F.lit("{a}")),
    )
    assert filled == ["{x} has {b} inside-{a}."]


def test_rounding_and_bands(spark):
    rows = spark.createDataFrame(
        [(0.125,), (0.375,), (2.675,), (0.9,), (0.91,), (0.8,), (0.7999,), (0.7,), (0.2,), (None,)],
        "x double",
    ).select(
        numbers.round_half_even(F.col("x")).alias("r"),
        numbers.agreement_band(F.col("x")).alias("band"),
        numbers.fixed(F.col("x"), 1).alias("shown"),
    ).collect()
    assert [r["r"] for r in rows[:3]] == [0.12, 0.38, 2.68]
    assert [r["band"] for r in rows[3:]] == [
        "high", "very high", "high", "moderate", "moderate", "low", None,
    ]
    assert rows[-1]["shown"] is None


def test_fixed_rounds_the_exact_value(spark):
    values = [3.125, 2.675, 0.1235, 0.0005, 4.9995, 1.005, 99.995, -2.675, -0.001, 0.0, 1e12 + 0.25]
    values += [k / 16 for k in range(80)] + [k / 1000 + 0.0005 for k in range(200)]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select(
        "x", *[numbers.fixed(F.col("x"), d).alias(f"d{d}") for d in (1, 2, 3)]
    )
    for r in rows.collect():
        assert [r["d1"], r["d2"], r["d3"]] == [f"{r['x']:.{d}f}" for d in (1, 2, 3)]


def test_agreement_is_clamped(spark):
    rows = spark.createDataFrame([(0.0,), (1.0,), (5.0,), (7.0,)], "s double")
    out = [r[0] for r in rows.select(numbers.agreement(F.col("s"))).collect()]
    assert out == [1.0, 0.8, 0.0, 0.0]


def test_documents_default_text(spark):
    rows = spark.createDataFrame([(1, None), (2, "")], "doc_ord long, all_columns string")
    out = {r["doc_ord"]: (r["reference_number"], r["doc_text"]) for r in documents(rows).collect()}
    assert out == {1: ("unknown", "(no content)"), 2: ("unknown", "")}


def test_number_rows_is_stable(spark):
    numbered = number_rows(spark.range(1000).withColumnRenamed("id", "x").repartition(7))
    first = {r["x"]: r["doc_ord"] for r in numbered.collect()}
    assert first == {r["x"]: r["doc_ord"] for r in numbered.collect()}
    assert len(set(first.values())) == 1000


def test_quoted_name():
    assert quoted("a-b", "c`d") == "`a-b`.`c``d`"
