import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casebrook.functions.spans import SpanRule, overlapping_spans
from casebrook.operators.chunking import chunk_documents
from casebrook.operators.corpus import corpus_stats


def plain_bounds(text, size, overlap):
    """Where spans begin and end, walked by hand."""
    back = int(size * 0.2)
    bounds, begin = [], 0
    while begin < len(text):
        stop = begin + size
        if stop < len(text) and back:
            tail = text[stop - back : stop]
            found = [tail.rfind(mark) for mark in (". ", "\n", " | ")]
            if max(found) >= 0:
                stop += max(found) + 1 - back
        bounds.append((begin, stop))
        begin = stop - overlap
    return bounds


def plain_spans(text, size, overlap):
    if len(text) <= size:
        return [text]
    return [text[b:e].strip() for b, e in plain_bounds(text, size, overlap)]


def spark_spans(spark, texts, rule):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    out = rows.select("i", overlapping_spans(F.col("t"), rule).alias("s")).orderBy("i")
    return [r["s"] for r in out.collect()]


WORDS = "ab c. d\ne | f  é\U0001f600"


@pytest.mark.parametrize("size, overlap", [(512, 128), (20, 5), (7, 0), (100, 80), (4, 3)])
def test_spans_equal_a_plain_walk(spark, size, overlap):
    texts = [
        "",
        "x",
        "x" * size,
        "x" * (size + 1),
        "y" * (2 * size - overlap),
        "z" * (2 * size - overlap + 1),
        " " * (3 * size),
        WORDS * 300,
        ("sentence one. " * 9 + "\n") * 40,
        "x" * (size - int(size * 0.2)) + ". " + "w" * 5000,
        "\U0001f600é" * 3000,
        "a | b" * 2000,
    ]
    rule = SpanRule(size, overlap)
    assert spark_spans(spark, texts, rule) == [plain_spans(t, size, overlap) for t in texts]


def test_very_long_text(spark):
    text = ("word and more. " * 20 + "\n") * 4000
    assert spark_spans(spark, [text], SpanRule()) == [plain_spans(text, 512, 128)]


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet=WORDS, max_size=2500), min_size=1, max_size=12))
def test_random_texts(spark, texts):
    got = spark_spans(spark, texts, SpanRule(64, 16))
    assert got == [plain_spans(t, 64, 16) for t in texts]
    assert all(len(s) <= 64 for spans in got for s in spans)


def test_spans_cover_the_text():
    text = WORDS * 400
    bounds = plain_bounds(text, 512, 128)
    assert bounds[0][0] == 0 and bounds[-1][1] >= len(text)
    assert all(0 < e - b2 <= 128 for (_, e), (b2, _) in zip(bounds, bounds[1:]))


@pytest.mark.parametrize("size, overlap", [(0, 0), (10, -1), (512, 411), (10, 10)])
def test_rules_without_progress_are_rejected(size, overlap):
    with pytest.raises(ValueError):
        SpanRule(size, overlap)


def chunks_of(spark, text, **options):
    docs = spark.createDataFrame(
        [(5, "K", text)], "doc_ord long, reference_number string, doc_text string"
    )
    rows = chunk_documents(docs, **options).orderBy("chunk_ord").collect()
    assert [r["chunk_ord"] for r in rows] == list(range(len(rows)))
    assert [r["chunk_id"] for r in rows] == [5 * 2**23 + i for i in range(len(rows))]
    return [(r["section"], r["chunk_index"], r["total_chunks"], r["chunk_text"]) for r in rows]


def test_titled_sections(spark):
    text = "lead\n## One\nfirst body\n## Two words \n## Three\n" + "long. " * 200
    got = chunks_of(spark, text)
    assert got[:3] == [
        ("Main", 0, 1, "lead\n"),
        ("One", 0, 1, "## One\n\nfirst body\n"),
        ("Two words", 0, 1, "## Two words \n"),
    ]
    body = "## Three\n\n" + "long. " * 200
    spans = plain_spans(body, 512, 128)
    assert got[3:] == [("Three", i, len(spans), s) for i, s in enumerate(spans)]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("", []),
        (" \n ", []),
        ("plain", [("Main", 0, 1, "plain")]),
        ("## First\nx", [("First", 0, 1, "## First\n\nx")]),
        ("x\n## Last", [("Main", 0, 1, "x\n"), ("Last", 0, 1, "## Last\n")]),
        ("## A\n## B\ny", [("A", 0, 1, "## A\n"), ("B", 0, 1, "## B\n\ny")]),
        ("## A\na\n## A\nb", [("A", 0, 1, "## A\n\na\n"), ("A", 0, 1, "## A\n\nb")]),
        ("###no\n##none\n # x", [("Main", 0, 1, "###no\n##none\n # x")]),
    ],
)
def test_section_edges(spark, text, expected):
    assert chunks_of(spark, text) == expected


def test_literal_mode_loses_short_sections(spark):
    long = "word. " * 100
    assert chunks_of(spark, "short\n## $\nend", literal=True) == [("$", 0, 1, "## $\n\nend")]
    assert chunks_of(spark, "##  $\nend", literal=True) == [(" $", 0, 1, "##  $\n\nend")]
    got = chunks_of(spark, long + "\n## $\nend", literal=True)
    spans = plain_spans(long + "\n", 512, 128)
    assert got == [("Main", i, len(spans), s) for i, s in enumerate(spans)] + [
        ("$", 0, 1, "## $\n\nend")
    ]


def test_literal_mode_takes_an_opening_mark_as_one_header(spark):
    text = "## Title line\n" + "word " * 300
    got = chunks_of(spark, text, literal=True)
    assert got == [(text.strip()[3:], 0, 1, text + "\n")]


def test_whole_documents(spark):
    text = "word. " * 300
    spans = plain_spans(text, 100, 10)
    got = chunks_of(spark, text, preserve_sections=False, chunk_size=100, chunk_overlap=10)
    assert got == [("Full-doc", i, len(spans), s) for i, s in enumerate(spans)]
    assert chunks_of(spark, "", preserve_sections=False) == [("Full-doc", 0, 1, "")]


def test_stats(spark):
    docs = spark.createDataFrame(
        [(1, "A", "x" * 600), (2, "A", "y"), (3, "B", "z")],
        "doc_ord long, reference_number string, doc_text string",
    )
    row = corpus_stats(docs, chunk_documents(docs)).first()
    assert tuple(row) == (3, 2, 4, pytest.approx(4 / 3))
    none = corpus_stats(docs.limit(0), chunk_documents(docs.limit(0))).first()
    assert tuple(none) == (0, 0, 0, None)


def test_no_shuffle_while_chunking(spark):
    docs = spark.range(5).select(
        F.col("id").alias("doc_ord"),
        F.lit("k").alias("reference_number"),
        F.lit("text").alias("doc_text"),
    )
    plan = chunk_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
