import json

import pytest
from pyspark.sql import functions as F

from casebrook.functions.verdicts import read_verdicts
from casebrook.operators import judging
from casebrook.plans.stand_ins import answer
from casebrook.schemas import CRITERIA, METRICS, REASONINGS


def full(**changes):
    verdict = {name: 4 for name in METRICS}
    verdict |= {name: f"why {name}" for name in REASONINGS}
    verdict["overall_assessment"] = "fine"
    verdict |= changes
    return {k: v for k, v in verdict.items() if v != "drop"}


TEXTS = [
    json.dumps(full()),
    json.dumps(full(), indent=2),
    "```json\n" + json.dumps(full()) + "\n```",
    "```" + json.dumps(full()) + "```\n",
    json.dumps(full()) + " and that is all",
    json.dumps(full()) + json.dumps(full()),
    json.dumps(full()) + " }",
    "Sure: " + json.dumps(full()),
    json.dumps(full())[:-5],
    str(full()),
    json.dumps(full(clarity="drop")),
    json.dumps(full(clarity=None)),
    json.dumps(full(clarity="4")),
    json.dumps(full(clarity=True)),
    json.dumps(full(clarity=4.25)),
    json.dumps(full(clarity=-1)),
    json.dumps(full(clarity_reasoning='braces } { and "quotes"')),
    json.dumps(full(extra={"a": {"b": [1, {"c": 2}]}})),
    json.dumps(full(extra={"a": 1})) + json.dumps({"b": 2}),
    json.dumps(full(overall_assessment="drop")),
    '{"accuracy": NaN}',
    '{"accuracy": 4,}',
    '{"accuracy": 04}',
    '{"accuracy_reasoning": "line\nbreak"}',
    "{}",
    "[]",
    "3",
    '"text"',
    "null",
    "",
    None,
]


def usable(text):
    """What a strict reader accepts as a verdict with numeric scores."""
    if text is None:
        return False
    bare = text.strip()
    for mark in ("```json", "```"):
        bare = bare.removeprefix(mark)
    try:
        value = json.loads(bare.removesuffix("```").strip())
    except json.JSONDecodeError:
        return False
    return isinstance(value, dict) and all(
        isinstance(value[m], int | float) and not isinstance(value[m], bool)
        for m in METRICS
        if m in value
    )


def test_reading_agrees_with_a_strict_parser(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, response string")
    got = {r["i"]: r["_ok"] for r in read_verdicts(rows).collect()}
    assert got == {i: usable(text) for i, text in enumerate(TEXTS)}


def answers(spark, rows):
    return spark.createDataFrame(
        [(*key, response, error) for key, response, error in rows],
        "item string, judge string, response string, error string",
    )


def test_parse_and_neutral_marks(spark):
    rows = answers(
        spark,
        [
            (("a", "x"), json.dumps(full(clarity="drop", clarity_reasoning="drop")), None),
            (("a", "y"), "not json", None),
            (("a", "z"), None, "LLM call failed: 500"),
        ],
    )
    got = {r["judge"]: r for r in judging.parse_verdicts(rows).collect()}
    assert got["x"]["clarity"] is None and got["x"]["accuracy"] == 4.0
    assert got["x"]["clarity_reasoning"] == "N/A" and not got["x"]["failed"]
    assert got["y"]["overall_assessment"] == "Failed to parse y evaluation"
    assert got["z"]["overall_assessment"] == "Error with z: LLM call failed: 500"
    for judge in "yz":
        assert got[judge]["failed"]
        assert [got[judge][m] for m in METRICS] == [3.0] * 6
        assert [got[judge][m] for m in REASONINGS] == ["N/A"] * 5


def test_single_judge(spark):
    rows = answers(
        spark,
        [
            (("a", "x"), json.dumps(full()), None),
            (("b", "x"), "prose", None),
            (("c", "x"), None, "timeout"),
        ],
    )
    got = {r["item"]: r for r in judging.single_verdicts(rows).collect()}
    assert set(got) == {"a", "b"}
    assert got["a"]["raw_response"] is None and got["a"]["overall_assessment"] == "fine"
    assert got["b"]["raw_response"] == "prose"
    assert got["b"]["overall_assessment"] == "Failed to parse evaluation"


def test_panel(spark):
    rows = answers(
        spark,
        [
            (("a", "x"), json.dumps(full(overall_score=5, clarity=1)), None),
            (("a", "y"), json.dumps(full(overall_score=1, clarity="drop")), None),
            (("a", "z"), "broken", None),
            (("b", "x"), json.dumps(full(clarity="drop")), None),
        ],
    )
    panel = judging.panel(judging.parse_verdicts(rows), ["item"])
    got = {r["item"]: r for r in panel.collect()}
    a = got["a"]
    assert a["overall_score"] == 3.0 and a["clarity"] == 2.0
    assert a["overall_score_std"] == pytest.approx((8 / 3) ** 0.5)
    assert tuple(a["overall_score_range"]) == (1.0, 5.0)
    assert tuple(a["clarity_range"]) == (1.0, 3.0)
    assert (a["num_judges"], a["n_failed_judges"]) == (3, 1)
    assert a["judge_agreement"] == pytest.approx(1 - (8 / 3) ** 0.5 / 5)
    assert a["overall_assessment"] == "Average of 3 judges. Agreement: 67.34%"
    assert a["reasoning_by_judge"]["clarity_reasoning"] == {
        "x": "why clarity_reasoning", "y": "why clarity_reasoning", "z": "N/A",
    }
    assert a["overall_assessments"]["z"] == "Failed to parse z evaluation"
    assert a["individual_judge_scores"]["y"]["clarity"] is None
    b = got["b"]
    assert (b["clarity"], b["clarity_std"], tuple(b["clarity_range"])) == (3.0, 0.0, (3.0, 3.0))
    assert (b["overall_score_std"], b["judge_agreement"]) == (0.0, 1.0)
    scores = judging.panel_scores(judging.parse_verdicts(rows), ["item"])
    assert {r["item"]: r["avg_clarity"] for r in scores.collect()} == {"a": 2.0, "b": 3.0}

    breakdown = {
        (r["item"], r["judge"]): r for r in judging.judge_breakdown(panel, ["item"]).collect()
    }
    assert len(breakdown) == 4
    assert breakdown["a", "y"]["clarity"] is None and breakdown["a", "z"]["accuracy"] == 3.0


def test_panel_is_one_shuffle(spark):
    rows = answers(spark, [(("a", "x"), "{}", None)])
    plan = judging.panel(judging.parse_verdicts(rows), ["item"])
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange hash") == 1


def test_absent_assessment_differs_by_view(spark):
    rows = answers(spark, [(("a", "x"), json.dumps(full(overall_assessment="drop")), None)])
    panel = judging.panel(judging.parse_verdicts(rows), ["item"])
    assert panel.first()["overall_assessments"] == {"x": "N/A"}
    assert judging.judge_breakdown(panel, ["item"]).first()["overall_assessment"] == ""


def test_judge_prompts_and_panel_expansion(spark):
    docs = spark.createDataFrame(
        [(1, "K", "x" * 30000), (2, "K", "later")],
        "doc_ord long, reference_number string, doc_text string",
    )
    made = spark.createDataFrame(
        [("K", "a {summary} here"), ("none", "s")], "reference_number string, summary string"
    )
    prompts = judging.judge_prompts(made, docs, "<{original_context}|{summary}>{{}}")
    assert [r["prompt"] for r in prompts.collect()] == ["<" + "x" * 20000 + "|a {summary} here>{}"]
    asked = judging.with_judges(prompts, {"j1": "e1", "j2": "e2"}).collect()
    assert [(r["judge"], r["endpoint"], r["temperature"], r["max_tokens"]) for r in asked] == [
        ("j1", "e1", 0.1, 2000),
        ("j2", "e2", 0.1, 2000),
    ]


def test_default_template_asks_for_every_field(spark):
    from string import Formatter

    text = "".join(part for part, *_ in Formatter().parse(judging.JUDGE_TEMPLATE))
    fields = (*METRICS, *REASONINGS, "overall_assessment")
    assert all(f'"{name}"' in text for name in fields)
    stand_in = json.loads(answer([{"endpoint": "grader-a", "prompt": "p"}])[0])
    assert set(CRITERIA) < set(stand_in)


def test_empty_panel(spark):
    none = answers(spark, [])
    assert judging.panel(judging.parse_verdicts(none), ["item"]).count() == 0
    assert judging.panel(judging.parse_verdicts(none), ["item"]).filter(F.lit(True)).columns
