import json
import sys
from datetime import datetime

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from casebrook.operators import reports
from casebrook.operators.corpus import keys_in_order
from casebrook.operators.experiment import run_experiment, run_id_of
from casebrook.schemas import METRICS
from casebrook.sources.runs import ITEM_KEYS, RunStore

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # model runs in tasks
START = datetime(2024, 1, 2, 3, 4, 5)
CONFIGS = {
    "good": {"endpoint": "write-good", "temperature": 0.3, "max_tokens": 10},
    "poor": {"endpoint": "write-poor", "temperature": 0.6, "max_tokens": 10},
    "down": {"endpoint": "write-down", "temperature": 0.6, "max_tokens": 10},
}
PANEL = {"j1": "judge-1", "j2": "judge-2"}


def model(requests):
    out = []
    for r in requests:
        kind, name = r["endpoint"].split("-")
        if kind == "write":
            if name == "down" or (name == "poor" and "text B" in r["prompt"].split("similar kind")[0]):
                raise RuntimeError("unavailable")
            out.append(f"{name} summary")
        elif name == "2" and "poor summary" in r["prompt"]:
            out.append("cannot say")
        else:
            mark = 5 if "good summary" in r["prompt"] else 2
            out.append(json.dumps({m: mark for m in METRICS}))
    return out


def inputs(spark):
    docs = spark.createDataFrame(
        [(i, k, f"text {k}") for i, k in enumerate("ABC")],
        "doc_ord long, reference_number string, doc_text string",
    )
    chunks = spark.createDataFrame(
        [(1, "A", [1.0, 0.0], "a"), (2, "B", [0.6, 0.8], "b"), (3, "C", [0.0, 1.0], "c")],
        "chunk_id long, reference_number string, embedding array<float>, chunk_text string",
    )
    return docs, chunks


@pytest.fixture
def world(spark, tmp_path):
    return RunStore(spark, str(tmp_path / "store")), *inputs(spark)


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    """A store with one finished experiment, and its ranked result."""
    world = RunStore(spark, str(tmp_path_factory.mktemp("done"))), *inputs(spark)
    return world, run(world).collect()


def run(world, judges=PANEL, name="exp", keys=("B", "A", "nowhere", "A")):
    store, docs, chunks = world
    return run_experiment(
        store, name, docs, chunks, CONFIGS, judges, model,
        test_keys=keys_in_order(store.spark, list(keys)), k_neighbors=2, started_at=START,
    )


def test_experiment(done):
    (store, *_), ranked = done
    assert [r["llm_name"] for r in ranked] == ["good", "poor"]
    good, poor = ranked
    assert (good["avg_overall_score"], good["avg_judge_agreement"]) == (5.0, 1.0)
    assert good["avg_summary_length"] == len("good summary")
    assert poor["avg_overall_score"] == 2.5  # 2 and a neutral 3
    assert poor["avg_judge_agreement"] == pytest.approx(0.9)

    ids = {name: run_id_of("exp", name, START) for name in CONFIGS}
    runs = {r["run_id"]: r for r in store.read("runs").collect()}
    assert runs[ids["good"]]["run_name"] == "good_20240102_030405"
    assert set(runs) == set(ids.values())
    params = {r["key"]: r["value"] for r in store.read_run("run_params", ids["good"]).collect()}
    assert params == {
        "llm_name": "good", "llm_endpoint": "write-good", "temperature": "0.3",
        "max_tokens": "10", "k_neighbors": "2", "num_test_complaints": "4",
        "num_judges": "2", "judge_endpoints": "j1, j2",
    }
    metrics = {r["key"]: r["value"] for r in store.read_run("run_metrics", ids["good"]).collect()}
    assert {k for k in metrics if k[-1].isdigit()} == {f"{k}_{i}" for k in ITEM_KEYS for i in (0, 1, 3)}
    assert metrics["std_overall_score"] == 0.0 and metrics["avg_overall_score_std"] == 0.0
    assert store.read_run("run_metrics", ids["down"]).count() == 0
    poor_items = store.read_run("summaries", ids["poor"]).collect()
    assert [r["complaint_id"] for r in poor_items] == ["A", "A"]
    detail = store.read_run("judge_breakdown", ids["poor"]).filter("judge = 'j2'").first()
    assert detail["accuracy"] == 3.0
    assert detail["overall_assessment"] == "Failed to parse j2 evaluation"
    row = store.read_run("evaluations", ids["poor"]).first()
    assert row["n_failed_judges"] == 1 and row["individual_judge_scores"]["j1"]["clarity"] == 2.0


def test_writing_twice_changes_nothing(done):
    world, _ = done
    store = world[0]
    before = {t: store.read(t).count() for t in ("runs", "run_metrics", "summaries", "evaluations")}
    run(world)
    assert before == {t: store.read(t).count() for t in before}
    assert store.wide_runs("exp").count() == 3 and store.wide_runs("absent").count() == 0


def test_runs_are_added_beside_each_other(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "s"))
    for name in ("a", "b"):
        rows = [(name, "k", 1.0 if name == "a" else 2.0), (name, "l", 0.0)]
        store.write("run_metrics", spark.createDataFrame(rows, "run_id string, key string, value double"))
    assert store.read("run_metrics").count() == 4
    one = spark.createDataFrame([("a", "k", 9.0)], "run_id string, key string, value double")
    store.write("run_metrics", one)
    got = {(r["run_id"], r["key"]): r["value"] for r in store.read("run_metrics").collect()}
    assert got == {("a", "k"): 9.0, ("b", "k"): 2.0, ("b", "l"): 0.0}


def test_single_judge_experiment(world):
    store = world[0]
    ranked = run(world, judges="judge-1")
    assert "avg_judge_agreement" not in ranked.columns
    best = ranked.first()
    assert best["llm_name"] == "good" and best["avg_overall_score"] == 5.0
    good = run_id_of("exp", "good", START)
    keys = {r["key"] for r in store.read_run("run_metrics", good).collect()}
    assert keys == {f"{m}_{i}" for m in METRICS for i in (0, 1, 3)} | {
        *(f"avg_{m}" for m in METRICS), "avg_summary_length", "std_accuracy", "std_overall_score",
    }
    params = {r["key"]: r["value"] for r in store.read_run("run_params", good).collect()}
    assert params["judge_endpoint"] == "judge-1" and "num_judges" not in params
    assert store.read("judge_breakdown").count() == 0


def test_nothing_judged_gives_an_empty_result(world):
    ranked = run(world, keys=("nowhere",))
    assert ranked.count() == 0 and "avg_overall_score" in ranked.columns


def test_default_test_set(world):
    store, docs, chunks = world
    run_experiment(store, "d", docs, chunks, {"good": CONFIGS["good"]}, PANEL, model, started_at=START)
    assert store.read("summaries").count() == 3


def test_empty_store(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "none"))
    wide = reports.experiment_runs(store, "x")
    assert wide.count() == 0
    assert reports.comparison(wide).count() == 0
    assert reports.recommendations(reports.comparison(wide)).count() == 0
    assert reports.recent_runs(wide).count() == 0


def test_csv_export(done, spark, tmp_path):
    store, good = done[0][0], run_id_of("exp", "good", START)
    store.export_csv("evaluations", good, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert back.count() == 3
    nested = json.loads(back.first()["individual_judge_scores"])
    assert nested["j1"]["accuracy"] == 5.0


def test_reading_one_run_prunes(done):
    plan = done[0][0].read_run("summaries", "abc")._jdf.queryExecution().executedPlan().toString()
    assert "run_id" in plan[plan.index("PartitionFilters") :].split("]")[0]


def test_export_table(done, spark):
    compared = reports.comparison(reports.experiment_runs(done[0][0], "exp"))
    reports.export_comparison(compared, "results_for_test")
    reports.export_comparison(compared, "results_for_test")
    back = reports.exported_results(spark, "results_for_test").collect()
    assert [r["llm_name"] for r in back] == ["good", "poor", "down"]
    assert "avg_overall_score" in back[0].asDict()


def wide(spark, rows):
    """``(run_id, model, temperature, start, overall, accuracy, agreement)``."""
    base = spark.createDataFrame(
        rows, "run_id string, m string, t string, s string, o double, a double, g double"
    )
    named = base.select(
        "run_id",
        F.to_timestamp("s").alias("start_time"),
        F.lit("FINISHED").alias("status"),
        F.col("m").alias("params.llm_name"),
        F.col("t").alias("params.temperature"),
        *[
            F.col({"avg_accuracy": "a", "avg_judge_agreement": "g"}.get(n, "o")).alias(f"metrics.{n}")
            for n in reports.COMPARED_METRICS
        ],
    )
    return named


ROWS = [
    ("r1", "one", "0.6", "2024-01-01 00:00:00", 4.0, 2.0, 0.95),
    ("r2", "two", "10.0", "2024-01-02 00:00:00", 4.0, 5.0, 0.8),
    ("r3", None, "x", "2024-01-03 00:00:00", None, None, None),
    ("r4", "one-b", "0.3", "2024-01-01 00:00:00", float("nan"), 5.0, 0.1),
    ("r5", "two", "0.7", "2024-01-02 00:00:00", 3.0, 1.0, 0.75),
]


def test_ranking_ties_and_missing_values(spark):
    runs = wide(spark, ROWS)
    assert [r["run_id"] for r in reports.comparison(runs).collect()] == ["r2", "r1", "r5", "r3", "r4"]
    assert reports.winner(runs).first()["run_id"] == "r2"
    picks = {r["category"]: r["run_id"] for r in reports.recommendations(runs).collect()}
    assert picks == {
        "maximum accuracy": "r2", "best clarity": "r2", "conciseness": "r2", "overall balance": "r2",
    }
    assert [r["run_id"] for r in reports.recent_runs(runs, 3).collect()] == ["r3", "r2", "r5"]
    latest = {r["params.llm_name"]: r["run_id"] for r in reports.latest_per_model(runs).collect()}
    assert latest == {"one": "r1", "two": "r2", "one-b": "r4", None: "r3"}
    assert reports.pick_run(runs).first()["run_id"] == "r3"
    assert reports.pick_run(runs, "best").first()["run_id"] == "r2"


def test_temperature_sorts_as_a_number(spark):
    rows = reports.temperature_analysis(wide(spark, ROWS), "one|two").collect()
    assert [r["temperature"] for r in rows] == [0.3, 0.6, 0.7, 10.0]


def test_agreement_bands(spark):
    rows = {r["run_id"]: r for r in reports.agreement_report(wide(spark, ROWS)).collect()}
    assert {k: r["band"] for k, r in rows.items()} == {
        "r1": "very high", "r2": "high", "r3": None, "r4": "low", "r5": "moderate",
    }
    assert rows["r2"]["label"] == "80.0%" and rows["r2"]["high"] and not rows["r5"]["high"]


def test_chart_data(spark):
    runs = wide(spark, ROWS)
    points = reports.radar(runs, 2).collect()
    assert len(points) == 12
    first = [r for r in points if r["run_id"] == "r2"]
    assert first[0]["value"] == first[5]["value"] and first[5]["angle"] == 0.0
    assert first[1]["angle"] == pytest.approx(2 * 3.141592653589793 / 5)
    assert reports.small_multiples(runs, 4).count() == 24
    assert {r["label"] for r in reports.overall_bars(runs).collect()} >= {"4.00", "3.00"}


def test_judges(spark):
    rows = spark.createDataFrame(
        [("x", 1.0), ("x", 2.0), ("y", 4.0), ("z", 2.125), ("z", None)], "judge string, v double"
    )
    breakdown = rows.select("judge", *[F.col("v").alias(m) for m in METRICS])
    strict = reports.judge_strictness(breakdown).collect()
    assert [r["judge"] for r in strict] == ["x", "z", "y"]
    assert [r["strictness"] for r in strict] == [3.5, 2.88, 1.0]
    assert strict[0]["std_dev"] == 0.71 and strict[2]["std_dev"] is None
    assert reports.judge_means(breakdown).collect()[2]["accuracy"] == 2.12
    assert reports.judge_bars(breakdown).count() == 18


def test_samples(spark):
    runs = wide(spark, ROWS)
    summaries = spark.createDataFrame(
        [("r1", "c", "s1", 2), ("r2", "c", "s2", 2), ("r5", "c", "s5", 2), ("r5", "d", "x", 1)],
        "run_id string, complaint_id string, summary string, summary_length int",
    )
    shown = reports.sample_summaries(runs, summaries, "c").collect()
    assert [r["summary"] for r in shown] == ["s1", "s2", "s5"]
    newest = reports.sample_summaries(runs, summaries, "c", latest_only=True).collect()
    assert [r["summary"] for r in newest] == ["s1", "s2"]
    assert reports.sample_summaries(runs, summaries).count() == 4


def test_failures_and_reruns(spark, world):
    store, *_ = world
    run(world, keys=("B", "nowhere"))
    failed = {tuple(r) for r in store.read("failures").select("complaint_id", "step").collect()}
    assert failed == {("B", "summary"), ("nowhere", "record")}
    assert store.read("failures").filter("complaint_id = 'nowhere'").count() == len(CONFIGS)
    assert store.read("judge_breakdown").count() > 0
    store.clear([run_id_of("exp", name, START) for name in ("good", "poor")])
    left = {r["run_id"] for t in ("runs", "evaluations", "judge_breakdown", "failures")
            for r in store.read(t).select("run_id").collect()}
    assert left == {run_id_of("exp", "down", START)}
    with pytest.raises(ValueError):
        store.clear(["../other"])
