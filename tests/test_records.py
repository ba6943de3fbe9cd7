"""Commits, replaced runs, the answer ledger and run frames with any key."""

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from casebrook.operators.experiment import run_experiment, run_id_of
from casebrook.sources import inference
from casebrook.sources.commits import CommitLog
from casebrook.sources.ledger import AnswerLedger
from casebrook.sources.runs import TABLES, RunStore, all_keys, without_items

from test_runs import CONFIGS, PANEL, START, inputs, model

cloudpickle.register_pickle_by_value(sys.modules[__name__])
METRIC = "run_id string, key string, value double"


def metrics(spark, *rows):
    return spark.createDataFrame(list(rows), METRIC)


def stored(store, table="run_metrics"):
    return sorted((r["run_id"], r["key"], r["value"]) for r in store.read(table).collect())


def test_commits_are_numbered_and_later_ones_win(spark, tmp_path):
    one, two = (CommitLog(spark, str(tmp_path)) for _ in range(2))
    assert one.current() == {}
    assert one.commit("s1", {"t": ["a", "b"]}) == "000000000000.json"
    assert two.commit("s2", {"t": ["b"], "u": ["b"]}) == "000000000001.json"
    assert one.current() == {("t", "a"): "s1", ("t", "b"): "s2", ("u", "b"): "s2"}
    one.commit(None, {"t": ["a", "x"]})
    assert two.current() == {("t", "b"): "s2", ("u", "b"): "s2"}


def test_two_writers_never_share_a_number(spark, tmp_path, monkeypatch):
    log, other = CommitLog(spark, str(tmp_path)), CommitLog(spark, str(tmp_path))
    log.commit("s0", {"t": ["a"]})
    names = CommitLog._names
    monkeypatch.setattr(log, "_names", lambda: names(log)[:-1])  # the other's file is not seen yet
    assert other.commit("s1", {"t": ["b"]}) == "000000000001.json"
    assert log.commit("s2", {"t": ["c"]}) == "000000000002.json"
    assert other.current() == {("t", "a"): "s0", ("t", "b"): "s1", ("t", "c"): "s2"}


def test_a_failure_while_writing_leaves_the_old_runs(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "s"))
    store.write("run_metrics", metrics(spark, ("a", "k", 1.0), ("b", "k", 2.0)))
    with pytest.raises(RuntimeError):
        with store.replacing(["a"]) as snapshot:
            snapshot.write("run_metrics", metrics(spark, ("a", "k", 9.0)))
            raise RuntimeError("the driver dies here")
    assert stored(store) == [("a", "k", 1.0), ("b", "k", 2.0)]

    def broken(batches):
        yield from batches
        raise OSError("a task dies here")

    with pytest.raises(Exception, match="a task dies"):
        with store.replacing(["a"]) as snapshot:
            snapshot.write("run_metrics", metrics(spark, ("a", "k", 9.0)).mapInPandas(broken, METRIC))
    assert stored(store) == [("a", "k", 1.0), ("b", "k", 2.0)]
    store.vacuum()
    assert stored(store) == [("a", "k", 1.0), ("b", "k", 2.0)]
    with store.replacing(["a"]) as snapshot:
        snapshot.write("run_params", spark.createDataFrame([("a", "p", "v")], "run_id string, key string, value string"))
    assert stored(store) == [("b", "k", 2.0)] and stored(store, "run_params") == [("a", "p", "v")]
    before = {p.name for p in (tmp_path / "s" / "run_metrics").iterdir() if p.name.startswith("snapshot=")}
    store.vacuum()
    after = {p.name for p in (tmp_path / "s" / "run_metrics").iterdir() if p.name.startswith("snapshot=")}
    assert after == before and stored(store) == [("b", "k", 2.0)]
    store.clear(["b"])
    store.vacuum()
    assert stored(store) == [] and not [p for p in (tmp_path / "s" / "run_metrics").iterdir() if "=" in p.name]


def test_a_crashed_rerun_of_an_experiment_changes_nothing(spark, tmp_path, monkeypatch):
    store, (docs, chunks) = RunStore(spark, str(tmp_path / "s")), inputs(spark)
    go = lambda: run_experiment(
        store, "exp", docs, chunks, {"good": CONFIGS["good"]}, PANEL, model, k_neighbors=2, started_at=START
    )
    go()
    before = {t: sorted(map(str, store.read(t).collect())) for t in TABLES}
    from casebrook.sources import runs

    original = runs.Snapshot.write

    def dies(self, table, rows):
        if table == "run_metrics":
            raise ConnectionError("lost")
        original(self, table, rows)

    monkeypatch.setattr(runs.Snapshot, "write", dies)
    with pytest.raises(ConnectionError):
        go()
    assert before == {t: sorted(map(str, store.read(t).collect())) for t in TABLES}
    assert store.read_run("summaries", run_id_of("exp", "good", START)).count() == 3


# ------------------------------------------------------------------- ledger


def requests(spark, prompts):
    rows = [(i, p, "e", 0.5, 10) for i, p in enumerate(prompts)]
    return spark.createDataFrame(rows, "i int, prompt string, endpoint string, temperature double, max_tokens int")


def counting(folder, fails=()):
    """A model that leaves a file for every request it gets."""

    def call(batch):
        import uuid
        from pathlib import Path

        out = []
        for r in batch:
            (Path(folder) / uuid.uuid4().hex).write_text(r["prompt"] or "")
            out.append(ValueError("busy") if r["prompt"] in fails else f"to {r['prompt']}")
        return out

    return call


def asked(folder):
    names = sorted(p.read_text() for p in folder.iterdir())
    for p in folder.iterdir():
        p.unlink()
    return names


def test_only_failures_are_asked_again(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    book = AnswerLedger(spark, str(tmp_path / "ledger"))
    rows = requests(spark, ["a", "b", "a", "c", None, ""])
    first = {r["i"]: r for r in inference.complete(rows, counting(calls, {"b", "c"}), 2, ledger=book).collect()}
    assert asked(calls) == ["", "", "a", "b", "c"]  # the two requests for "a" are one; NULL is not empty
    assert first[0]["response"] == first[2]["response"] == "to a" and first[0]["error"] is None
    assert first[1]["error"] == "LLM call failed: busy" and first[1]["response"] is None
    assert list(first[0].asDict()) == ["i", "endpoint", "temperature", "max_tokens", "response", "error"]
    second = {r["i"]: r for r in inference.complete(rows, counting(calls), 2, ledger=book).collect()}
    assert asked(calls) == ["b", "c"]
    assert all(r["error"] is None for r in second.values()) and second[3]["response"] == "to c"
    third = inference.complete(rows, counting(calls, {"a", "b", "c"}), 2, ledger=book).collect()
    assert asked(calls) == [] and {r["i"]: r["response"] for r in third} == {i: r["response"] for i, r in second.items()}
    other = inference.complete(rows.withColumn("temperature", F.lit(0.6)), counting(calls), ledger=book)
    assert other.count() == 6 and len(asked(calls)) == 5  # another temperature is another request
    assert inference.complete(rows.limit(0), counting(calls), ledger=book).collect() == []


def test_a_dying_job_keeps_what_it_has_paid_for(spark, tmp_path, monkeypatch):
    calls = tmp_path / "calls"
    calls.mkdir()
    book = AnswerLedger(spark, str(tmp_path / "ledger"))
    rows = requests(spark, [f"p{i}" for i in range(40)])
    record, waves = AnswerLedger.record, []

    def dies(self, part, attempt):
        if len(waves) == 3:
            raise ConnectionError("lost")
        waves.append(attempt)
        record(self, part, attempt)

    monkeypatch.setattr(AnswerLedger, "record", dies)
    with pytest.raises(ConnectionError):
        inference.complete(rows, counting(calls), 4, ledger=book)
    paid = asked(calls)
    assert 0 < len(paid) < 40 and book.answers().count() == len(paid)
    monkeypatch.setattr(AnswerLedger, "record", record)
    out = inference.complete(rows, counting(calls), 4, ledger=book).collect()
    assert len(out) == 40 and sorted(asked(calls) + paid) == sorted(f"p{i}" for i in range(40))


def test_a_request_of_very_many_rows(spark, tmp_path, monkeypatch):
    calls = tmp_path / "calls"
    calls.mkdir()
    rows = requests(spark, ["hot"] * 3000 + [f"p{i}" for i in range(50)])
    for bound in (1 << 20, 0):
        from casebrook.operators import sizing

        monkeypatch.setattr(sizing, "MAX_ROWS", bound)
        book = AnswerLedger(spark, str(tmp_path / f"ledger{bound}"))
        out = inference.complete(rows, counting(calls), 8, ledger=book).collect()
        assert asked(calls) == sorted(["hot"] + [f"p{i}" for i in range(50)])
        assert len(out) == 3050 and sum(r["response"] == "to hot" for r in out) == 3000


def test_vectors_are_made_once_per_text(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    book = AnswerLedger(spark, str(tmp_path / "ledger"), inference.VECTOR)
    rows = spark.createDataFrame([(1, "abc"), (2, "abc"), (3, "z"), (4, None)], "i int, chunk_text string")

    def embed(texts):
        got = counting(calls)([{"prompt": t} for t in texts])
        return [[3.0 * len(g), 4.0 * len(g)] for g in got]

    out = {r["i"]: r for r in inference.embed_texts(rows, embed, ledger=book).collect()}
    assert sorted(asked(calls)) == ["", "abc", "z"] and out[1]["chunk_text"] == "abc"
    assert out[2]["embedding"] == pytest.approx([0.6, 0.8]) and out[2]["embed_error"] is None
    assert inference.embed_texts(rows, embed, ledger=book).count() == 4 and asked(calls) == []


def test_an_experiment_asks_only_for_what_is_missing(spark, tmp_path):
    store, (docs, chunks) = RunStore(spark, str(tmp_path / "s")), inputs(spark)
    book = AnswerLedger(spark, str(tmp_path / "ledger"))
    configs = {name: CONFIGS[name] for name in ("good", "poor")}
    calls = tmp_path / "calls"
    calls.mkdir()

    def noted(batch):
        counting(calls)(batch)
        return model(batch)

    go = lambda: run_experiment(
        store, "exp", docs, chunks, configs, PANEL, noted, k_neighbors=2, started_at=START, ledger=book
    )
    first = go().collect()
    n_first = len(asked(calls))
    failed = store.read("failures").count()
    assert failed == 1 and n_first == 6 + 2 * 5  # six summaries, one of which fails, and their verdicts
    assert go().collect() == first and len(asked(calls)) == failed


def test_embedding_sends_the_text_only(spark):
    rows = spark.createDataFrame([(1, "a", "wide")], "i int, chunk_text string, other string")
    out = inference.embed_texts(rows, lambda ts: [[1.0, 0.0] for _ in ts])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and "call_model(chunk_text" in plan
    assert out.columns == ["i", "chunk_text", "other", "embedding", "embed_error"]
    assert inference.embed_texts(out, lambda ts: [[0.0, 0.0] for _ in ts]).first()["embedding"] == [0.0, 0.0]


# --------------------------------------------------------------- any keys


def test_runs_with_any_key(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "s"))
    runs = [(r, "x", r, START, "FINISHED") for r in ("r1", "r2")]
    store.write("runs", spark.createDataFrame(runs, "run_id string, experiment string, run_name string, start_time timestamp, status string"))
    store.write("run_params", spark.createDataFrame([("r1", "llm_name", "m"), ("r2", "new one", "v")], "run_id string, key string, value string"))
    store.write("run_metrics", metrics(spark, ("r1", "avg_accuracy", 1.0), ("r1", "cost", 2.5), ("r2", "accuracy_0", 4.0), ("r2", "clarity_std_1", 1.0)))
    wide = store.wide_runs("x")
    rows = {r["run_id"]: r.asDict() for r in wide.collect()}
    assert rows["r2"]["params.new one"] == "v" and rows["r1"]["params.new one"] is None
    assert rows["r1"]["metrics.cost"] == 2.5 and rows["r1"]["metrics.avg_accuracy"] == 1.0
    assert "metrics.accuracy_0" not in wide.columns and "metrics.clarity_std_1" in wide.columns
    whole = {r["run_id"]: r.asDict() for r in store.wide_runs("x", items=True).collect()}
    assert whole["r2"]["metrics.accuracy_0"] == 4.0
    with pytest.raises(ValueError):
        all_keys(store.read("run_metrics"), (), most=2)
    assert without_items(store.read("run_metrics")).count() == 3
