import json

import pytest
from pyspark.sql import functions as F

from casebrook.operators import prompts
from casebrook.sources import inference


def test_embedding_batches_norms_and_errors(spark):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(10)], "i int, chunk_text string")

    def embed(texts):
        assert len(texts) <= 3
        if "t4" in texts:
            raise RuntimeError("x" * 900)
        return [[float(t[1:]), 0.0, 3.0] for t in texts]

    out = inference.embed_texts(rows.coalesce(1), embed, batch_size=3).orderBy("i").collect()
    assert out[0]["embedding"] == [0.0, 0.0, 1.0]
    assert out[9]["embedding"] == pytest.approx([9 / 90**0.5, 0, 3 / 90**0.5])
    failed = [r["i"] for r in out if r["embed_error"]]
    assert failed == [3, 4, 5]
    assert out[4]["embedding"] is None
    assert out[4]["embed_error"] == "Embedding call failed: " + "x" * 500


def test_completion_failures_stay_with_their_row(spark):
    rows = spark.createDataFrame(
        [("a", "e", 0.5, 10), ("boom", "e", 0.5, 10), ("c", "e", 0.5, 10)],
        "prompt string, endpoint string, temperature double, max_tokens int",
    ).withColumn("i", F.col("prompt"))

    def run(requests):
        if requests[0]["prompt"] == "boom":
            raise TimeoutError("too slow")
        return [f"{r['prompt']} {r['temperature']} {r['max_tokens']}" for r in requests]

    out = {r["i"]: r for r in inference.complete(rows, run, parallelism=2).collect()}
    assert out["a"]["response"] == "a 0.5 10" and out["a"]["error"] is None
    assert out["boom"]["response"] is None
    assert out["boom"]["error"] == "LLM call failed: too slow"
    wrong = inference.complete(rows, lambda requests: [], batch_size=2).collect()
    assert all("results for" in r["error"] for r in wrong)
    mixed = inference.complete(
        rows.coalesce(1), lambda rs: [ValueError("no") if r["prompt"] == "c" else "ok" for r in rs], 3
    )
    assert {r["i"]: r["error"] for r in mixed.collect()} == {
        "a": None, "boom": None, "c": "LLM call failed: no",
    }


def test_response_shapes(spark):
    vectors = [[1.0, 2.0], [3.0, 4.0]]
    texts = [
        json.dumps({"embeddings": vectors}),
        json.dumps({"data": [{"embedding": v, "index": 0} for v in vectors]}),
        json.dumps({"data": {"embeddings": vectors}}),
        json.dumps({"other": 1}),
        json.dumps({"data": []}),
        "oops",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, r string").orderBy("i")
    got = rows.select(inference.embeddings_of_response(F.col("r")).alias("v")).collect()
    assert [r["v"] for r in got] == [vectors] * 3 + [None] * 3
    chat = spark.createDataFrame(
        [(json.dumps({"choices": [{"message": {"content": "hi"}}]}),), ("{}",)], "r string"
    )
    out = chat.select(inference.content_of_response(F.col("r")).alias("c")).collect()
    assert [r["c"] for r in out] == ["hi", None]
    body = chat.select(inference.failure_text("Bad: ", F.lit("y" * 600)).alias("e")).first()
    assert body["e"] == "Bad: " + "y" * 500


def test_dimension_check(spark):
    rows = spark.createDataFrame([([1.0, 2.0],), ([3.0, 4.0],)], "embedding array<float>")
    assert inference.assert_one_dimension(rows) == 2
    with pytest.raises(ValueError):
        inference.assert_one_dimension(
            rows.union(spark.createDataFrame([([1.0],)], "embedding array<float>"))
        )


def test_neighbour_context_budgets(spark):
    hits = spark.createDataFrame(
        [("q", i, f"k{i}", 0.5 - i / 10, chr(97 + i) * 7000) for i in range(3)]
        + [("p", 0, "only", 0.12345, "short")],
        "query_id string, rank int, reference_number string, score double, text string",
    )
    got = {r["query_id"]: r["neighbor_text"] for r in prompts.neighbour_context(hits).collect()}
    assert got["p"] == "# Similar 0 (only) (score: 0.123)\nshort"
    whole = "\n\n---\n\n".join(
        f"# Similar {i} (k{i}) (score: {0.5 - i / 10:.3f})\n" + chr(97 + i) * 6000 for i in range(3)
    )
    assert got["q"] == whole[:12000]


def test_summary_prompt_without_neighbours(spark):
    targets = spark.createDataFrame(
        [("K", 1, "z" * 25000)], "reference_number string, doc_ord long, doc_text string"
    )
    none = spark.createDataFrame(
        [], "query_id string, rank int, reference_number string, score double, text string"
    )
    row = prompts.summary_prompts(targets, none, "[{target}]({neighbors})").first()
    assert row["prompt"] == "[" + "z" * 24000 + "]()"


def test_unknown_key_gets_a_message(spark):
    docs = spark.createDataFrame(
        [(1, "A", "text a"), (2, "B", "text b")],
        "doc_ord long, reference_number string, doc_text string",
    )
    chunks = spark.createDataFrame(
        [(1, "A", [1.0, 0.0], "a"), (2, "B", [0.6, 0.8], "b")],
        "chunk_id long, reference_number string, embedding array<float>, chunk_text string",
    )
    from casebrook.operators.neighbours import seed_vectors

    keys = spark.createDataFrame([("A",), ("zz",)], "reference_number string")
    out = prompts.summarise(
        keys, docs, chunks, seed_vectors(chunks, keys),
        lambda rs: [str("text b" in r["prompt"]) for r in rs], "e",
    )
    assert {r["reference_number"]: r["summary"] for r in out.collect()} == {
        "A": "True", "zz": "Complaint zz not found.",
    }
