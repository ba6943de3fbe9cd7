import numpy as np
import pytest
from pyspark.sql import functions as F

from casebrook.functions.vectors import l2_normalise
from casebrook.operators import cells, signatures
from casebrook.operators import neighbours as nb

rng = np.random.default_rng(7)


def corpus(n=600, dim=12, hot=0.34):
    """Unit vectors in clumps; one key holds a third of the rows, some vectors
    are equal and some are zero."""
    centres = rng.normal(size=(9, dim))
    vectors = centres[rng.integers(0, 9, n)] + 0.15 * rng.normal(size=(n, dim))
    vectors[n // 2 : n // 2 + 20] = vectors[3]
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors[10:14] = 0
    keys = [
        "hot" if rng.random() < hot else f"k{rng.integers(0, 40)}" for _ in range(n)
    ]
    return vectors.astype(np.float32), keys


def frame(spark, vectors, keys):
    rows = [
        (i * 3, key, [float(x) for x in v], f"text {i}")
        for i, (v, key) in enumerate(zip(vectors, keys))
    ]
    return spark.createDataFrame(
        rows,
        "chunk_id long, reference_number string, embedding array<float>, chunk_text string",
    ).repartition(5)


def brute(vectors, keys, own_of, k, one_per_key, barred=()):
    wide = vectors.astype(np.float64)
    scores = np.round(wide @ wide.T, 6) + 0.0
    ids = np.arange(len(keys)) * 3
    out = set()
    for q, own in own_of.items():
        seen, rank = set(), 0
        for j in np.lexsort((ids, -scores[q])):
            if keys[j] == own or ids[j] in barred or (one_per_key and keys[j] in seen):
                continue
            seen.add(keys[j])
            out.add((str(q), rank, int(ids[j]), float(scores[q][j])))
            rank += 1
            if rank == k:
                break
    return out


def queries_of(spark, vectors, own_of):
    rows = [(str(q), own, [float(x) for x in vectors[q]]) for q, own in own_of.items()]
    return spark.createDataFrame(
        rows, "query_id string, own_key string, query_vector array<float>"
    )


def result(hits):
    return {(r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in hits.collect()}


ROUTES = [
    {"route": "scan"},
    {"route": "routed", "n_pivots": 8, "tile_chunks": 40, "tile_queries": 30},
    {"route": "routed", "n_pivots": 40, "tile_chunks": 1000},
    {"route": "routed"},
]


@pytest.mark.parametrize("options", ROUTES)
@pytest.mark.parametrize("one_per_key", [False, True])
def test_equal_to_brute_force(spark, options, one_per_key):
    vectors, keys = corpus()
    own_of = {q: keys[q] if q % 5 else None for q in range(0, 600, 4)}
    hits = nb.search(
        queries_of(spark, vectors, own_of), frame(spark, vectors, keys), 7, one_per_key, **options
    )
    assert result(hits) == brute(vectors, keys, own_of, 7, one_per_key)
    row = hits.first()
    assert row["chunk_text"] == f"text {row['chunk_id'] // 3}"


@pytest.mark.parametrize("options", ROUTES[:2])
def test_more_wanted_than_there_is(spark, options):
    vectors, keys = corpus(30)
    own_of = {3: keys[3], 20: "none"}
    hits = nb.search(
        queries_of(spark, vectors, own_of), frame(spark, vectors, keys), 1000, False, **options
    )
    assert result(hits) == brute(vectors, keys, own_of, 1000, False)


def test_small_arrow_batches(spark):
    vectors, keys = corpus()
    own_of = {q: keys[q] for q in range(0, 600, 7)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        hits = nb.search(
            queries_of(spark, vectors, own_of), frame(spark, vectors, keys), 5, True, route="scan"
        )
        assert result(hits) == brute(vectors, keys, own_of, 5, True)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_auto_route_leaves_broadcast_beyond_the_bound(spark, monkeypatch):
    vectors, keys = corpus(200)
    own_of = {q: keys[q] for q in range(50)}
    chunks, queries = frame(spark, vectors, keys), queries_of(spark, vectors, own_of)
    monkeypatch.setattr(nb, "MAX_BROADCAST_QUERIES", 10)
    assert result(nb.search(queries, chunks, 3)) == brute(vectors, keys, own_of, 3, False)
    with pytest.raises(ValueError):
        nb.search(queries, chunks, 3, route="scan")


def test_no_queries_or_no_chunks(spark):
    vectors, keys = corpus(30)
    chunks, queries = frame(spark, vectors, keys), queries_of(spark, vectors, {1: "a"})
    assert nb.search(queries.limit(0), chunks, 3).count() == 0
    assert nb.search(queries.limit(0), chunks, 3, route="routed").count() == 0
    assert nb.search(queries, chunks.limit(0), 3).count() == 0
    assert nb.search(queries, chunks.limit(0), 3, route="routed").count() == 0


def test_duplicates_and_documents(spark):
    vectors, keys = corpus(120)
    own_of = {0: keys[0], 50: keys[50]}
    barred = [i * 3 for i in range(0, 120, 2)]
    chunks = frame(spark, vectors, keys)
    duplicates = spark.createDataFrame([(str(b),) for b in barred] + [("x",)], "chunk_id string")
    docs = spark.createDataFrame(
        [(9, "hot", "second"), (2, "hot", "the hot one"), (3, "other", "no")],
        "doc_ord long, reference_number string, doc_text string",
    )
    hits = nb.similar_chunks(
        queries_of(spark, vectors, own_of), chunks, 6, docs=docs, duplicates=duplicates
    )
    rows = hits.collect()
    expected = brute(vectors, keys, own_of, 6, True, set(barred))
    assert {(r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in rows} == expected
    for r in rows:
        plain = f"text {r['chunk_id'] // 3}"
        assert r["text"] == ("the hot one" if r["reference_number"] == "hot" else plain)
        assert r["meta"]["reference_number"] == r["reference_number"]
    everything = chunks.select("chunk_id")
    assert nb.similar_chunks(
        queries_of(spark, vectors, own_of), chunks, 6, duplicates=everything
    ).count() == 0


def test_overfetch_filters_afterwards(spark):
    vectors, keys = corpus(120)
    own_of = {0: keys[0], 7: keys[7]}
    chunks = frame(spark, vectors, keys)
    queries = queries_of(spark, vectors, own_of)
    got = result(nb.similar_chunks(queries, chunks, 4, overfetch=nb.usual_overfetch(False)))
    expected = set()
    for q, own in own_of.items():
        fetched = sorted(brute(vectors, keys, {q: None}, 8, False), key=lambda r: r[1])
        kept = [r for r in fetched if keys[r[2] // 3] != own][:4]
        expected |= {(r[0], i, r[2], r[3]) for i, r in enumerate(kept)}
    assert got == expected


def test_seeds_are_first_chunks(spark):
    vectors, keys = corpus(100)
    seeds = nb.seed_vectors(frame(spark, vectors, keys)).collect()
    assert {r["query_id"]: r["seed_chunk_id"] for r in seeds} == {
        key: keys.index(key) * 3 for key in set(keys)
    }
    wanted = spark.createDataFrame([("hot",), ("absent",)], "reference_number string")
    some = nb.seed_vectors(frame(spark, vectors, keys), wanted).collect()
    assert [r["own_key"] for r in some] == ["hot"]


def test_free_text(spark):
    vectors, keys = corpus(40, dim=3)
    asked = spark.createDataFrame(
        [("a", keys[5], "5"), ("b", None, "7")], "query_id string, own_key string, query_text string"
    )
    lookup = vectors.tolist()
    queries = nb.text_queries(asked, lambda texts: [lookup[int(t)] for t in texts])
    got = result(nb.similar_chunks(queries, frame(spark, vectors, keys), 2))
    expected = {("a", *r[1:]) for r in brute(vectors, keys, {5: keys[5]}, 2, False)}
    expected |= {("b", *r[1:]) for r in brute(vectors, keys, {7: None}, 2, False)}
    assert {r[:3] for r in got} == {r[:3] for r in expected}


def test_normalise(spark):
    rows = spark.createDataFrame(
        [(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [-2.0])], "i int, v array<float>"
    )
    out = {r["i"]: r["u"] for r in rows.select("i", l2_normalise(F.col("v")).alias("u")).collect()}
    assert out[1] == pytest.approx([0.6, 0.8]) and out[2] == [0.0, 0.0] and out[3] == [-1.0]


def test_corpus_is_not_shuffled_by_the_scan(spark):
    vectors, keys = corpus(50)
    chunks = frame(spark, vectors, keys)
    hits = nb.search(queries_of(spark, vectors, {1: "a"}), chunks, 3, route="scan")
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("MapInArrow")]
    assert "CartesianProduct" not in plan and "Join" not in plan
    assert above.count("RepartitionByExpression") == 1


def test_other_key_name(spark):
    vectors, keys = corpus(60)
    chunks = frame(spark, vectors, keys).withColumnRenamed("reference_number", "complaint_id")
    hits = nb.similar_chunks(
        queries_of(spark, vectors, {0: keys[0]}), chunks, 3, key_col="complaint_id"
    )
    row = hits.first()
    assert row["complaint_id"] == row["meta"]["complaint_id"]
    assert result(hits) == brute(vectors, keys, {0: keys[0]}, 3, False)


def test_chunks_without_vector_are_never_found(spark):
    vectors, keys = corpus(60)
    whole = frame(spark, vectors, keys)
    kept = whole.select("chunk_id", "embedding").filter("chunk_id >= 90")
    chunks = nb.attach_vectors(whole.drop("embedding"), kept)
    assert chunks.count() == 60
    got = result(nb.search(queries_of(spark, vectors, {40: "none"}), chunks, 4))
    assert got == brute(vectors, keys, {40: "none"}, 4, False, {i * 3 for i in range(30)})


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_lookups_on_both_sides_of_the_size_bound(spark, monkeypatch, bound):
    from casebrook.operators import corpus as records
    from casebrook.operators import sizing

    monkeypatch.setattr(sizing, "MAX_ROWS", bound)
    vectors, keys = corpus(200)
    chunks = frame(spark, vectors, keys)
    wanted = spark.createDataFrame([("hot",), ("absent",), ("hot",)], "reference_number string")
    seeds = nb.seed_vectors(chunks, wanted).collect()
    assert [(r["query_id"], r["seed_chunk_id"]) for r in seeds] == [("hot", keys.index("hot") * 3)]
    docs = chunks.select(
        F.col("chunk_id").alias("doc_ord"), "reference_number", F.col("chunk_text").alias("doc_text")
    )
    found = records.lookup_documents(docs, wanted).collect()
    assert [tuple(r) for r in found] == [
        ("hot", keys.index("hot") * 3, f"text {keys.index('hot')}")
    ]
    known, missing = records.split_known(wanted, docs)
    assert [r[0] for r in known.collect()] == ["hot", "hot"]
    assert [tuple(r) for r in missing.collect()] == [("absent", "Complaint absent not found.")]
    barred = chunks.filter("chunk_id % 2 = 0").select("chunk_id")
    got = result(nb.similar_chunks(
        queries_of(spark, vectors, {1: keys[1]}), chunks, 5, duplicates=barred
    ))
    assert got == brute(
        vectors, keys, {1: keys[1]}, 5, False, {i * 3 for i in range(200) if i * 3 % 2 == 0}
    )


def of_lengths(n=500, dim=10):
    """Clumped vectors of lengths from 1e-3 to 1e3, equal and zero ones among them."""
    vectors, keys = corpus(n, dim)
    vectors = vectors * np.exp2(rng.integers(-10, 11, n))[:, None].astype(np.float32)
    return vectors.astype(np.float32), keys


@pytest.mark.parametrize("one_per_key", [False, True])
@pytest.mark.parametrize("make", [of_lengths, lambda: (corpus(500)[0].astype(np.float16).astype(np.float32), corpus(500)[1])])
def test_vectors_of_any_length(spark, make, one_per_key):
    vectors, keys = make()
    own_of = {q: keys[q] if q % 5 else None for q in range(0, 500, 3)}
    hits = nb.search(
        queries_of(spark, vectors, own_of),
        frame(spark, vectors, keys),
        6,
        one_per_key,
        route="routed",
        n_pivots=30,
        tile_chunks=25,
        tile_queries=40,
    )
    assert {r[:3] for r in result(hits)} == {r[:3] for r in brute(vectors, keys, own_of, 6, one_per_key)}


def test_cells_bound_every_score(spark):
    vectors, keys = of_lengths()
    chunks = frame(spark, vectors, keys)
    pivots = cells.pivots_for(chunks, 10, 40)
    assert sorted(np.concatenate(pivots.groups).tolist()) == list(range(len(pivots.ids)))
    assigned = cells.assign(chunks, pivots, 10)
    found = cells.Cells.measured(assigned)
    cell_of = {r["chunk_id"] // 3: r["cell"] for r in assigned.collect()}
    wide = np.concatenate([vectors.astype(np.float64), -vectors[:20].astype(np.float64)])
    bound, error = found.reach(wide, pivots.directions)
    at = {int(c): i for i, c in enumerate(found.numbers)}
    column = np.array([at[cell_of[j]] for j in range(len(vectors))])
    scores = wide @ vectors.astype(np.float64).T
    assert (scores <= (bound + error)[:, column] + 1e-9).all()
    # most cells are out of reach of a query's best scores
    best = np.sort(scores, axis=1)[:, -6]
    assert (bound >= best[:, None]).mean() < 0.5


def test_only_zero_vectors(spark):
    vectors = np.zeros((40, 4), dtype=np.float32)
    keys = [f"k{i}" for i in range(40)]
    own_of = {0: keys[0], 7: None}
    hits = nb.search(queries_of(spark, vectors, own_of), frame(spark, vectors, keys), 3, route="routed", n_pivots=5)
    assert result(hits) == brute(vectors, keys, own_of, 3, False)
    vectors[39] = 1  # the pivots are likely zeros only
    hits = nb.search(queries_of(spark, vectors, {39: None}), frame(spark, vectors, keys), 3, route="routed", n_pivots=1)
    assert result(hits) == brute(vectors, keys, {39: None}, 3, False)


@pytest.mark.parametrize("lengths", [False, True])
def test_approximate_route_finds_most(spark, lengths):
    vectors, keys = of_lengths(900) if lengths else corpus(900)
    own_of = {q: keys[q] for q in range(0, 900, 5)}
    chunks, queries = frame(spark, vectors, keys), queries_of(spark, vectors, own_of)
    exact = nb.search(queries, chunks, 5, route="scan")
    found = nb.search(queries, chunks, 5, route="approximate", tile_chunks=64)
    counts = signatures.recall(found, exact).first()
    assert counts["n_exact"] == 5 * len(own_of) and counts["n_found"] >= 0.9 * counts["n_exact"]
    assert found.count() == found.select("query_id", "chunk_id").distinct().count()
    known = {r[:1] + r[2:] for r in brute(vectors, keys, own_of, 899, False)}
    if not lengths:
        assert {r[:1] + r[2:] for r in result(found)} <= known
