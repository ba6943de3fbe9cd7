"""Inputs at the edges of ids, norms and verdict texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from casebrook.functions.verdicts import read_verdicts
from casebrook.operators import cells
from casebrook.operators import neighbours as nb
from casebrook.operators.chunking import chunk_id
from casebrook.operators.neighbours import search
from casebrook.sources.corpus import number_rows


def test_ordinals_are_dense_over_many_splits(spark):
    rows = number_rows(spark.range(0, 2000, 1, 300).withColumnRenamed("id", "x"))
    got = [r.doc_ord for r in rows.orderBy("x").collect()]
    assert sorted(got) == list(range(2000))
    ids = [r.i for r in rows.select(chunk_id(F.col("doc_ord"), F.lit(3)).alias("i")).collect()]
    assert len(set(ids)) == 2000 and min(ids) > 0


@pytest.mark.parametrize("ordinal", [-1, 1 << 40])
def test_ordinals_out_of_range_are_an_error(spark, ordinal):
    df = spark.createDataFrame([(ordinal,)], "o long")
    with pytest.raises(Exception, match="out of range"):
        df.select(chunk_id(F.col("o"), F.lit(0))).collect()


def test_nesting_has_no_limit(spark):
    rows = []
    for depth in range(1, 21):
        body = '"notes": ' + '{"x": ' * depth + "1" + "}" * depth
        rows.append(("{" + body + ', "accuracy": 4}', True))
        rows.append(("{" + body + "} and {}", False))
        rows.append(("{" + body + "}{}", False))
    df = spark.createDataFrame(rows, "response string, good boolean")
    assert all(r._ok == r.good for r in read_verdicts(df).collect())


@pytest.mark.parametrize("off", [0.0, 1e-7, 1e-4, 9e-4])
def test_routes_agree_on_norms_near_one(spark, off):
    rng = np.random.default_rng(3)
    angles = rng.uniform(0, 2 * np.pi, 400)
    norms = 1 + rng.uniform(-off, off, 400)
    rows = [
        (i, f"k{i % 80}", "s", 0, "t", [float(n * np.cos(a)), float(n * np.sin(a))])
        for i, (a, n) in enumerate(zip(angles, norms))
    ]
    chunks = spark.createDataFrame(
        rows,
        "chunk_id long, reference_number string, section string, chunk_index long, "
        "chunk_text string, embedding array<float>",
    )
    queries = chunks.select(
        F.col("chunk_id").cast("string").alias("query_id"),
        F.col("reference_number").alias("own_key"),
        F.col("embedding").alias("query_vector"),
    )
    found = [
        sorted((r.query_id, r.chunk_id, r.score) for r in search(queries, chunks, 5, route=way, n_pivots=100, tile_chunks=40, tile_queries=40).collect())
        for way in ("scan", "routed")
    ]
    assert found[0] == found[1]


def test_many_cells_make_few_tiles_and_few_copies_of_a_query(spark):
    """Copies grow with neither cells nor small tiles asked for, once rows are many."""
    assert nb._tile_rows(32, 100_000, nb.CHUNK_TILES, 64) >= 100_000 / nb.CHUNK_TILES
    assert nb._tile_rows(32, 300, nb.CHUNK_TILES, 64) == 32
    random = np.random.default_rng(4)
    lengths = 2.0 ** random.integers(-6, 7, 900)
    vectors = random.normal(size=(900, 6)) * lengths[:, None]
    vectors[5] = 0
    chunks = spark.createDataFrame(
        [(i, f"k{i % 50}", [float(x) for x in v]) for i, v in enumerate(vectors)],
        "chunk_id long, reference_number string, embedding array<float>",
    )
    queries = chunks.selectExpr("string(chunk_id) AS query_id", "reference_number AS own_key", "embedding AS query_vector")
    pivots = cells.pivots_for(chunks, 6, 30)
    measured = cells.Cells.measured(cells.assign(chunks, pivots, 6))
    tiles = cells.Tiles.of(measured, pivots, 100)
    assert len(measured.numbers) > 100 and len(tiles.cells) <= 2 * 9 + 1
    assert sorted(np.concatenate(tiles.cells).tolist()) == list(range(len(measured.numbers)))
    rows = cells.route(queries, pivots, measured, tiles, 6, 5, False, 6).collect()
    assert max(len(r.tiles) for r in rows) <= len(tiles.cells)
    assert all(len(set(r.tiles)) == len(r.tiles) for r in rows)
