"""Exact nearest-chunk search over a chunk table that carries its vectors.

Two physical routes give the same rows.

``scan``    The queries fit a checked bound, are broadcast, and every task
            compares its own chunk batches with all of them by matrix product.
            The corpus is read once and never shuffled; each task emits at
            most ``k`` rows per query.
``routed``  The query set is beyond that bound. Chunks go to cells of like
            direction and length (``cells``). Tiles of bounded size hold near
            cells together or a share of a large one, so a cell that holds a
            third of all rows is just more tiles. A query is sent once to each
            tile that can still hold one of its best ``k`` and meets small leaves of
            like rows there, most promising first, as long as they can (``leaves``).
            The test is exact for vectors of any length.

Scores are dot products, rounded so that the order of a sum in a matrix product
cannot change a ranking; ties go to the lower chunk id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casebrook.operators import cells, signatures
from casebrook.operators.blockscore import (
    BlockTopK,
    best_of_batch,
    key_codes,
    matrix,
    merge_best,
)
from casebrook.operators.corpus import lookup_documents
from casebrook.operators.leaves import Leaves
from casebrook.operators.sizing import fits_broadcast
from casebrook.sources.inference import EMBED_BATCH, embed_texts
from casebrook.sources.storage import materialise

# --- fixed values -----------------------------------------------------------
K = 10
OVERFETCH_WITH_EXCLUSION = 5
OVERFETCH_PLAIN = 2
# ----------------------------------------------------------------------------
SCORE_DIGITS = 6
MAX_BROADCAST_QUERIES = 16384
MAX_BROADCAST_BYTES = 32 << 20
MAX_KEPT_ROWS = 200_000  # rows a scan task may hold: queries * k
MERGE_SALTS = 32
TILE_BYTES = 64 << 20  # vectors of either side of a tile; equal sides copy least
# copies that tiles make of a query and of a chunk, unless TILE_BYTES asks for more
CHUNK_TILES = 12
QUERY_TILES = 4
LEAST_TILE = 1024  # rows of a tile that nobody gave a size
TASK_PAIRS = 1 << 27  # pairs of query and chunk that are worth a task
PAYLOAD = ("section", "chunk_index", "chunk_text")


# ---------------------------------------------------------------- query side


def seed_vectors(chunks: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """One query per key: the vector of the key's first chunk.

    First chunk ids are found on narrow columns and their vectors picked out by
    id: vectors are neither sorted nor aggregated, and stay where they are when
    the ids fit a broadcast. Keys without chunks give no row. A key whose first
    chunk has no vector keeps its row with a NULL ``query_vector``: no other
    chunk stands in for it, and no search finds anything for it.
    """
    rows = chunks.select("reference_number", "chunk_id", "embedding")
    narrow = rows.select("reference_number", "chunk_id")
    small = False
    if keys is not None:
        wanted = keys.select("reference_number").distinct()
        small = fits_broadcast(wanted)
        narrow = narrow.join(
            F.broadcast(wanted) if small else wanted, "reference_number", "left_semi"
        )
    winners = narrow.groupBy("reference_number").agg(F.min("chunk_id").alias("seed_chunk_id"))
    winners = winners.select("seed_chunk_id")
    # one row per wanted key: within the same bound
    winners = F.broadcast(winners) if small else winners.hint("shuffle_hash")
    return rows.join(winners, F.col("chunk_id") == F.col("seed_chunk_id")).select(
        F.col("reference_number").alias("query_id"),
        F.col("reference_number").alias("own_key"),
        "seed_chunk_id",
        F.col("embedding").alias("query_vector"),
    )


def text_queries(
    queries: DataFrame, embed_fn, batch_size: int = EMBED_BATCH, on_error: str = "raise"
) -> DataFrame:
    """Queries ``(query_id, own_key, query_text)`` embedded by ``embed_fn``.

    A failed call raises. With ``on_error="keep"`` its queries stay, with NULL
    for a vector and the message in ``embed_error``; a search skips them.
    """
    embedded = embed_texts(
        queries.select("query_id", "own_key", "query_text"), embed_fn, "query_text", batch_size
    )
    rows = materialise(
        embedded.select(
            "query_id", "own_key", F.col("embedding").alias("query_vector"), "embed_error"
        ),
        "query-vectors",
    )
    if on_error == "keep":
        return rows
    failed = rows.filter(F.col("embed_error").isNotNull()).first()
    if failed is not None:
        raise RuntimeError(f"query {failed['query_id']}: {failed['embed_error']}")
    return rows.drop("embed_error")


def attach_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks with vectors kept in a table of their own, joined on the unique
    chunk id. Chunks without a vector stay, with NULL, and are never found."""
    return chunks.join(vectors.select("chunk_id", "embedding"), "chunk_id", "left")


# ------------------------------------------------------------- final ranking


def _rank_salted(hits: DataFrame, k: int, one_per_key: bool) -> DataFrame:
    """Best ``k`` hits of each query from rows that tasks already thinned.

    A query's hits are first ranked in ``MERGE_SALTS`` independent groups, so
    the one final group of a query holds at most ``salts * k`` rows. With one
    hit per key the key chooses the salt, so that its repeats meet before the
    cut; otherwise the chunk does, and no key's chunks gather in one group.
    """
    by = "reference_number" if one_per_key else "chunk_id"
    salted = hits.withColumn(
        "salt", F.pmod(F.xxhash64(by), F.lit(MERGE_SALTS)).cast("int")
    ).repartition("query_id", "salt")
    best_first = [F.desc("score"), F.asc("chunk_id")]
    if one_per_key:
        within_key = Window.partitionBy("query_id", "salt", "reference_number").orderBy(
            *best_first
        )
        salted = (
            salted.withColumn("rn", F.row_number().over(within_key))
            .filter("rn = 1")
            .drop("rn")
        )
    within_salt = Window.partitionBy("query_id", "salt").orderBy(*best_first)
    thinned = (
        salted.withColumn("rn", F.row_number().over(within_salt))
        .filter(F.col("rn") <= k)
        .drop("rn", "salt")
    )
    return _rank(thinned, k)


def _rank_once(hits: DataFrame, k: int, one_per_key: bool) -> DataFrame:
    """The same of hits of tiles, shuffled once: a query has ``k`` of each at most."""
    hits = hits.repartition("query_id")
    if one_per_key:
        within_key = Window.partitionBy("query_id", "reference_number").orderBy(
            F.desc("score"), F.asc("chunk_id")
        )
        hits = hits.withColumn("rn", F.row_number().over(within_key)).filter("rn = 1").drop("rn")
    return _rank(hits, k)


def _rank(hits: DataFrame, k: int) -> DataFrame:
    whole = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("chunk_id"))
    return (
        hits.withColumn("rn", F.row_number().over(whole))
        .filter(F.col("rn") <= k)
        .withColumn("rank", F.col("rn") - 1)
        .drop("rn")
    )


# ---------------------------------------------------------------------- scan


def _scan(
    queries: list, chunks: DataFrame, k: int, one_per_key: bool, digits: int
) -> DataFrame:
    spark = chunks.sparkSession
    dim = len(queries[0]["query_vector"])
    block = spark.sparkContext.broadcast(
        (
            np.array([q["query_vector"] for q in queries], dtype=np.float64),
            [q["own_key"] for q in queries],
            np.array([q["query_id"] for q in queries], dtype=object),
        )
    )
    payload = [f for f in chunks.schema.fields if f.name in PAYLOAD]
    columns = ["chunk_id", "reference_number", "embedding", *[f.name for f in payload]]
    out = T.StructType(
        [
            T.StructField("query_id", T.StringType()),
            T.StructField("chunk_id", T.LongType()),
            T.StructField("reference_number", T.StringType()),
            *payload,
            T.StructField("score", T.DoubleType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, own_keys, ids = block.value
        scorer = BlockTopK(vectors, own_keys, k, one_per_key, digits)
        kept: pa.Table | None = None
        for batch in batches:
            if batch.num_rows:
                kept = merge_best(
                    scorer, kept, best_of_batch(scorer, pa.Table.from_batches([batch]), dim)
                )
        if kept is not None and kept.num_rows:
            named = pa.array(ids[kept["query"].to_numpy()].tolist(), type=pa.string())
            result = kept.append_column("query_id", named).select(out.names)
            yield from result.combine_chunks().to_batches()

    return chunks.select(*columns).mapInArrow(run, out)


# -------------------------------------------------------------------- routed


def _tile_best(dim: int, k: int, one_per_key: bool, digits: int, out: pa.Schema):
    def run(chunk_side: pa.Table, query_side: pa.Table) -> pa.Table:
        if not chunk_side.num_rows or not query_side.num_rows:
            return out.empty_table()
        ids = np.array(query_side["query_id"].to_pylist(), dtype=object)
        scorer = BlockTopK(
            matrix(query_side["query_vector"], dim),
            query_side["own_key"].to_pylist(),
            k,
            one_per_key,
            digits,
        )
        kept: pa.Table | None = None
        narrow = chunk_side.select(["chunk_id", "reference_number", "embedding"])
        for batch in narrow.combine_chunks().to_batches(max_chunksize=8192):
            kept = merge_best(
                scorer, kept, best_of_batch(scorer, pa.Table.from_batches([batch]), dim)
            )
        named = pa.array(ids[kept["query"].to_numpy()].tolist(), type=pa.string())
        return kept.append_column("query_id", named).select(out.names).cast(out)

    return run


def _tile_rows(asked: int | None, rows: int, most: int, dim: int) -> int:
    """Rows of one side of a tile: as asked, but no more than ``most`` tiles as
    long as they stay within ``TILE_BYTES``, for each is a copy of the other side."""
    bound = max(LEAST_TILE, TILE_BYTES // (4 * dim))
    return max(asked or LEAST_TILE, min(bound, math.ceil(rows / most)))


def _leaves_best(dim: int, k: int, one_per_key: bool, digits: int, out: pa.Schema):
    """The best of a tile for its queries, leaf by leaf."""

    def run(chunk_side: pa.Table, query_side: pa.Table) -> pa.Table:
        if not chunk_side.num_rows or not query_side.num_rows:
            return out.empty_table()
        flat = chunk_side["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        keys = chunk_side["reference_number"].combine_chunks()
        code, names = key_codes(keys)
        chunk = chunk_side["chunk_id"].to_numpy()
        leaves = Leaves(flat.reshape(len(chunk), dim), chunk, code, k, one_per_key)
        place = {name: at for at, name in enumerate(names)}
        owned = query_side["own_key"].to_pylist()
        own = np.array([-2 if o is None else place.get(o, -2) for o in owned], dtype=np.int64)
        vectors = matrix(query_side["query_vector"], dim)
        query, score, row, _ = leaves.best(vectors, own, query_side["bar"].to_numpy(), digits)
        row = leaves.rows[row]
        named = query_side["query_id"].combine_chunks().take(pa.array(query))
        columns = [named, pa.array(chunk[row]), keys.take(pa.array(row)), pa.array(score)]
        return pa.Table.from_arrays(columns, schema=out)

    return run


HITS = pa.schema(
    [
        ("query_id", pa.string()),
        ("chunk_id", pa.int64()),
        ("reference_number", pa.string()),
        ("score", pa.float64()),
    ]
)
HIT_COLUMNS = "query_id string, chunk_id long, reference_number string, score double"


def _routed(
    queries: DataFrame,
    n_queries: int,
    dim: int,
    chunks: DataFrame,
    k: int,
    one_per_key: bool,
    digits: int,
    n_pivots: int | None,
    tile_chunks: int | None,
    tile_queries: int | None,
) -> DataFrame:
    """Best hits of every query in every tile it visits.

    A query is sent at most once to a tile, however many cells it visits there:
    what is shuffled and found grows with the tiles, not with the cells.
    """
    spark = chunks.sparkSession
    pivots = cells.pivots_for(chunks, dim, n_pivots)
    assigned = materialise(cells.assign(chunks, pivots, dim), "cells")
    measured = cells.Cells.measured(assigned)
    tile_chunks = _tile_rows(tile_chunks, sum(measured.counts.values()), CHUNK_TILES, dim)
    tiles = cells.Tiles.of(measured, pivots, tile_chunks)
    down = math.ceil(n_queries / _tile_rows(tile_queries, n_queries, QUERY_TILES, dim))
    scouts = cells.scouts_for(assigned, sum(measured.counts.values()), dim)
    routed = materialise(
        cells.route(queries, pivots, measured, tiles, dim, k, one_per_key, digits, scouts), "routes"
    )
    layout = spark.createDataFrame(
        list(zip(measured.numbers.tolist(), tiles.first.tolist(), tiles.across.tolist())),
        "cell int, first int, across int",
    )
    share = F.pmod(F.xxhash64("chunk_id"), F.col("across")).cast("int")
    chunk_side = (
        assigned.join(F.broadcast(layout), "cell")  # one row per cell in use
        .withColumn("tile", F.col("first") + share)
        .withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
        .select("tile", "y", "chunk_id", "reference_number", "embedding")
    )
    query_side = routed.select(
        F.explode("tiles").alias("tile"),
        F.pmod(F.xxhash64("query_id"), F.lit(down)).cast("int").alias("y"),
        "query_id",
        "own_key",
        "query_vector",
        "bar",
    )
    # few rows and much work in each: tiles are dealt out, not put together by size
    pairs = n_queries * sum(measured.counts.values())
    parts = max(1, min(len(tiles.cells) * down, pairs // TASK_PAIRS))
    chunk_side, query_side = (s.repartition(parts, "tile", "y") for s in (chunk_side, query_side))
    met = chunk_side.groupBy("tile", "y").cogroup(query_side.groupBy("tile", "y"))
    return met.applyInArrow(_leaves_best(dim, k, one_per_key, digits, HITS), HIT_COLUMNS)


def _approximate(
    queries: DataFrame,
    dim: int,
    chunks: DataFrame,
    k: int,
    one_per_key: bool,
    digits: int,
    tables: int,
    probes: int,
    tile_chunks: int | None,
    tile_queries: int | None,
) -> DataFrame:
    bits = signatures.bits_for(chunks.count())
    assigned = materialise(signatures.buckets(chunks, dim, tables, bits), "buckets")
    # a table has 2 ** bits buckets at most
    counts = {r["cell"]: r["count"] for r in assigned.groupBy("cell").count().collect()}
    routed = materialise(signatures.visits(queries, dim, tables, bits, probes), "routes")
    hits = _in_tiles(
        assigned, counts, routed, dim, k, one_per_key, digits, tile_chunks, tile_queries
    )
    return hits.dropDuplicates(["query_id", "chunk_id"])  # tables overlap


def _in_tiles(
    assigned: DataFrame,
    counts: dict[int, int],
    routed: DataFrame,
    dim: int,
    k: int,
    one_per_key: bool,
    digits: int,
    tile_chunks: int | None,
    tile_queries: int | None,
) -> DataFrame:
    """Best hits of every query in every tile of the cells it visits."""
    tile_chunks = tile_chunks or max(1024, TILE_BYTES // (4 * dim))
    tile_queries = tile_queries or max(1024, TILE_BYTES // (4 * dim))
    wanted = {
        row["cell"]: row["n"]
        for row in routed.select(F.explode("cells").alias("cell"))
        .groupBy("cell")
        .agg(F.count("*").alias("n"))
        .collect()
    }
    layout = assigned.sparkSession.createDataFrame(
        [
            (
                cell,
                max(1, math.ceil(counts[cell] / tile_chunks)),
                max(1, math.ceil(n / tile_queries)),
            )
            for cell, n in wanted.items()
            if cell in counts
        ],
        "cell int, across int, down int",
    )
    layout = F.broadcast(layout)  # one row per cell in use

    def upto(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    chunk_side = (
        assigned.join(layout, "cell")
        .withColumn("x", F.pmod(F.xxhash64("chunk_id"), F.col("across")).cast("int"))
        .withColumn("y", upto("down"))
        .select("cell", "x", "y", "chunk_id", "reference_number", "embedding")
    )
    query_side = (
        routed.select("query_id", "own_key", "query_vector", F.explode("cells").alias("cell"))
        .join(layout, "cell")
        .withColumn("y", F.pmod(F.xxhash64("query_id"), F.col("down")).cast("int"))
        .withColumn("x", upto("across"))
        .select("cell", "x", "y", "query_id", "own_key", "query_vector")
    )
    tiles = chunk_side.groupBy("cell", "x", "y").cogroup(
        query_side.groupBy("cell", "x", "y")
    )
    return tiles.applyInArrow(_tile_best(dim, k, one_per_key, digits, HITS), HIT_COLUMNS)


# ---------------------------------------------------------------- public API


def search(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = K,
    one_per_key: bool = False,
    exclude_own: bool = True,
    score_digits: int = SCORE_DIGITS,
    route: str = "auto",
    n_pivots: int | None = None,
    tile_chunks: int | None = None,
    tile_queries: int | None = None,
    tables: int = signatures.TABLES,
    probes: int = signatures.PROBES,
) -> DataFrame:
    """Exact best ``k`` chunks of each query, of vectors of any length.

    ``route="approximate"`` gives the best of those that share a signature with
    the query instead (``tables``, ``probes``: see ``signatures``).
    ``queries``: ``(query_id, own_key, query_vector)``; ``chunks``:
    ``(chunk_id, reference_number, embedding)`` and any of ``PAYLOAD``.
    Returns ``query_id, chunk_id, reference_number, [payload], score, rank``
    with ranks from 0. A scan carries the payload along; ``similar_chunks``
    gives it narrow chunks and fetches texts for the winners only.
    """
    own = F.col("own_key") if exclude_own else F.lit(None).cast("string")
    wanted = queries.filter(F.col("query_vector").isNotNull()).select(
        F.col("query_id").cast("string").alias("query_id"),
        own.alias("own_key"),
        F.col("query_vector").cast("array<float>").alias("query_vector"),
    )
    payload = [name for name in PAYLOAD if name in chunks.columns]
    found = chunks.filter(F.col("embedding").isNotNull())

    # measured, collected and routed: made once
    wanted = materialise(wanted, "queries")
    size = wanted.agg(
        F.count("*").alias("rows"),
        F.coalesce(F.sum(8 * F.size("query_vector")), F.lit(0)).alias("bytes"),
        F.max(F.size("query_vector")).alias("dim"),
    ).first()
    if not size["rows"]:
        return _empty_hits(chunks, payload)
    fits = (
        size["rows"] <= MAX_BROADCAST_QUERIES
        and size["bytes"] <= MAX_BROADCAST_BYTES
        and size["rows"] * k <= MAX_KEPT_ROWS
    )
    if route == "scan" and not fits:
        raise ValueError("too many queries to broadcast; use route='routed'")
    scan = fits and route in ("auto", "scan")
    if scan:
        hits = _scan(wanted.collect(), found, k, one_per_key, score_digits)
    elif route == "approximate":
        hits = _approximate(
            wanted,
            size["dim"],
            found,
            k,
            one_per_key,
            score_digits,
            tables,
            probes,
            tile_chunks,
            tile_queries,
        )
    else:
        hits = _routed(
            wanted,
            size["rows"],
            size["dim"],
            found,
            k,
            one_per_key,
            score_digits,
            n_pivots,
            tile_chunks,
            tile_queries,
        )
    # a scan has hits of every task; of a tile a query has k at most
    ranked = (_rank_salted if scan else _rank_once)(hits, k, one_per_key)
    if scan or not payload:
        return ranked
    return _with_payload(ranked, chunks, payload, fits).select(
        "query_id", "chunk_id", "reference_number", *payload, "score", "rank"
    )


def _with_payload(
    ranked: DataFrame, chunks: DataFrame, payload: list[str], small: bool
) -> DataFrame:
    """Texts of the winners only; they are read where they lie when the winners
    are few."""
    ranked = F.broadcast(ranked) if small else ranked
    return ranked.join(chunks.select("chunk_id", *payload), "chunk_id")


def _empty_hits(chunks: DataFrame, payload: list[str]) -> DataFrame:
    return chunks.select(
        F.lit("").alias("query_id"),
        "chunk_id",
        "reference_number",
        *payload,
        F.lit(0.0).alias("score"),
        F.lit(0).alias("rank"),
    ).filter(F.lit(False))


def similar_chunks(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = K,
    docs: DataFrame | None = None,
    duplicates: DataFrame | None = None,
    overfetch: int | None = None,
    key_col: str = "reference_number",
    **search_options,
) -> DataFrame:
    """Neighbours of each query outside its own record.

    ``docs``        give whole documents: one result per key, its best hit,
                    with the key's document as text (the chunk when the key
                    has none).
    ``duplicates``  ``(chunk_id)`` rows that may not appear.
    ``overfetch``   ``None``: exclude first and rank then, so ``k`` results come
                    back whenever they exist. A factor ``n``: rank ``n * k``
                    chunks first and exclude afterwards, as a remote index
                    does; fewer than ``k`` may remain.
    ``key_col``     the name of the record key in ``chunks`` and ``docs``, and
                    so in the result.
    """
    chunks = chunks.withColumnRenamed(key_col, "reference_number")
    if docs is not None:
        docs = docs.withColumnRenamed(key_col, "reference_number")
    if "chunk_index" not in chunks.columns:
        chunks = chunks.withColumn("chunk_index", F.lit(None).cast("int"))
    if "section" not in chunks.columns:
        chunks = chunks.withColumn("section", F.lit(None).cast("string"))
    if "chunk_text" not in chunks.columns:
        chunks = chunks.withColumn("chunk_text", F.lit(None).cast("string"))
    barred = None
    if duplicates is not None:
        barred = duplicates.select(
            F.col("chunk_id").try_cast("long").alias("chunk_id")
        ).filter(F.col("chunk_id").isNotNull())
        barred = materialise(barred, "barred")  # measured and joined: made once
        if fits_broadcast(barred):
            barred = F.broadcast(barred)
    one_per_key = docs is not None
    narrow = chunks.select("chunk_id", "reference_number", "embedding")

    if overfetch is None:
        eligible = (
            narrow if barred is None else narrow.join(barred, "chunk_id", "left_anti")
        )
        hits = search(queries, eligible, k, one_per_key, True, **search_options)
    else:
        hits = search(queries, narrow, overfetch * k, False, False, **search_options)
        own = queries.select(
            F.col("query_id").cast("string").alias("query_id"), "own_key"
        )
        hits = (
            hits.join(own, "query_id")
            .filter(~F.col("reference_number").eqNullSafe(F.col("own_key")))
            .drop("own_key", "rank")
        )
        if barred is not None:
            hits = hits.join(barred, "chunk_id", "left_anti")
        if one_per_key:
            best = Window.partitionBy("query_id", "reference_number").orderBy(
                F.desc("score"), F.asc("chunk_id")
            )
            hits = (
                hits.withColumn("rn", F.row_number().over(best)).filter("rn = 1").drop("rn")
            )
        hits = _rank(hits, k)

    text = F.col("chunk_text")
    # measured, joined and looked up: the corpus is searched once
    found = materialise(hits, "hits")
    hits = _with_payload(found, chunks, list(PAYLOAD), fits_broadcast(found))
    if docs is not None:
        full = lookup_documents(docs, found)
        hits = hits.join(
            full.select("reference_number", "doc_text"), "reference_number", "left"
        )
        text = F.coalesce("doc_text", "chunk_text")
    return hits.select(
        "query_id",
        "rank",
        F.col("reference_number").alias(key_col),
        "score",
        text.alias("text"),
        F.struct(
            F.col("reference_number").alias(key_col), "section", "chunk_index"
        ).alias("meta"),
        "chunk_id",
    )


def usual_overfetch(exclude_duplicates: bool = True) -> int:
    """The factor a remote index is usually asked for."""
    return OVERFETCH_WITH_EXCLUSION if exclude_duplicates else OVERFETCH_PLAIN
