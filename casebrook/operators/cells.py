"""Cells of a vector table, and which of them a query must visit.

Scores are dot products, so what a cell can offer depends on the directions and
on the lengths of its vectors. Pivots are chunks, chosen by hash; a vector goes
to a pivot close in direction and to a band of half an octave of length. A cell's
radius (greatest angle to its pivot) and its least and greatest length bound its
best score: with an angle of at least ``a`` between query and members, that is
``|q| hi cos a``, or ``|q| lo cos a`` where the cosine is negative. Any length
will do; vectors of length zero have a cell of their own, whose scores are 0.

Pivots have two levels: a vector is held against a few tops first and then only
against the pivots of the nearest top. Which pivot it gets is a matter of speed;
the bounds are measured afterwards and hold for any choice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casebrook.operators.blockscore import key_codes, matrix
from casebrook.operators.leaves import Leaves

CELL_CHUNKS = 8192
PIVOT_BYTES = 32 << 20
SCOUT_CHUNKS = 64  # chunks to one scout
SCOUT_BYTES = 16 << 20
ZERO = -1  # the cell of vectors of length zero
_BANDS = 2048  # more than the half octaves of any double
_QUERIES = 256  # queries held against all cells at a time


@dataclass(frozen=True)
class Pivots:
    """Pivot chunks; ``tops`` of them are the first level."""

    vectors: np.ndarray
    keys: list
    ids: np.ndarray
    tops: int
    groups: list[np.ndarray]

    @property
    def directions(self) -> np.ndarray:
        return self.vectors / np.linalg.norm(self.vectors, axis=1, keepdims=True)


def pivots_for(chunks: DataFrame, dim: int, count: int | None = None) -> Pivots:
    """So many chunks by the hash of their id; by default one to ``CELL_CHUNKS``
    chunks, at most ``PIVOT_BYTES``. Vectors of length zero are no pivots."""
    if count is None:
        count = max(1, min(PIVOT_BYTES // (8 * dim), math.ceil(chunks.count() / CELL_CHUNKS)))
    rows = (
        chunks.select("chunk_id", "reference_number", "embedding")
        .orderBy(F.xxhash64("chunk_id"), "chunk_id")
        .limit(count)
        .collect()
    )
    rows = [r for r in rows if any(r["embedding"])]
    vectors = np.array([r["embedding"] for r in rows], dtype=np.float64).reshape(-1, dim)
    tops = math.ceil(math.sqrt(len(rows)))
    groups = []
    if tops:
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        nearest = (unit @ unit[:tops].T).argmax(axis=1)
        nearest[:tops] = np.arange(tops)  # no group is empty, equal tops or not
        groups = [np.flatnonzero(nearest == top) for top in range(tops)]
    return Pivots(
        vectors,
        [r["reference_number"] for r in rows],
        np.array([r["chunk_id"] for r in rows], dtype=np.int64),
        tops,
        groups,
    )


@dataclass(frozen=True)
class Scouts:
    """Some chunks that every query is held against before it is sent to tiles:
    the k-th best of them bounds what the search will find from below."""

    vectors: np.ndarray
    ids: np.ndarray
    codes: np.ndarray
    names: dict

    @staticmethod
    def of(vectors: np.ndarray, ids: np.ndarray, keys: pa.Array | pa.ChunkedArray) -> Scouts:
        codes, names = key_codes(keys)
        return Scouts(vectors.astype(np.float32), ids, codes, {name: at for at, name in enumerate(names)})

    def own(self, keys: list) -> np.ndarray:
        """Codes of the queries' own keys; -2 for none, and for those no scout has."""
        return np.array([-2 if key is None else self.names.get(key, -2) for key in keys], dtype=np.int64)


def scouts_for(chunks: DataFrame, rows: int, dim: int) -> Scouts:
    """One chunk to ``SCOUT_CHUNKS`` by the hash of its id, at most ``SCOUT_BYTES``."""
    most = max(1, min(SCOUT_BYTES // (4 * dim), rows // SCOUT_CHUNKS))
    dealt = F.pmod(F.xxhash64("chunk_id"), F.lit(max(1, math.ceil(rows / most))))
    table = (
        chunks.filter(dealt == 0)
        .select("chunk_id", "reference_number", "embedding")
        .limit(2 * most)  # ids that repeat cannot make it long
        .toArrow()
    )
    vectors = matrix(table["embedding"], dim)
    return Scouts.of(vectors, table["chunk_id"].to_numpy(), table["reference_number"])


def _unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions (zeros stay) and lengths."""
    norms = np.linalg.norm(vectors, axis=1)
    return vectors / np.where(norms > 0, norms, 1)[:, None], norms


def assign(chunks: DataFrame, pivots: Pivots, dim: int) -> DataFrame:
    """Each chunk with its ``cell``, the cosine to the cell's pivot and its length."""
    shared = chunks.sparkSession.sparkContext.broadcast(pivots)
    schema = T.StructType(
        [
            T.StructField("chunk_id", T.LongType()),
            T.StructField("reference_number", T.StringType()),
            T.StructField("embedding", T.ArrayType(T.FloatType())),
            T.StructField("cell", T.IntegerType()),
            T.StructField("closeness", T.DoubleType()),
            T.StructField("norm", T.DoubleType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value.directions
        for batch in batches:
            unit, norms = _unit(matrix(batch.column("embedding"), dim))
            cell = np.full(len(unit), ZERO, dtype=np.int32)
            close = np.zeros(len(unit))
            some = np.flatnonzero(norms > 0)
            if len(centres) and len(some):
                band = np.floor(2 * np.log2(norms[some])).astype(np.int64) + _BANDS // 2
                top = (unit[some] @ centres[: shared.value.tops].T).argmax(axis=1)
                for k in np.unique(top):
                    own = some[top == k]
                    group = shared.value.groups[k]
                    cosines = unit[own] @ centres[group].T
                    cell[own] = group[cosines.argmax(axis=1)] * _BANDS + band[top == k]
                    close[own] = cosines.max(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell), pa.array(close), pa.array(norms)],
                names=schema.names,
            )

    return chunks.select("chunk_id", "reference_number", "embedding").mapInArrow(run, schema)


@dataclass(frozen=True)
class Cells:
    """The cells in use: pivot, radius, and least and greatest length of each."""

    numbers: np.ndarray
    counts: dict[int, int]
    pivot: np.ndarray
    radius: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @staticmethod
    def measured(assigned: DataFrame) -> Cells:
        """One row per cell comes to the driver: pivots times bands in use."""
        rows = sorted(
            assigned.groupBy("cell")
            .agg(
                F.count("*").alias("n"),
                F.min("closeness").alias("close"),
                F.min("norm").alias("low"),
                F.max("norm").alias("high"),
            )
            .collect()
        )
        column = lambda name: np.array([r[name] for r in rows], dtype=np.float64)
        numbers = np.array([r["cell"] for r in rows], dtype=np.int32)
        return Cells(
            numbers,
            {r["cell"]: r["n"] for r in rows},
            np.where(numbers == ZERO, 0, numbers // _BANDS),
            np.arccos(np.clip(column("close") - 1e-6, -1, 1)),
            column("low"),
            column("high"),
        )

    def reach(self, vectors: np.ndarray, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every query and cell: a bound of the best score, and its rounding error."""
        unit, norms = _unit(vectors)
        most = norms[:, None] * self.high
        if not len(directions):
            return most, 1e-9 * most
        cosines = np.clip(unit @ directions.T, -1, 1)[:, self.pivot]
        cosines = np.cos(np.maximum(np.arccos(cosines) - self.radius, 0))
        bound = cosines * norms[:, None] * np.where(cosines >= 0, self.high, self.low)
        bound[:, self.numbers == ZERO] = 0
        return bound, 1e-9 * most


@dataclass(frozen=True)
class Tiles:
    """Tiles of about equally many chunks, numbered from 0: whole cells of near
    pivots together, or an even share of one larger cell. ``first`` and ``across``
    give each cell its tiles, ``cells`` each tile its cells (positions)."""

    first: np.ndarray
    across: np.ndarray
    cells: list[np.ndarray]

    @staticmethod
    def of(cells: Cells, pivots: Pivots, rows: int) -> Tiles:
        place = np.zeros(max(1, len(pivots.ids)), dtype=np.int64)
        if pivots.groups:
            place[np.concatenate(pivots.groups)] = np.arange(len(pivots.ids))
        first = np.zeros(len(cells.numbers), dtype=np.int64)
        across = np.ones(len(cells.numbers), dtype=np.int64)
        members: list[list[int]] = []
        room = 0
        for at in np.lexsort((cells.numbers, place[cells.pivot])).tolist():
            n = cells.counts[int(cells.numbers[at])]
            if n > rows:
                across[at] = math.ceil(n / rows)
            if n > room:
                first[at], room = len(members), max(0, rows - n)
                members += [[at] for _ in range(across[at])]
            else:
                first[at] = len(members) - 1
                members[-1].append(at)
                room -= n
        return Tiles(first, across, [np.sort(m) for m in members])


def route(
    queries: DataFrame,
    pivots: Pivots,
    cells: Cells,
    tiles: Tiles,
    dim: int,
    k: int,
    one_per_key: bool,
    digits: int,
    scouts: Scouts | None = None,
) -> DataFrame:
    """Each query with the tiles that may hold one of its best ``k``, and its bar.

    The scouts (the pivots, if none are given) are chunks themselves, so the k-th
    best eligible one bounds the answer from below; a cell that can offer only less
    is left out.
    """
    if scouts is None:
        scouts = Scouts.of(pivots.vectors, pivots.ids, pa.array(pivots.keys, type=pa.string()))
    shared = queries.sparkSession.sparkContext.broadcast((pivots, cells, tiles, scouts))
    schema = T.StructType(
        [
            T.StructField("query_id", T.StringType()),
            T.StructField("own_key", T.StringType()),
            T.StructField("query_vector", T.ArrayType(T.FloatType())),
            T.StructField("tiles", T.ArrayType(T.IntegerType())),
            T.StructField("bar", T.DoubleType()),
        ]
    )
    slack = 2 * 10.0**-digits

    def chosen(vectors: np.ndarray, bars: np.ndarray, directions: np.ndarray) -> list[list[int]]:
        _, found, cut, _ = shared.value
        bound, error = found.reach(vectors, directions)
        alive = bound + error >= bars[:, None] - slack
        met = np.zeros((len(vectors), len(cut.cells)), dtype=bool)
        for tile, at in enumerate(cut.cells):
            met[:, tile] = alive[:, at].any(axis=1)
        return [np.flatnonzero(row).tolist() for row in met]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions, known = shared.value[0].directions, shared.value[3]
        leaves = Leaves(known.vectors, known.ids, known.codes, k, one_per_key) if len(known.ids) else None
        for batch in batches:
            vectors = matrix(batch.column("query_vector"), dim)
            bars = np.full(len(vectors), -np.inf)
            if leaves is not None:
                own = known.own(batch.column("own_key").to_pylist())
                bars = leaves.best(vectors, own, bars, digits)[-1]
            lists: list[list[int]] = []
            for at in range(0, len(vectors), _QUERIES):
                some = slice(at, at + _QUERIES)
                lists += chosen(vectors[some], bars[some], directions)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lists, type=pa.list_(pa.int32())), pa.array(bars)],
                names=schema.names,
            )

    return queries.select("query_id", "own_key", "query_vector").mapInArrow(run, schema)
