"""Product quantisation in integers; nearest entries by Orchard's search.

Vectors are cut into ``PARTS`` parts; every part position has a codebook of up to
``ENTRIES`` entries. For each entry of a codebook the others are listed by their
distance from it. A search starts at some entry, walks its list and jumps to the
list of the first entries that are nearer, marks what it has visited, and stops
where the list passes twice the distance to the best entry: by the triangle
inequality nothing beyond it can be as near. Entries at exactly twice the distance
are still visited, so ties are seen and go to the lower index.

All searches of a batch walk together, ``STRIDE`` entries of their lists at a time.
Distances are exact integers: 64-bit while components are below ``SMALL``, Python
integers beyond.

Codebooks and their sums have a fixed size, so they may pass through the driver;
vectors never do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebrook.llm.scratch import written
from casebrook.operators.sizing import fits_broadcast

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
SMALL = 1 << 27
STRIDE = 16
SALTS = 16
_TOGETHER = 4096  # parts searched at a time

Codebooks = list[np.ndarray]  # of each part position: entries x components


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    step = a - b
    return (step * step).sum(axis=-1)


class Orchard:
    """Nearest entry of a codebook for many integer vectors at once."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self.apart = np.stack([_squared(entries, e) for e in entries])
        order = [sorted(range(len(entries)), key=lambda j: (row[j], j)) for row in self.apart.tolist()]
        self.lists = np.array(order, dtype=np.int64)
        self.listed = np.take_along_axis(self.apart, self.lists, axis=1)
        # searches start at the nearest of a few entries that lie far apart
        self.pilots = np.unique(self.lists[0, :: max(1, len(entries) // 8)])

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry (ties: the lowest) and its squared distance."""
        parts = [self._search(points[k : k + _TOGETHER]) for k in range(0, len(points), _TOGETHER)]
        if not parts:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=self.entries.dtype)
        return tuple(np.concatenate(x) for x in zip(*parts))

    def _search(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size, entries = len(self.entries), self.entries
        row = np.arange(len(points))
        first = np.stack([_squared(points, entries[p]) for p in self.pilots], axis=1)
        best = self.pilots[np.argmin(first, axis=1)]
        near = first.min(axis=1)
        visited = np.zeros((len(points), size), dtype=bool)
        visited[:, self.pilots] = True
        place = np.zeros(len(points), dtype=np.int64)
        live = row
        while len(live):
            steps = place[live][:, None] + np.arange(STRIDE)
            inside = steps < size
            steps = np.minimum(steps, size - 1)
            at = best[live][:, None]
            reach = inside & (self.listed[at, steps] <= 4 * near[live][:, None])
            other = self.lists[at, steps]
            fresh = reach & ~visited[live[:, None], other]
            who, where = np.nonzero(fresh)
            found, point = other[who, where], live[who]
            visited[point, found] = True
            distance = _squared(points[point], entries[found])
            # the nearest of the stride, ties to the lowest index
            order = np.lexsort((found, distance, who))
            leads = order[np.concatenate(([True], who[order][1:] != who[order][:-1]))] if len(order) else order
            one, entry, d = point[leads], found[leads], distance[leads]
            better = (d < near[one]) | ((d == near[one]) & (entry < best[one]))
            place[live] += STRIDE
            jump = one[better]
            best[jump], near[jump], place[jump] = entry[better], d[better], 0
            jumped = np.zeros(len(points), dtype=bool)
            jumped[jump] = True
            # a list is done where it leaves the reach or ends
            live = live[jumped[live] | (reach[:, -1] & (place[live] < size))]
        return best, near


def _floored(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows of finite vectors with integer components ``v``; the length is the first kept row's.

    A component whose integer needs more than 64 bits counts as not finite.
    """
    whole = F.transform(vectors[f"`{vector}`"], lambda x: F.floor(x.cast("double") * SCALE))
    usable = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * SCALE) < 2.0**63)
    return vectors.where(
        vectors[f"`{vector}`"].isNotNull() & F.forall(vectors[f"`{vector}`"], lambda x: F.coalesce(usable(x), F.lit(False)))
    ).select(
        vectors["vec_id"].cast("long").alias("vec_id"),
        vectors["label"].cast("long").alias("label"),
        whole.alias("v"),
    )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)
    large = len(flat) and (int(flat.max()) >= SMALL or int(flat.min()) <= -SMALL)
    return flat.astype(object) if large else flat


def _cuts(width: int, parts: int) -> list[slice]:
    step = width // parts
    return [slice(k * step, (k + 1) * step) for k in range(parts)]


def _searchers(codebooks: Codebooks, cache: dict, exact: bool) -> list[Orchard]:
    """The codebooks' lists, made once per worker and kind of integers."""
    if exact not in cache:
        kind = object if exact else np.int64
        cache[exact] = [Orchard(book.astype(kind)) for book in codebooks]
    return cache[exact]


def _is_large(codebooks: Codebooks) -> bool:
    return any(abs(int(x)) >= SMALL for book in codebooks for x in book.flat)


def first_codebooks(rows: DataFrame, parts: int, entries: int) -> Codebooks:
    """The parts of the rows with the least ids; equal ids by components, null ids last."""
    least = rows.select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    if not least:
        return []
    whole = np.array([r["v"] for r in least], dtype=object).reshape(len(least), -1)
    return [whole[:, cut].copy() for cut in _cuts(whole.shape[1], parts)]


def improved(rows: DataFrame, codebooks: Codebooks, width: int) -> Codebooks:
    """Codebooks after one round: every entry the floored mean of its parts, unused ones as before."""
    spark = rows.sparkSession
    held, large = spark.sparkContext.broadcast(codebooks), _is_large(codebooks)
    parts, size = len(codebooks), len(codebooks[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        sums = [np.zeros(book.shape, dtype=object) for book in held.value]
        counts = np.zeros((parts, size), dtype=np.int64)
        for batch in batches:
            matrix = _matrix(batch.column(0), width)
            exact = large or matrix.dtype == object
            for k, (search, cut) in enumerate(zip(_searchers(held.value, cache, exact), _cuts(width, parts))):
                own = matrix[:, cut]
                found, _ = search.nearest(own)
                order = np.argsort(found, kind="stable")
                used, starts = np.unique(found[order], return_index=True)
                if len(used):
                    sums[k][used] += np.add.reduceat(own[order], starts, axis=0)
                counts[k] += np.bincount(found, minlength=size)
        k, entry = np.nonzero(counts)
        step = width // parts
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(k, step + 1), type=pa.int32()),
                pa.array(np.repeat(entry, step + 1), type=pa.int32()),
                pa.array(np.tile(np.arange(-1, step), len(k)), type=pa.int32()),
                pa.array(
                    [Decimal(int(x)) for i, j in zip(k, entry) for x in (counts[i, j], *sums[i][j])],
                    type=pa.decimal128(38, 0),
                ),
            ],
            names=["part", "entry", "at", "sum"],
        )

    sums = rows.select("v").mapInArrow(run, "part int, entry int, at int, sum decimal(38,0)")
    total = sums.groupBy("part", "entry", "at").agg(F.sum("sum").cast("decimal(38,0)").alias("sum")).collect()
    out = [book.copy() for book in codebooks]
    counts = {(r["part"], r["entry"]): int(r["sum"]) for r in total if r["at"] < 0}
    for r in total:
        if r["at"] >= 0:
            out[r["part"]][r["entry"], r["at"]] = int(r["sum"]) // counts[r["part"], r["entry"]]
    held.unpersist()
    return out


def coded(rows: DataFrame, codebooks: Codebooks, width: int) -> DataFrame:
    """``vec_id, label, code, error``: two hex digits a part; null errors need more than 64 bits."""
    held, large = rows.sparkSession.sparkContext.broadcast(codebooks), _is_large(codebooks)
    parts = len(codebooks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            matrix = _matrix(batch.column(2), width)
            exact = large or matrix.dtype == object
            searchers = _searchers(held.value, cache, exact)
            found = [s.nearest(matrix[:, cut]) for s, cut in zip(searchers, _cuts(width, parts))]
            codes = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
            errors = [int(e) for e in sum(f[1] for f in found)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([row.tobytes().hex() for row in codes], type=pa.string()),
                    pa.array([e if e < 1 << 63 else None for e in errors], type=pa.int64()),
                ],
                names=["vec_id", "label", "code", "error"],
            )

    schema = "vec_id long, label long, code string, error long"
    return rows.select("vec_id", "label", "v").mapInArrow(run, schema)


def codebooks_sha256(codebooks: Codebooks) -> str:
    values = (str(int(x)) for book in codebooks for x in book.flat)
    return hashlib.sha256(",".join(values).encode()).hexdigest()


def trained(
    vectors: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, Codebooks, int]:
    """Usable rows with integer components, their codebooks, and the vectors' length."""
    if entries > 256:
        raise ValueError("codes have two hex digits a part")
    rows, _ = written(_floored(vectors, vector), "vectors")
    width = rows.orderBy(F.asc_nulls_last("vec_id"), "v").select(F.size("v")).limit(1).collect()
    width = width[0][0] if width else 0
    if width % parts:
        raise ValueError(f"vectors of {width} components have no {parts} equal parts")
    rows = rows.where(F.size("v") == width)
    codebooks = first_codebooks(rows, parts, entries)
    for _ in range(rounds if codebooks else 0):
        codebooks = improved(rows, codebooks, width)
    return rows, codebooks, width


def compressed(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of ``vectors(vec_id, embedding, label)``.

    Rows whose vector is null, or holds a null or non-finite component, or one
    whose integer needs more than 64 bits, are dropped; so are vectors of another
    length than the one with the least id. Repeated rows are coded each, and each
    is an entry where its id is among the least; null ids come last. Null labels
    are one label. A table without usable rows gives no rows; other columns are
    not read.
    """
    rows, codebooks, width = trained(vectors, vector)
    if not codebooks:
        empty = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
        return rows.sparkSession.createDataFrame([], empty)
    codes, _ = written(coded(rows, codebooks, width), "codes")
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error"))
    if fits_broadcast(sums):
        joined = codes.join(F.broadcast(sums).withColumnRenamed("label", "l"), F.col("label").eqNullSafe(F.col("l")))
    else:  # a label with very many rows is dealt by salt
        salted = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = salted.withColumnsRenamed({"label": "l", "salt": "s"})
        own = codes.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int"))
        same = F.col("label").eqNullSafe(F.col("l")) & (F.col("salt") == F.col("s"))
        joined = own.join(salted, same)
    return joined.select(
        "vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(codebooks)).alias("codebooks_sha256")
    )


def decoded(codes: DataFrame, codebooks: Codebooks) -> DataFrame:
    """Add ``vector``, the entries that ``code`` names, divided by the scale."""
    tables = [F.lit([[float(x) / SCALE for x in entry] for entry in book]) for book in codebooks]
    parts = [
        F.element_at(table, F.conv(F.substring("code", 2 * k + 1, 2), 16, 10).cast("int") + 1)
        for k, table in enumerate(tables)
    ]
    return codes.withColumn("vector", F.concat(*parts))
