"""Near-duplicates by HyperMinHash sketches, verified on whole sets.

A document's set is its distinct ``SHINGLE``-word runs (A-Z lower-cased); with
fewer words it is the whole sequence. A sketch has ``REGISTERS`` buckets. A
shingle's hash chooses the bucket by its high part; of the least value in it a
bucket keeps the number of leading zeros (6 bits) and the 10 bits after the
first one. ``BANDS`` of ``ROWS`` registers each are hashed to band keys, empty
registers borrowing from others, so that bands of short documents say as much as
those of long ones. A pair at the limit misses all bands with a chance of about
4e-8.

Documents with equal sets are one class from the start. Candidates come in two
steps, so that no group of copies is expanded into all its pairs:

1. In every band bucket each member is paired with one chosen member. Verified
   links join classes to components.
2. In buckets that still hold several components, members of different ones are
   compared in tiles of bounded size: first within the tiles, then, where several
   components are left, across them. Tiles carry sets of shortened hashes, join
   what may be alike as they go, and return only the pairs that joined something.

Candidates whose estimated similarity (corrected for chance collisions of
registers) is more than ``SIGMAS`` standard errors below the limit are dropped;
all links are verified on whole sets. Should a pair of step 2 fail there, its tiles
are compared again with other bits of the hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casebrook.llm import arrowwords, bloom
from casebrook.llm.components import components
from casebrook.llm.scratch import discard, short_batches, written
from casebrook.operators.sizing import fits_broadcast

PERCENT = 80
SHINGLE = 4
ROWS, BANDS = 6, 56
REGISTERS = ROWS * BANDS
MANTISSA = 10
SIGMAS = 6.0
TILE = 512
TILE_BYTES = 16 << 20
BATCH = 1024  # rows of texts, registers or sets that go to Python at a time
FIRST_SHIFT = 32  # shortened hashes are the upper halves at first
BITS_PER_ID = 16
MAX_FILTER_BYTES = 64 << 20
_PROBES = 64
_LOWEST = -(1 << 63)

_BORROW = (arrowwords.series(3, _PROBES * REGISTERS) % np.uint64(REGISTERS)).astype(np.int64)
_BORROW = _BORROW.reshape(_PROBES, REGISTERS)
_BAND_SEEDS = arrowwords.series(4, BANDS)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Ascending hashes of the distinct shingles of a document."""
    return np.unique(arrowwords.windows(words, min(size, len(words)))) if len(words) else words


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Registers of an ascending set; 0 is an empty one."""
    count = np.uint64(REGISTERS)
    high, low = hashes >> np.uint64(32), hashes & np.uint64(0xFFFFFFFF)
    with np.errstate(over="ignore"):
        bucket = (high * count + (low * count >> np.uint64(32))) >> np.uint64(32)
        value = hashes * count
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    bucket, value = bucket[first].astype(np.int64), value[first] | np.uint64(1 << 10)
    # the top bits decide; below them the last bits may round
    top = (value >> np.uint64(11)).astype(np.float64)
    zeros = 53 - np.frexp(top)[1]
    mantissa = (value << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    out = np.zeros(REGISTERS, dtype=np.uint16)
    out[bucket] = (zeros.astype(np.uint64) << np.uint64(MANTISSA)) + mantissa + np.uint64(1)
    return out


def filled(registers: np.ndarray) -> np.ndarray:
    """Registers in which every empty one has borrowed from a full one."""
    out = registers.copy()
    empty = np.flatnonzero(out == 0)
    for probe in _BORROW:
        if not len(empty):
            return out
        out[empty] = registers[probe[empty]]
        empty = empty[out[empty] == 0]
    full = np.flatnonzero(registers)
    if len(full):
        out[empty] = registers[full[np.searchsorted(full, empty) % len(full)]]
    return out


def band_keys(registers: np.ndarray) -> np.ndarray:
    rows = filled(registers).astype(np.uint64).reshape(BANDS, ROWS)
    keys = _BAND_SEEDS.copy()
    for k in range(ROWS):
        keys = arrowwords.mix(keys ^ rows[:, k])
    return keys


def estimate(one: np.ndarray, two: np.ndarray, n_one: np.ndarray, n_two: np.ndarray) -> np.ndarray:
    """Jaccard similarity from registers, less what chance collisions add, plus
    ``SIGMAS`` standard errors at the limit: an upper bound in all but name."""
    used = ((one > 0) | (two > 0)).sum(axis=-1)
    equal = ((one == two) & (one > 0)).sum(axis=-1)
    ratio = 4.0 * n_one * n_two / (n_one + n_two) ** 2
    chance = 0.169919487159739093975 * 2.0**-MANTISSA * ratio
    found = (equal / used - chance) / (1 - chance)
    limit = PERCENT / 100
    return found + SIGMAS * np.sqrt(limit * (1 - limit) / used)


def _prepared(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(docs["doc_id"].cast("long"), F.lit(_LOWEST)).alias("id"),
        F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"),
    )


SKETCH = "id long, n long, one long, two long, registers binary"


def sketches(rows: DataFrame, shingle: int) -> DataFrame:
    """Size, 128-bit hash and registers of each row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, found in arrowwords.documents(batch.column(1), True):
                sizes, one, two, registers = [], [], [], []
                for words in found:
                    own = shingles(words, shingle)
                    sizes.append(len(own))
                    one.append(own.sum(dtype=np.uint64))
                    two.append(np.bitwise_xor.reduce(arrowwords.mix(own + np.uint64(len(own)))))
                    registers.append(sketch(own).tobytes() if len(own) else b"")
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, len(found)),
                        pa.array(sizes, type=pa.int64()),
                        pa.array(np.array(one, dtype=np.uint64).view(np.int64)),
                        pa.array(np.array(two, dtype=np.uint64).view(np.int64)),
                        pa.array(registers, type=pa.binary()),
                    ],
                    names=["id", "n", "one", "two", "registers"],
                )

    return rows.select("id", "text").mapInArrow(run, SKETCH)


def crowded_bands(classes: DataFrame) -> DataFrame:
    """``band, id, one, n`` of the members of every band bucket with two or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [
                band_keys(np.frombuffer(r.as_buffer(), dtype=np.uint16)) for r in batch.column(3)
            ]
            place = pa.array(np.repeat(np.arange(len(keys)), BANDS))
            flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat), *(batch.column(k).take(place) for k in range(3))],
                names=["band", "id", "one", "n"],
            )

    bands = classes.select("id", "one", "n", "registers").mapInArrow(
        run, "band long, id long, one long, n long"
    )
    shared = bands.groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
    return bands.join(shared.select("band"), "band", "left_semi")


def _possible(pairs: DataFrame) -> DataFrame:
    """Pairs whose sizes allow the limit."""
    return pairs.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * PERCENT)


@F.pandas_udf(T.BooleanType())
def _may_link(one: pd.Series, two: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
    if not len(one):
        return pd.Series([], dtype=bool)
    a = np.frombuffer(b"".join(one), dtype=np.uint16).reshape(-1, REGISTERS)
    b = np.frombuffer(b"".join(two), dtype=np.uint16).reshape(-1, REGISTERS)
    sizes = na.to_numpy(dtype=float), nb.to_numpy(dtype=float)
    return pd.Series(estimate(a, b, *sizes) * 100 >= PERCENT)


def _estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs ``a, oa, b, ob`` that their sketches do not rule out."""
    of = lambda side: classes.select(
        F.col("id").alias(side), F.col("one").alias(f"o{side}"), F.col("registers").alias(f"r{side}")
    )
    joined = pairs.join(of("a"), ["a", "oa"]).join(of("b"), ["b", "ob"])
    return joined.where(_may_link("ra", "rb", "na", "nb")).select(*_PAIR)


_PAIR = ("a", "oa", "b", "ob")


def _whole_sets(ids: DataFrame, rows: DataFrame, shingle: int) -> DataFrame:
    """``id, one, set`` of the documents ``ids`` (and a few more).

    Sets are made again for the documents in question only; a Bloom filter of
    their ids picks them in one more scan.
    """
    found = bloom.of_column(
        ids.distinct().select(F.xxhash64("id").alias("id")), "id", BITS_PER_ID, MAX_FILTER_BYTES
    )
    bits = rows.sparkSession.sparkContext.broadcast(found.bits.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = bloom.Bloom(np.frombuffer(bits.value, dtype=np.uint8))
        for batch in batches:
            hashed = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            batch = batch.filter(pa.array(probe.contains(hashed)))
            for first, words in arrowwords.documents(batch.column(1), True):
                sets = [shingles(w, shingle) for w in words]
                sums = np.array([s.sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(sets)),
                        pa.array(sums.view(np.int64)),
                        pa.array([s.tobytes() for s in sets], type=pa.binary()),
                    ],
                    names=["id", "one", "set"],
                )

    return rows.select("id", "text", F.xxhash64("id").alias("h")).mapInArrow(
        run, "id long, one long, set binary"
    )


def _are_alike(one: pa.Buffer, two: pa.Buffer) -> bool:
    a, b = np.frombuffer(one, dtype=np.uint64), np.frombuffer(two, dtype=np.uint64)
    both = np.intersect1d(a, b, assume_unique=True).size
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _verified(pairs: DataFrame, rows: DataFrame, shingle: int, repeated: bool) -> DataFrame:
    """``a, b`` of the pairs that are links, by their whole sets."""
    spark = rows.sparkSession
    ids = pairs.select("a").union(pairs.select("b")).toDF("id")
    sets = _whole_sets(ids, rows, shingle).where(F.length("set") > 0)
    sets, path = written(sets.dropDuplicates(["id", "one"]) if repeated else sets, "sets")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # sets are read where Arrow holds them, not copied
            keep = [_are_alike(x.as_buffer(), y.as_buffer()) for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select([0, 1]).filter(pa.array(keep, type=pa.bool_()))

    of = lambda side: sets.select(
        F.col("id").alias(side), F.col("one").alias(f"o{side}"), F.col("set").alias(f"s{side}")
    )
    joined = pairs.join(of("a"), ["a", "oa"]).join(of("b"), ["b", "ob"])
    found = joined.select("a", "b", "sa", "sb").mapInArrow(linked, "a long, b long")
    links, _ = written(found.distinct(), "verified")
    discard(spark, path)
    return links


def _star_pairs(crowded: DataFrame) -> DataFrame:
    """Each member of a bucket with the one whose hashed id is least."""
    centres = crowded.groupBy("band").agg(
        F.min_by(F.struct("id", "one", "n"), F.struct(F.xxhash64("id", "one"), "id", "one")).alias("c")
    )
    pairs = crowded.join(centres, "band").where("id <> c.id")
    swap = F.col("id") < F.col("c.id")
    side = lambda own, other: F.when(swap, F.col(own)).otherwise(F.col(other))
    return _possible(
        pairs.select(
            side("id", "c.id").alias("a"),
            side("one", "c.one").alias("oa"),
            side("n", "c.n").alias("na"),
            side("c.id", "id").alias("b"),
            side("c.one", "one").alias("ob"),
            side("c.n", "n").alias("nb"),
        ).distinct()
    )


def _open_members(crowded: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets that still hold several components, with their tile.

    A bucket has so many tiles that none has more than ``TILE`` members or about
    ``TILE_BYTES`` of shortened sets.
    """
    marked = crowded.join(labels, "id", "left").select(
        "band", "id", "one", "n", F.coalesce("label", "id").alias("label")
    )
    size = F.greatest(F.count("*") / TILE, 4 * F.sum("n") / TILE_BYTES)
    open_ = (
        marked.groupBy("band")
        .agg(F.min("label").alias("low"), F.max("label").alias("high"), F.ceil(size).cast("int").alias("tiles"))
        .where("low < high")
        .select("band", "tiles")
    )
    own = F.pmod(F.xxhash64("id", "one", F.lit(7)), F.col("tiles")).cast("int")
    return marked.join(open_, "band").withColumn("own", own)


def _within(members: DataFrame) -> DataFrame:
    """Every member in its own tile."""
    return members.withColumn("x", F.col("own")).withColumn("y", F.col("own"))


def _across(members: DataFrame) -> DataFrame:
    """Every member of a bucket of several tiles once with each other tile."""
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    placed = members.where("tiles > 1").withColumn("other", other).where("other <> own")
    return placed.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other"))


def _joining_pairs(placed: DataFrame, classes: DataFrame, sets: DataFrame, shift: int) -> DataFrame:
    """Pairs ``a, oa, b, ob`` that join the components of a tile.

    A tile holds sketches and sets of 32-bit hashes (bits from ``shift`` on). Two
    sets are at most as like as their shortened ones, so no link is lost. Pairs of
    one component, known before or joined in the tile, are passed over: a tile
    returns fewer pairs than it has members.
    """

    def shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                cut = (np.frombuffer(x.as_buffer(), dtype=np.uint64) >> np.uint64(shift) for x in part.column(2))
                short = [np.sort(c.astype(np.uint32)).tobytes() for c in cut]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(short, type=pa.binary())],
                    names=["id", "one", "short"],
                )

    short = sets.select("id", "one", "set").mapInArrow(shortened, "id long, one long, short binary")
    placed = placed.select("band", "x", "y", "own", "id", "one", "n", "label")
    placed = placed.join(classes.select("id", "one", "registers"), ["id", "one"]).join(short, ["id", "one"])

    def compare(table: pa.Table) -> pa.Table:
        ids, ones, sizes, labels = (table.column(c).to_numpy() for c in ("id", "one", "n", "label"))
        own, x, y = (table.column(c).to_numpy() for c in ("own", "x", "y"))
        registers = np.frombuffer(
            b"".join(r.as_py() for r in table.column("registers")), dtype=np.uint16
        ).reshape(-1, REGISTERS)
        shorts = [np.frombuffer(r.as_buffer(), dtype=np.uint32) for r in table.column("short")]
        left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
        group = np.unique(labels, return_inverse=True)[1]
        out: list[tuple[int, int]] = []
        for i in left:
            js = right[group[right] != group[i]]
            js = js[ids[js] != ids[i]]
            js = js[js > i] if x[0] == y[0] else js
            low, high = np.minimum(sizes[js], sizes[i]), np.maximum(sizes[js], sizes[i])
            js = js[low * 100 >= high * PERCENT]
            if len(js):
                near = estimate(registers[i], registers[js], float(sizes[i]), sizes[js].astype(float))
                js = js[near * 100 >= PERCENT]
            for j in js:
                if group[i] != group[j] and _may_reach(shorts[i], shorts[j]):
                    out.append((i, j))
                    group[group == group[j]] = group[i]
        first, second = np.array(out, dtype=np.int64).reshape(-1, 2).T
        swap = ids[first] > ids[second]
        a, b = np.where(swap, second, first), np.where(swap, first, second)
        return pa.table({"a": ids[a], "oa": ones[a], "b": ids[b], "ob": ones[b]})

    pairs = placed.groupBy("band", "x", "y").applyInArrow(compare, "a long, oa long, b long, ob long")
    return pairs.distinct()


def _may_reach(one: np.ndarray, two: np.ndarray) -> bool:
    """Can the sets behind two shortened ones be alike enough?"""
    if len(one) > len(two):
        one, two = two, one
    at = np.minimum(np.searchsorted(two, one), len(two) - 1)
    both = int((two[at] == one).sum())
    return 100 * both >= PERCENT * (len(one) + len(two) - both)


def _shared_ids(every: DataFrame, sets: DataFrame) -> tuple[DataFrame, bool]:
    """Links between the classes of rows that share an id, and are there any such rows?"""
    again = every.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select("id")
    again, _ = written(again, "shared-ids")
    if again.isEmpty():
        return every.sparkSession.createDataFrame([], "a long, b long"), False
    again = F.broadcast(again) if fits_broadcast(again) else again
    shared = every.where("n > 0").join(again, "id", "left_semi").select("id", "one", "two", "n").distinct()
    links = shared.join(sets, ["one", "two", "n"]).where(F.col("id") != F.col("class"))
    return written(links.select(F.col("id").alias("a"), F.col("class").alias("b")), "id-links")[0], True


def _members_and_labels(docs: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Written tables: ``id, n, one, class`` of every row, ``id, label`` of linked classes."""
    spark = docs.sparkSession
    rows = _prepared(docs)
    every, at_every = written(sketches(rows, shingle), "sketches")
    counted = every.where("n > 0").groupBy("one", "two", "n")
    sets, _ = written(counted.agg(F.min("id").alias("class"), F.count("*").alias("rows")), "set-classes")
    several = sets.where("rows > 1").drop("rows")
    several = F.broadcast(several) if fits_broadcast(several) else several
    narrow = every.select("id", "n", "one", "two").join(several, ["one", "two", "n"], "left")
    # a set of one row is its own class; empty sets have none
    own = F.coalesce("class", F.when(F.col("n") > 0, F.col("id")))
    members, _ = written(narrow.select("id", "n", "one", own.alias("class")), "members")
    id_links, repeated = _shared_ids(every, sets.drop("rows"))
    copies = members.where("id <> class").select("id", "one").distinct()
    copies = F.broadcast(copies) if fits_broadcast(copies) else copies
    classes = every.where("n > 0").join(copies, ["id", "one"], "left_anti").dropDuplicates(["id", "one"])
    classes, at_classes = written(classes.select("id", "one", "n", "registers"), "classes")
    discard(spark, at_every)
    crowded, at_crowded = written(crowded_bands(classes), "crowded-bands")
    pairs, at_pairs = written(_estimated(_star_pairs(crowded), classes), "candidates")
    links = _verified(pairs, rows, shingle, repeated).union(id_links)
    labels, _ = written(components(links), "labels")
    for place in (_within, _across):
        shift = FIRST_SHIFT
        while True:
            placed, at_placed = written(place(_open_members(crowded, labels)), "tiles")
            if placed.isEmpty():
                break
            whole, at_whole = written(_sets_of(placed, rows, shingle, repeated), "sets")
            found, at_found = written(_joining_pairs(placed, classes, whole, shift), "candidates")
            asked = found.count()
            more = _verified(found, rows, shingle, repeated)
            links = links.union(more)
            if asked:
                labels, _ = written(components(links), "labels")
            done = more.count() == asked
            for path in (at_placed, at_whole, at_found):
                discard(spark, path)
            if done:
                break
            # shortened hashes that met by chance joined what is apart: other bits
            shift = (shift + 31) % 33
    for path in (at_classes, at_crowded, at_pairs):
        discard(spark, path)
    return members, labels


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row of ``docs(doc_id, text)``.

    Null or empty texts have empty sets and are linked with nothing. Rows that
    share an id are one document with the links of all; a null id is least of
    all and stays null. An empty table gives no rows; other columns are not read.
    """
    with short_batches(docs.sparkSession, BATCH):
        members, labels = _members_and_labels(docs, shingle)
    # a document's component: of its class, or the class itself
    labels = labels.withColumnRenamed("id", "class")
    labels = F.broadcast(labels) if fits_broadcast(labels) else labels
    joined = members.join(labels, "class", "left")
    component = F.coalesce("label", "class", "id")
    back = lambda c: F.when(c != F.lit(_LOWEST), c)
    return joined.select(
        back(F.col("id")).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        back(component).alias("component_id"),
        (F.col("id") == component).alias("kept"),
    )


def _sets_of(placed: DataFrame, rows: DataFrame, shingle: int, repeated: bool) -> DataFrame:
    keys = placed.select("id", "one").distinct()
    sets = _whole_sets(keys.select("id"), rows, shingle)
    sets = sets.dropDuplicates(["id", "one"]) if repeated else sets
    return sets.join(F.broadcast(keys) if fits_broadcast(keys) else keys, ["id", "one"], "left_semi")


def one_of_each(docs: DataFrame, shingle: int) -> DataFrame:
    """The rows of ``docs`` that stay: the least id of each component.

    Rows without an id stay. Rows that repeat both id and text are one. All
    columns are as they were; texts are joined only with ids to drop, broadcast
    if their measured size is small.
    """
    judged = near_duplicates(docs, shingle)
    drop, _ = written(judged.where("not kept").select("doc_id").distinct(), "dropped")
    rows = docs.join(F.broadcast(drop) if fits_broadcast(drop) else drop, "doc_id", "left_anti")
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    again, _ = written(again.select("doc_id"), "repeated-ids")
    if again.isEmpty():
        return rows.select(docs.columns)
    again = F.broadcast(again) if fits_broadcast(again) else again
    repeated = rows.join(again, "doc_id", "left_semi").select(docs.columns)
    return (
        rows.join(again, "doc_id", "left_anti")
        .select(docs.columns)
        .unionByName(repeated.dropDuplicates(["doc_id", "text"]))
    )
