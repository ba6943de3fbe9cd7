"""Language-model scoring from a log-frequency Bloom filter.

Counts of words and of word pairs are quantised: the thresholds 1, 2, ..., 8, 10,
12, ... (powers of the fourth root of two, as whole numbers) cut them into levels,
which a ``CountFilter`` holds. A level stands for the mean count of all n-grams of
its kind on it, so quantising moves no mass in the sum.

The probability of a word after another is
    g(level of h) c(h w) / c(h) + (1 - g) (c(w) + 1) / (N + V + 1)
with one weight g per level of the history. The weights are fitted to the
training tokens with their own occurrence left out of the counts. After any
history the probabilities of the V words and of one unknown word add up to one,
but for quantising and for pairs that were never seen and are hit by chance. The
latter grow with V, so the number of probes does: ``log2(V) + SPARE`` of them let
2 ** -SPARE pairs per history through, whatever the size of the corpus.

The filter holds every word and every pair and grows with them. Each shard of the
counts makes its part of it. Up to ``MAX_BYTES`` the parts are one file in the
shared folder, which each machine maps once for all its workers (a broadcast
variable would be one copy in each worker, and one on the driver). A larger
filter, or one in a folder that is no mounted file system, stays a table: the
different n-grams of a group of texts are dealt to the shards, probed there, and
their levels go back to the group. Both ways probe the same bits, so the scores
are the same. Exact counts, which only the base score needs, are never broadcast
whole: words with at least a ``HOT`` th part of all tokens are (there can be no
more than ``HOT``), the rest are joined by hash.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebrook.llm import arrowwords, countfilter
from casebrook.llm.blobs import cut_by_shard, joined, shards_for
from casebrook.llm.bloom import BLOCK_BYTES
from casebrook.llm.countfilter import CountFilter
from casebrook.sources.storage import materialise, shared_dir

SPARE = 5
MAX_BYTES = 4 << 30
HOT = 200_000
GRID = (0.0, 0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95)
WORDS, PAIRS = 0, 1
_TOKENS_HELD = 2 << 20
_TOKENS_READ = 3 << 18
_END = np.uint64(0x1F83D9ABFB41BD6B)
_BEGIN = np.uint64(0x5BE0CD19137E2179)
_LEVELS = 256
COUNTS = "kind int, shard int, keys binary, counts binary"
GROUPS = (
    "first long, kind int, shard int, keys binary, "
    "ids array<long>, lengths array<long>, tokens binary"
)

_BY_LEVEL = pa.list_(pa.struct([("level", pa.int32()), ("n", pa.int64()), ("count", pa.int64())]))

# levels of the keys of one kind
Look = Callable[[int, np.ndarray], np.ndarray]


def _thresholds() -> np.ndarray:
    return np.unique(np.ceil(2.0 ** (np.arange(250) / 4) - 1e-9).astype(np.int64))


THRESHOLDS = _thresholds()


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(THRESHOLDS, counts, side="right")


def tokens_of(words: np.ndarray) -> np.ndarray:
    """A text's tokens: its words and one end."""
    return np.append(words, _END)


def histories(tokens: np.ndarray) -> np.ndarray:
    return np.concatenate(([_BEGIN], tokens[:-1]))


def pairs_of(history: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return arrowwords.mix(history * np.uint64(0xD6E8FEB86659FD93) + tokens)


def _batch_tokens(texts: pa.Array) -> Iterator[np.ndarray]:
    for _, found in arrowwords.documents(texts, True):
        for words in found:
            yield tokens_of(words)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[np.ndarray]]]:
    """Ids and tokens of consecutive rows ``(id, text)``, ``_TOKENS_READ`` at a time."""
    ids: list[int | None] = []
    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        for key, tokens in zip(batch.column(0).to_pylist(), _batch_tokens(batch.column(1))):
            ids.append(key)
            held.append(tokens)
            size += len(tokens)
            if size >= _TOKENS_READ:
                yield ids, held
                ids, held, size = [], [], 0
    if held:
        yield ids, held


def _first_row() -> int:
    """The number of a task's first row."""
    context = TaskContext.get()
    return (context.partitionId() if context else 0) << 40


def _blob_rows(kind: int, keys: np.ndarray, counts: np.ndarray, shards: int) -> pa.RecordBatch:
    cuts = cut_by_shard(keys, shards)
    full = np.flatnonzero(np.diff(cuts))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([kind] * len(full), type=pa.int32()),
            pa.array(full, type=pa.int32()),
            pa.array([keys[cuts[s] : cuts[s + 1]].tobytes() for s in full], type=pa.binary()),
            pa.array([counts[cuts[s] : cuts[s + 1]].tobytes() for s in full], type=pa.binary()),
        ],
        names=["kind", "shard", "keys", "counts"],
    )


def count_ngrams(texts: DataFrame, shards: int) -> DataFrame:
    """Exact counts of words and of pairs, in shards, with their sums by level.

    Tasks add up what they hold before anything is shuffled; a common n-gram is
    then one number per task.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def emit() -> Iterator[pa.RecordBatch]:
            every = np.concatenate(held)
            before = np.concatenate([histories(t) for t in held])
            for kind, keys in ((WORDS, every), (PAIRS, pairs_of(before, every))):
                found, times = np.unique(keys, return_counts=True)
                yield _blob_rows(kind, found, times.astype(np.uint32), shards)

        for batch in batches:
            for tokens in _batch_tokens(batch.column(0)):
                held.append(tokens)
                size += len(tokens)
                if size >= _TOKENS_HELD:
                    yield from emit()
                    held, size = [], 0
        if held:
            yield from emit()

    def merge(table: pa.Table) -> pa.Table:
        kind, shard = table.column("kind")[0].as_py(), table.column("shard")[0].as_py()
        keys, times = joined(table.column("keys"), np.uint64), joined(table.column("counts"), np.uint32)
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], times[order].astype(np.int64)
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        keys, times = keys[starts], np.add.reduceat(times, starts)
        used, place = np.unique(level_of(times), return_inverse=True)
        # exact: a shard's counts stay far below 2 ** 53
        sums = np.bincount(place, times)
        by_level = [
            {"level": int(q), "n": int(n), "count": int(c)}
            for q, n, c in zip(used, np.bincount(place), sums)
        ]
        return pa.table(
            {
                "kind": pa.array([kind], type=pa.int32()),
                "shard": pa.array([shard], type=pa.int32()),
                "keys": pa.array([keys.tobytes()], type=pa.binary()),
                "counts": pa.array([times.tobytes()], type=pa.binary()),
                "by_level": pa.array([by_level], type=_BY_LEVEL),
            }
        )

    partial = texts.mapInArrow(count, COUNTS)
    return partial.groupBy("kind", "shard").applyInArrow(
        merge, COUNTS + ", by_level array<struct<level:int,n:long,count:long>>"
    )


@dataclass
class Model:
    """What scoring needs; ``path`` is the file of the filter.

    A filter that is not mapped is ``filters``, one of each kind and shard.
    """

    path: str | None
    filters: DataFrame | None
    starts: np.ndarray  # first block by kind and shard
    sizes: np.ndarray  # blocks by kind and shard
    first_probes: int
    tokens: int
    words: int
    values: np.ndarray  # counts by kind and level
    weights: np.ndarray  # by level of the history
    counts: DataFrame
    shards: int

    @property
    def whole(self) -> int:
        return self.tokens + self.words + 1


def _mounted(folder: str) -> str | None:
    """The plain path of a folder in a mounted file system, else nothing."""
    if folder.startswith("file:"):
        return "/" + folder[len("file:") :].lstrip("/")
    return None if "://" in folder else folder


def _built(model: Model) -> Callable[[int, int, bytes, bytes], bytes]:
    sizes, shards, first_probes = model.sizes, model.shards, model.first_probes

    def bits(kind: int, shard: int, keys: bytes, counts: bytes) -> bytes:
        levels = level_of(np.frombuffer(counts, dtype=np.int64))
        own = np.frombuffer(keys, dtype=np.uint64)
        return countfilter.built(own, levels, int(sizes[kind, shard]), shards, first_probes)

    return bits


def _build_file(model: Model, folder: str) -> str:
    """Every shard's part of the filter, written to its place in one file.

    A task that runs again writes the same bytes to the same place.
    """
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/filter-{uuid.uuid4().hex}"
    with open(path, "wb") as file:
        file.truncate(int(model.sizes.sum()) * BLOCK_BYTES)
    starts, build = model.starts, _built(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, shards = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for kind, shard, keys, counts in zip(kinds, shards, batch.column(2), batch.column(3)):
                bits = build(kind, shard, keys.as_buffer(), counts.as_buffer())
                with open(path, "r+b") as file:
                    file.seek(int(starts[kind, shard]) * BLOCK_BYTES)
                    file.write(bits)
                    file.flush()
                    os.fsync(file.fileno())
            yield pa.RecordBatch.from_arrays([pa.array([len(kinds)], type=pa.int64())], names=["n"])

    rows = model.counts.select("kind", "shard", "keys", "counts")
    rows.mapInArrow(run, "n long").agg(F.sum("n")).collect()
    return path


def _build_table(model: Model) -> DataFrame:
    """``kind, shard, bits``: every shard's part of the filter."""
    build = _built(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, shards = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for kind, shard, keys, counts in zip(kinds, shards, batch.column(2), batch.column(3)):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([kind], type=pa.int32()),
                        pa.array([shard], type=pa.int32()),
                        pa.array([build(kind, shard, keys.as_buffer(), counts.as_buffer())], type=pa.binary()),
                    ],
                    names=["kind", "shard", "bits"],
                )

    rows = model.counts.select("kind", "shard", "keys", "counts")
    return materialise(rows.mapInArrow(run, "kind int, shard int, bits binary"), "filters")


def _text_column(df: DataFrame, name: str) -> Column:
    return F.coalesce(df[name].cast("string"), F.lit(""))


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Count, build the filter, and fit the weights, all on every row of ``docs``.

    Null texts are empty and hold one end. An empty table gives a model that
    knows no word: every token then has the probability of an unknown one.
    """
    spark = docs.sparkSession
    texts = docs.select(_text_column(docs, text_col).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = shards_for(int(size))
    counts = materialise(count_ngrams(texts, shards), "ngrams")
    levels = counts.select("kind", "shard", F.inline("by_level"))
    n, total = np.zeros((2, _LEVELS)), np.zeros((2, _LEVELS))
    tokens = words = 0
    for row in levels.groupBy("kind", "level").agg(F.sum("n"), F.sum("count")).collect():
        kind, level, keys, held = row
        n[kind, level], total[kind, level] = keys, held
        if kind == WORDS:
            tokens, words = tokens + held, words + keys
    first_probes = max(1, words).bit_length() + SPARE
    set_by = countfilter.bits_of(np.arange(_LEVELS), first_probes)
    sizes = np.zeros((2, shards), dtype=np.int64)
    # one row of each kind and shard
    parts = counts.select("kind", "shard", "by_level").collect()
    for kind, shard, by_level in parts:
        sizes[kind, shard] = countfilter.blocks_for(sum(q["n"] * int(set_by[q["level"]]) for q in by_level))
    ends = np.cumsum(sizes.ravel()).reshape(sizes.shape)
    model = Model(
        path=None,
        filters=None,
        starts=ends - sizes,
        sizes=sizes,
        first_probes=first_probes,
        tokens=tokens,
        words=words,
        values=np.divide(total, n, out=np.zeros_like(total), where=n > 0),
        weights=np.zeros(_LEVELS),
        counts=counts,
        shards=shards,
    )
    # a level read by chance though no n-gram is on it stands for its threshold
    lowest = np.concatenate(([0], THRESHOLDS))[np.minimum(np.arange(_LEVELS), len(THRESHOLDS))]
    model.values = np.where(n > 0, model.values, lowest)
    folder = _mounted(shared_dir(spark))
    if folder is not None and int(sizes.sum()) * BLOCK_BYTES <= MAX_BYTES:
        model.path = _build_file(model, f"{folder}/casebrook")
    else:
        model.filters = _build_table(model)
    model.weights = _fit_weights(texts, model)
    return model


def _mapped(model: Model) -> Callable[[], Look]:
    """Makes the function that reads levels from the file of the filter."""
    path, starts, sizes, first_probes = model.path, model.starts, model.sizes, model.first_probes

    def make() -> Look:
        # no blocks, no file to map
        bits = np.asarray(np.memmap(path, dtype=np.uint8, mode="r")) if sizes.any() else np.zeros(0, np.uint8)
        kinds = [CountFilter(bits, starts[k], sizes[k], first_probes) for k in (WORDS, PAIRS)]

        def look(kind: int, keys: np.ndarray) -> np.ndarray:
            keys, place = np.unique(keys, return_inverse=True)
            return kinds[kind].levels(keys)[place]

        return look

    return make


def _read(
    look: Look, values: np.ndarray, history: np.ndarray, tokens: np.ndarray
) -> tuple[np.ndarray, ...]:
    """``(level of h, c(h), c(w), c(h w))`` of the tokens of whole texts."""
    of_words = look(WORDS, tokens)
    # a history is the token before it; a text's first token follows its begin
    first = history == _BEGIN
    of_history = np.concatenate((np.zeros(1, dtype=of_words.dtype), of_words[:-1]))
    # every text has one begin and one end
    of_history[first] = of_words[np.flatnonzero(tokens == _END)[0]]
    of_pairs = look(PAIRS, pairs_of(history, tokens))
    c_history = values[WORDS][of_history]
    c_pairs = np.minimum(values[PAIRS][of_pairs], c_history)
    return of_history, c_history, values[WORDS][of_words], c_pairs


def _groups(rows: DataFrame, shards: int) -> DataFrame:
    """Groups of the rows ``(id, text)`` with their different n-grams dealt to shards.

    A row of ``GROUPS`` is a group (``ids, lengths, tokens``; no kind) or the keys
    that it asks of one shard. ``first`` is the number of the group's first row.
    """
    names = [f.split()[0] for f in GROUPS.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    types += [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]

    def batch(columns: list[list]) -> pa.RecordBatch:
        arrays = [pa.array(c, type=t) for c, t in zip(columns, types)]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = _first_row()
        for ids, held in _held(batches):
            tokens = np.concatenate(held)
            lengths = [len(t) for t in held]
            yield batch([[first], [None], [None], [None], [ids], [lengths], [tokens.tobytes()]])
            pairs = pairs_of(np.concatenate([histories(t) for t in held]), tokens)
            for kind, keys in ((WORDS, tokens), (PAIRS, pairs)):
                keys = np.unique(keys)
                cuts = cut_by_shard(keys, shards)
                full = np.flatnonzero(np.diff(cuts))
                blobs = [keys[cuts[s] : cuts[s + 1]].tobytes() for s in full]
                n, none = len(full), [None] * len(full)
                yield batch([[first] * n, [kind] * n, full.tolist(), blobs, none, none, none])
            first += len(held)

    return rows.mapInArrow(run, GROUPS)


def _levels_of_groups(groups: DataFrame, model: Model) -> DataFrame:
    """``first, kind, shard, levels`` of the keys that groups ask of shards."""
    shards, first_probes, filters = model.shards, model.first_probes, model.filters

    def probe(asked: pa.Table, filters: pa.Table) -> pa.Table:
        shard = asked.column("shard")[0].as_py() if asked.num_rows else 0
        sizes = np.zeros(shards, dtype=np.int64)
        bits = np.zeros(0, dtype=np.uint8)
        if filters.num_rows:  # else no n-gram of the shard was counted
            bits = np.frombuffer(filters.column("bits")[0].as_buffer(), dtype=np.uint8)
            sizes[shard] = len(bits) // BLOCK_BYTES
        found = CountFilter(bits, np.zeros(shards), sizes, first_probes)
        blobs = [
            found.levels(np.frombuffer(k.as_buffer(), dtype=np.uint64)).tobytes()
            for k in asked.column("keys")
        ]
        return asked.select(["first", "kind", "shard"]).append_column(
            "levels", pa.array(blobs, type=pa.binary())
        )

    asked = groups.where("kind is not null").select("first", "kind", "shard", "keys")
    return (
        asked.groupBy("kind", "shard")
        .cogroup(filters.groupBy("kind", "shard"))
        .applyInArrow(probe, "first long, kind int, shard int, levels binary")
    )


def _listed(found: pa.Table) -> Look:
    """Levels of a group's keys, from what its shards answered."""
    kinds, shards = found.column("kind").to_numpy(), found.column("shard").to_numpy()
    by_kind = {}
    for kind in (WORDS, PAIRS):
        own = np.flatnonzero(kinds == kind)
        own = own[np.argsort(shards[own])]  # shards are ranges of ascending keys
        by_kind[kind] = joined(found.column("levels").take(pa.array(own)), np.uint8)

    def look(kind: int, keys: np.ndarray) -> np.ndarray:
        different, place = np.unique(keys, return_inverse=True)
        if len(different) != len(by_kind[kind]):
            raise ValueError("levels of other keys")
        return by_kind[kind][place]

    return look


Judge = Callable[[int, list, np.ndarray, np.ndarray, Look], Iterator[pa.RecordBatch]]


def _judged(rows: DataFrame, model: Model, judge: Judge, schema: str) -> DataFrame:
    """What ``judge`` gives for every group of the rows ``(id, text)``.

    It is called with the number of the group's first row, the ids, the tokens,
    the lengths of the rows and a function that reads levels.
    """
    if model.filters is None:
        make = _mapped(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            look = make()
            first = _first_row()
            for ids, held in _held(batches):
                yield from judge(first, ids, np.concatenate(held), np.array([len(t) for t in held]), look)
                first += len(held)

        return rows.mapInArrow(run, schema)

    def one(group: pa.Table, found: pa.Table) -> pa.Table:
        ids, lengths = group.column("ids")[0].as_py(), np.array(group.column("lengths")[0].as_py())
        tokens = joined(group.column("tokens"), np.uint64)
        first = group.column("first")[0].as_py()
        return pa.Table.from_batches(judge(first, ids, tokens, lengths, _listed(found)))

    groups = materialise(_groups(rows, model.shards), "groups")
    levels = _levels_of_groups(groups, model)
    whole = groups.where("kind is null").select("first", "ids", "lengths", "tokens")
    return whole.groupBy("first").cogroup(levels.groupBy("first")).applyInArrow(one, schema)


def _histories_of_rows(tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    before = histories(tokens)
    before[np.cumsum(lengths) - lengths] = _BEGIN
    return before


def _fit_weights(texts: DataFrame, model: Model) -> np.ndarray:
    """For each level of the history the weight of ``GRID`` that fits best.

    Every training token is taken out of the counts that judge it; a pair seen
    once is then unseen.
    """
    whole, values = model.whole, model.values
    grid = np.array(GRID)

    def fit(
        first: int, ids: list, tokens: np.ndarray, lengths: np.ndarray, look: Look
    ) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((_LEVELS, len(grid)))
        history = _histories_of_rows(tokens, lengths)
        level, c_history, c_word, c_pair = _read(look, values, history, tokens)
        left = c_pair - 1
        seen = left >= 1
        one = np.maximum(c_word, 1) / whole
        # an unseen pair's fit is that of its word and of 1 - g
        unseen = level[~seen]
        sums[:, :] += np.bincount(unseen, np.log(one[~seen]), _LEVELS)[:, None]
        sums[:, :] += np.bincount(unseen, minlength=_LEVELS)[:, None] * np.log1p(-grid)
        two = left / np.maximum(c_history - 1, 1)
        del c_history, c_word, c_pair, left
        order = np.flatnonzero(seen)
        order = order[np.argsort(level[order], kind="stable")]
        level, one, two = level[order], one[order].astype(np.float32), two[order].astype(np.float32)
        starts = np.flatnonzero(np.diff(level, prepend=np.uint8(0)))  # a seen pair's history has a level
        both, rest = np.empty_like(one), np.empty_like(one)
        for k, g in enumerate(grid.astype(np.float32) if len(level) else ()):
            np.multiply(two, g, out=both)
            np.multiply(one, 1 - g, out=rest)
            both += rest
            np.log(both, out=both)
            sums[level[starts], k] += np.add.reduceat(both, starts, dtype=np.float64)
        used = np.flatnonzero(sums.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, type=pa.int32()), pa.array(sums[used].tolist(), type=pa.list_(pa.float64()))],
            names=["level", "fit"],
        )

    rows = texts.select(F.lit(None).cast("long").alias("doc_id"), "text")
    fits = (
        _judged(rows, model, fit, "level int, fit array<double>")
        .groupBy("level")
        .agg(*(F.sum(F.get("fit", F.lit(k))).alias(f"g{k}") for k in range(len(grid))))
        .collect()
    )
    weights = np.zeros(_LEVELS)
    for row in fits:
        # equal but for the order of a sum: the lower weight
        fit = np.array(row[1:])
        weights[row["level"]] = grid[np.flatnonzero(fit >= fit.max() - 1e-9 * abs(fit.max()))[0]]
    return weights


def _hot_words(model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the words that make up a ``HOT`` th of the tokens."""
    least = max(1, -(-model.tokens // HOT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, times = joined(batch.column(0), np.uint64), joined(batch.column(1), np.int64)
            hot = times >= least
            yield pa.RecordBatch.from_arrays(
                [pa.array([keys[hot].tobytes()]), pa.array([times[hot].tobytes()])],
                names=["keys", "counts"],
            )

    words = model.counts.where(f"kind = {WORDS}").select("keys", "counts")
    rows = words.mapInArrow(run, "keys binary, counts binary").collect()
    keys = np.concatenate([np.frombuffer(r["keys"], dtype=np.uint64) for r in rows] or [np.zeros(0, np.uint64)])
    times = np.concatenate([np.frombuffer(r["counts"], dtype=np.int64) for r in rows] or [np.zeros(0, np.int64)])
    order = np.argsort(keys)
    return keys[order], times[order]


SCORED = (
    "first long, row long, doc_id long, n_tokens long, n_known long, base double, score double, "
    "shard int, keys binary, docs binary, times binary"
)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of each row.

    ``score`` is the model's log10 probability of the text with its end;
    ``base_score`` is that of single words with one added to each exact count.
    Null texts are empty; repeated rows are scored each; null ids stay null.
    """
    spark = docs.sparkSession
    shards, whole, values = model.shards, model.whole, model.values
    weights = spark.sparkContext.broadcast(model.weights)
    hot = spark.sparkContext.broadcast(_hot_words(model))
    names = [f.split()[0] for f in SCORED.split(", ")]
    types = [pa.int64()] * 5 + [pa.float64()] * 2 + [pa.int32()] + [pa.binary()] * 3

    def rows(columns: list[list]) -> pa.RecordBatch:
        arrays = [pa.array(c, type=t) for c, t in zip(columns, types)]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def finish(
        first: int, ids: list, tokens: np.ndarray, lengths: np.ndarray, look: Look
    ) -> Iterator[pa.RecordBatch]:
        hot_keys, hot_times = hot.value
        n = len(ids)
        doc = np.repeat(np.arange(n), lengths)
        history = _histories_of_rows(tokens, lengths)
        level, c_history, c_word, c_pair = _read(look, values, history, tokens)
        g = weights.value[level]
        two = np.divide(c_pair, c_history, out=np.zeros(len(tokens)), where=c_history > 0)
        scores = np.log10(g * two + (1 - g) * (c_word + 1) / whole)
        sums = np.bincount(doc, scores, n)
        del history, level, c_history, c_word, c_pair, g, two, scores
        if len(hot_keys):
            at = np.minimum(np.searchsorted(hot_keys, tokens), len(hot_keys) - 1)
            is_hot = hot_keys[at] == tokens
            times = hot_times[at]
        else:
            is_hot, times = np.zeros(len(tokens), dtype=bool), np.zeros(len(tokens), dtype=np.int64)
        known = np.bincount(doc[is_hot], minlength=n)
        base = np.bincount(doc[is_hot], np.log10(times[is_hot] + 1.0), n)
        base = base - lengths * np.log10(float(whole))
        yield rows(
            [[first] * n, list(range(first, first + n)), ids, lengths, known, base, sums]
            + [[None] * n] * 4
        )
        rest = ~is_hot
        order = np.lexsort((doc[rest], tokens[rest]))
        words, own = tokens[rest][order], doc[rest][order]
        if len(words):
            new = np.concatenate(([True], (words[1:] != words[:-1]) | (own[1:] != own[:-1])))
            starts = np.flatnonzero(new)
            often = np.diff(np.append(starts, len(words))).astype(np.uint32)
            words, own = words[starts], own[starts].astype(np.uint32)
            cuts = cut_by_shard(words, shards)
            full = np.flatnonzero(np.diff(cuts))
            part = lambda x: [x[cuts[s] : cuts[s + 1]].tobytes() for s in full]
            nulls = [None] * len(full)
            yield rows(
                [nulls, [first] * len(full), nulls, nulls, nulls, nulls, nulls]
                + [full, part(words), part(own), part(often)]
            )

    scored = materialise(
        _judged(
            docs.select(docs[id_col].cast("long").alias("doc_id"), _text_column(docs, text_col).alias("text")),
            model,
            finish,
            SCORED,
        ),
        "scored",
    )

    def look_up(found: pa.Table, counted: pa.Table) -> pa.Table:
        """What rare words add to the rows of each group, from the exact counts of one shard."""
        keys = joined(counted.column("keys"), np.uint64)
        times = joined(counted.column("counts"), np.int64)
        own_docs, more_base, more_known = [], [], []
        for words, own, often in zip(*(found.column(c) for c in ("keys", "docs", "times"))):
            words = np.frombuffer(words.as_buffer(), dtype=np.uint64)
            own = np.frombuffer(own.as_buffer(), dtype=np.uint32)
            often = np.frombuffer(often.as_buffer(), dtype=np.uint32).astype(np.float64)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, words), len(keys) - 1)
                c = np.where(keys[at] == words, times[at], 0)
            else:
                c = np.zeros(len(words), dtype=np.int64)
            docs_here, place = np.unique(own, return_inverse=True)
            own_docs.append(docs_here.tobytes())
            more_base.append(np.bincount(place, often * np.log10(c + 1.0)).tobytes())
            more_known.append(np.bincount(place, often * (c > 0)).astype(np.int64).tobytes())
        parts = {"docs": own_docs, "base": more_base, "known": more_known}
        return pa.table(
            {
                "row": found.column("row").cast(pa.int64()),
                "shard": found.column("shard").cast(pa.int32()),
                **{name: pa.array(blobs, type=pa.binary()) for name, blobs in parts.items()},
            }
        )

    def add(plain: pa.Table, added: pa.Table) -> pa.Table:
        """The rows of a group with what its shards add to them, in their order."""
        n = plain.num_rows
        known, base = np.zeros(n, dtype=np.int64), np.zeros(n)
        place = plain.column("row").to_numpy() - plain.column("first").to_numpy()
        added = added.sort_by("shard")  # sums do not hang on the order of arrival
        for own, more, seen in zip(*(added.column(c) for c in ("docs", "base", "known"))):
            own = np.frombuffer(own.as_buffer(), dtype=np.uint32)
            base[own] += np.frombuffer(more.as_buffer(), dtype=np.float64)
            known[own] += np.frombuffer(seen.as_buffer(), dtype=np.int64)
        return pa.table(
            {
                "doc_id": plain.column("doc_id"),
                "n_tokens": plain.column("n_tokens"),
                "n_known": pa.array(plain.column("n_known").to_numpy() + known[place], type=pa.int64()),
                "base_score": pa.array(plain.column("base").to_numpy() + base[place], type=pa.float64()),
                "score": plain.column("score"),
            }
        )

    rare = scored.where("shard is not null").select("shard", "row", "keys", "docs", "times")
    exact = model.counts.where(f"kind = {WORDS}").select("shard", "keys", "counts")
    added = (
        rare.groupBy("shard")
        .cogroup(exact.groupBy("shard"))
        .applyInArrow(look_up, "row long, shard int, docs binary, base binary, known binary")
    )
    # a group is the rows of about _TOKENS_READ tokens
    plain = scored.where("shard is null").select(
        "first", "row", "doc_id", "n_tokens", "n_known", "base", "score"
    )
    return (
        plain.groupBy("first")
        .cogroup(added.groupBy("row"))
        .applyInArrow(add, "doc_id long, n_tokens long, n_known long, base_score double, score double")
        .select(
            "doc_id",
            "n_tokens",
            "n_known",
            F.lit(model.tokens).cast("long").alias("train_tokens"),
            "base_score",
            "score",
        )
    )


def held_out(doc_id: Column, parts: int = 7, part: int = 2) -> Column:
    """Whether the CRC-32 of an id as text leaves ``part``; a null id's text is empty."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % parts == part


def score_held_out(docs: DataFrame) -> DataFrame:
    """Train on the rows that are not held out, score all of ``docs(doc_id, text)``."""
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return score(docs, model).withColumn("held_out", held_out(F.col("doc_id")))
