"""N-best segmentation of whole texts into the pieces of a SentencePiece model.

Blanks become U+2581, one is put in front, and a text is cut into chunks before
each run of blanks and around line ends; no piece of the vocabulary reaches over
such a cut, so the best segmentations of a text are made of good segmentations of its chunks. The
score of a segmentation is the sum of its pieces' stored scores. Those of a model
of BPE type are merge ranks, so the best one here is not the model's own encoding,
which follows its merges. A character
that no piece spells has an edge of its own, ``UNKNOWN`` below the least score,
and is written as its bytes.

Different chunks of a task go through the forward and the backward Viterbi pass
together, one NumPy step per character. The forward scores are exact heuristics
for an A* search from the end of a chunk: it takes up paths in the order of their
final scores and never leaves a best path without need. What a chunk loses with
its second-best path is known from both passes; to find the N best
segmentations of a text, only the N - 1 chunks that lose least are searched.

What is known of a chunk stays in arrays, by its number, and is kept from task to task
of a worker. Each chunk's path is decoded once; a text comes back whole when all of
its chunks do.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

BEST = 4
UNKNOWN = 10.0
BLANK = "▁"
CHUNK = re.compile(f"\n|{BLANK}*[^{BLANK}\n]+|{BLANK}+")
_LONG = 48  # characters beyond which a chunk is worked on alone
_CACHED = 400_000
_TOGETHER = 1 << 12
_NONE = -1e300
_PAD = 1 << 32  # after the end of a chunk; no character
_SLOT = np.uint64(44)  # the bits of a hash below those that name its slot

Path = tuple[float, tuple[int, ...]]  # score, ids


def model_path(name: str = "piece_bpe_32k.model") -> str:
    """Where the installed public model of that name lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """The vocabulary of a model: normal pieces with scores, and byte pieces."""

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.byte_ids = [0] * 256
        self.spelled: dict[int, bytes] = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.spelled[i] = bytes([value])
            elif model.is_control(i):
                self.spelled[i] = b""
            elif not (model.is_unknown(i) or model.is_unused(i)):
                if re.search(f"[^{BLANK}]{BLANK}", piece):
                    raise ValueError(f"piece {piece!r} reaches over a blank")
                if "\n" in piece:
                    raise ValueError(f"piece {piece!r} reaches over a line end")
                self.ids[piece] = i
                self.scores[piece] = model.get_score(i)
                self.spelled[i] = piece.replace(BLANK, " ").encode()
        self.unknown = min(self.scores.values()) - UNKNOWN
        self.longest = max(map(len, self.ids))
        keys = self.hashes(list(self.ids))
        order = np.argsort(keys)
        # the last of each array stands for no piece
        self.none = len(keys)
        self.keys = np.append(keys[order], np.uint64(2**64 - 1))
        self.key_scores = np.append(np.array(list(self.scores.values()))[order], _NONE)
        self.key_ids = np.append(np.array(list(self.ids.values()), dtype=np.int32)[order], np.int32(-1))
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one hash")
        slots = np.arange(1 << 64 - int(_SLOT), dtype=np.uint64)
        self.first = np.searchsorted(self.keys[:-1], slots << _SLOT).astype(np.int32)
        self.maybe = np.zeros(len(slots), dtype=bool)
        self.maybe[self.keys[:-1] >> _SLOT] = True
        parts = [self.spelled.get(i, b"") for i in range(model.get_piece_size())]
        sizes = np.array(list(map(len, parts)))
        self.spelled_starts = np.cumsum(sizes) - sizes
        self.spelled_sizes = np.where([i in self.spelled for i in range(len(parts))], sizes, -1)
        self.spelled_bytes = np.frombuffer(b"".join(parts), dtype=np.uint8)

    @staticmethod
    def hashes(pieces: list[str]) -> np.ndarray:
        lengths, text = _columns(pieces)
        out = np.zeros(len(pieces), dtype=np.uint64)
        for size, characters in enumerate(text):
            own = lengths > size
            out[own] = Pieces.grown(out[own], characters[own])
        return out

    @staticmethod
    def grown(hashed: np.ndarray, character: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (hashed ^ (character + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)

    def places(self, hashed: np.ndarray) -> np.ndarray:
        """Where the piece of each hash stands in the arrays; ``none`` without one."""
        out = np.full(hashed.size, self.none, dtype=np.int32)
        slot = (hashed >> _SLOT).view(np.int64).ravel()
        live = np.flatnonzero(self.maybe[slot])
        wanted = hashed.ravel()[live]
        at = self.first[slot[live]]
        while len(live):  # keys of one slot follow each other in their order
            key = self.keys[at]
            same = key == wanted
            out[live[same]] = at[same]
            later = np.flatnonzero(key < wanted)
            live, wanted, at = live[later], wanted[later], at[later] + 1
        return out.reshape(hashed.shape)

    def edge(self, text: str) -> tuple[float, tuple[int, ...]] | None:
        """Score and ids of one edge of the lattice, if there is one."""
        if text in self.ids:
            return self.scores[text], (self.ids[text],)
        if len(text) == 1:
            return self.unknown, tuple(self.byte_ids[b] for b in text.encode("utf-8", "surrogatepass"))
        return None

    def decode(self, ids: list[int]) -> str:
        """The text of ids; without the blank put in front, control ids are silent."""
        return text_of(self.spell(ids))

    def spell(self, ids: list[int]) -> bytes:
        """The bytes of ids one after another; those of a path are those of its parts."""
        try:
            return b"".join(map(self.spelled.__getitem__, ids))
        except KeyError as missing:
            raise ValueError(f"id {missing} is no piece") from None

    def spell_each(self, paths: list[bytes]) -> list[bytes]:
        """The bytes of each of many paths of pieces, given as ids of 32 bits."""
        ids = np.frombuffer(b"".join(paths), dtype="<u4")
        sizes = self.spelled_sizes[ids]
        if (sizes < 0).any():
            raise ValueError(f"id {ids[sizes.argmin()]} is no piece")
        raw = self.spelled_bytes[_gathered(self.spelled_starts[ids], sizes)].tobytes()
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum([0, *map(len, paths)]) // 4].tolist()
        return [raw[a:b] for a, b in itertools.pairwise(ends)]


def text_of(spelled: bytes) -> str:
    return spelled.decode("utf-8", "replace").removeprefix(" ")


def spells(spelled: bytes, chunk: str) -> bool:
    return spelled.decode("utf-8", "replace") == chunk.replace(BLANK, " ")


def _gathered(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of stretches of so many items, one stretch after another."""
    ends = np.cumsum(sizes)
    out = np.repeat(starts - ends + sizes, sizes)
    out += np.arange(len(out))
    return out


def _columns(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths, and the characters by place and string, with ``_PAD`` after the end."""
    lengths = np.array(list(map(len, strings)))
    joined = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    text = np.full((lengths.max(), len(strings)), _PAD, dtype=np.uint64)
    row = _gathered(np.zeros_like(lengths), lengths)
    text[row, np.repeat(np.arange(len(strings)), lengths)] = joined
    return lengths, text


def chunks_of(text: str) -> list[str]:
    return CHUNK.findall(BLANK + text.replace(" ", BLANK)) if text else []


def forward(pieces: Pieces, chunk: str) -> list[float]:
    """Best score of every beginning of a chunk."""
    best = [0.0] + [_NONE] * len(chunk)
    for end in range(1, len(chunk) + 1):
        for start in range(max(0, end - pieces.longest), end):
            edge = pieces.edge(chunk[start:end])
            if edge and best[start] + edge[0] > best[end]:
                best[end] = best[start] + edge[0]
    return best


def n_best(pieces: Pieces, chunk: str, count: int) -> list[Path]:
    """The ``count`` best segmentations (or all), best first.

    Equal scores are in a fixed order that depends on the chunk alone.
    """
    best = forward(pieces, chunk)
    # the heap is in the order of final scores, as what lies before is known
    # exactly; of equal ones the latest goes first, so ties don't widen the search
    heap = [(-best[-1], 0, len(chunk), 0.0, None)]
    made = 0
    out: list[Path] = []
    while heap and len(out) < count:
        _, _, end, after, tail = heapq.heappop(heap)
        if end == 0:
            ids: list[int] = []
            while tail:
                ids += tail[0]
                tail = tail[1]
            out.append((after, tuple(ids)))
            continue
        for start in range(max(0, end - pieces.longest), end):
            edge = pieces.edge(chunk[start:end])
            if edge:
                made -= 1
                score = edge[0] + after
                heapq.heappush(heap, (-(best[start] + score), made, start, score, (edge[1], tail)))
    return out


def _passes(pieces: Pieces, chunks: list[str]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Best score, best ids and loss of the second best, of chunks of bounded length."""
    lengths, text = _columns(chunks)
    width, n = text.shape
    longest = min(pieces.longest, width)
    places = np.empty((longest, width, n), dtype=np.int32)  # [size - 1, start]: the piece of so many characters
    edges = np.empty((longest, width, n))  # and its score
    hashed = np.zeros((width, n), dtype=np.uint64)
    for size in range(1, longest + 1):
        rows = width - size + 1
        hashed = Pieces.grown(hashed[:rows], text[size - 1 :])
        places[size - 1, :rows] = place = pieces.places(hashed)
        np.take(pieces.key_scores, place, out=edges[size - 1, :rows], mode="clip")
    edges[0][(places[0] == pieces.none) & (text != _PAD)] = pieces.unknown
    alpha = np.full((width + 1, n), _NONE)
    alpha[0] = 0
    came = np.zeros((width + 1, n), dtype=np.int16)
    for end in range(1, width + 1):
        for size in range(1, min(longest, end) + 1):
            score = alpha[end - size] + edges[size - 1, end - size]
            np.copyto(came[end], size, where=score > alpha[end])
            np.maximum(alpha[end], score, out=alpha[end])
    beta = np.full((width + 1, n), _NONE)
    beta[lengths, np.arange(n)] = 0
    for start in range(width - 1, -1, -1):
        for size in range(1, min(longest, width - start) + 1):
            np.maximum(beta[start], edges[size - 1, start] + beta[start + size], out=beta[start])
    total = alpha[lengths, np.arange(n)]
    # edges on the best path are taken out; the best path over any other edge is the second best
    at, live = lengths.copy(), np.arange(n)
    walked: list[tuple[np.ndarray, np.ndarray]] = []
    steps = np.zeros(n, dtype=np.int64)
    while len(live):
        size = came[at[live], live].astype(np.int64)
        start = at[live] - size
        edges[size - 1, start, live] = _NONE
        walked.append((live, places[size - 1, start, live]))
        steps[live] += 1
        at[live] = start
        live = live[start > 0]
    second = np.full(n, _NONE)
    for size in range(1, longest + 1):
        rows = width - size + 1
        through = alpha[:rows] + edges[size - 1, :rows]
        through += beta[size:]
        np.maximum(second, through.max(axis=0), out=second)
    # steps from the end; within a chunk the last step is its first piece
    ends = np.cumsum(steps)
    path = np.empty(ends[-1], dtype=np.int32)
    spelled = np.zeros(n, dtype=bool)  # chunks with a character written as bytes
    for step, (owner, place) in enumerate(walked, 1):
        path[ends[owner] - step] = place
        spelled[owner[place == pieces.none]] = True
    raw = pieces.key_ids[path].astype("<u4").tobytes()
    ids = [raw[a:b] for a, b in itertools.pairwise([0, *(ends * 4).tolist()])]
    for k in np.flatnonzero(spelled).tolist():
        ids[k] = np.array(n_best(pieces, chunks[k], 1)[0][1], dtype="<u4").tobytes()
    return total, ids, total - second


class Numbers(dict):
    """Numbers strings in the order in which they first come."""

    def __missing__(self, string: str) -> int:
        self[string] = number = len(self)
        return number


class Segmenter:
    """Keeps what is known of chunks, a bounded number of them."""

    def __init__(self, pieces: Pieces, best: int) -> None:
        self.pieces, self.best = pieces, best
        self.known = Numbers()
        # by number; ids are stretches of one array
        self.scores = np.zeros(0)
        self.losses = np.zeros(0)
        self.wrong = np.zeros(0, dtype=bool)  # ids that do not decode to the chunk
        self.starts = np.zeros(0, dtype=np.int64)
        self.sizes = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype="<u4")
        self.uses = np.zeros(0, dtype=np.int64)
        self.lists: dict[str, list[tuple[float, bytes, bytes]]] = {}

    def forget(self) -> None:
        """Leaves the chunks that came again since the last time, at most half of ``_CACHED``."""
        kept = np.flatnonzero(self.uses > 1)
        if len(kept) > _CACHED // 2:
            kept = np.sort(kept[np.argsort(-self.uses[kept], kind="stable")[: _CACHED // 2]])
        chunks = list(self.known)
        self.known = Numbers(zip([chunks[k] for k in kept.tolist()], range(len(kept))))
        self.lists = {c: found for c, found in self.lists.items() if c in self.known}
        self.scores, self.losses, self.wrong = self.scores[kept], self.losses[kept], self.wrong[kept]
        self.ids = self.ids[_gathered(self.starts[kept], self.sizes[kept])]
        self.sizes = self.sizes[kept]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.uses = np.zeros(len(kept), dtype=np.int64)

    def learn(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Takes up the chunks of texts; the numbers of each text's chunks."""
        if len(self.known) > _CACHED:
            self.forget()
        at = [np.fromiter(map(self.known.__getitem__, c), dtype=np.int64, count=len(c)) for c in texts]
        old = len(self.scores)
        fresh = list(itertools.islice(self.known, old, None))
        if fresh:
            scores, losses, wrong, ids = self._found(fresh)
            sizes = np.array(list(map(len, ids))) // 4
            self.scores = np.concatenate((self.scores, scores))
            self.losses = np.concatenate((self.losses, losses))
            self.wrong = np.concatenate((self.wrong, wrong))
            self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(sizes) - sizes))
            self.sizes = np.concatenate((self.sizes, sizes))
            self.ids = np.concatenate((self.ids, np.frombuffer(b"".join(ids), dtype="<u4")))
            self.uses = np.concatenate((self.uses, np.zeros(len(fresh), dtype=np.int64)))
        if at:
            self.uses += np.bincount(np.concatenate(at), minlength=len(self.uses))
        return at

    def _found(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """Scores, losses, whether they decode to something else, and ids of the best paths."""
        scores, losses, wrong = np.zeros(len(chunks)), np.zeros(len(chunks)), np.zeros(len(chunks), dtype=bool)
        ids = [b""] * len(chunks)
        lengths = np.array(list(map(len, chunks)))
        order = np.argsort(lengths, kind="stable")
        short = int((lengths <= _LONG).sum())
        for low in range(0, short, _TOGETHER):
            own = order[low : min(low + _TOGETHER, short)]
            part = [chunks[k] for k in own.tolist()]
            scores[own], paths, losses[own] = _passes(self.pieces, part)
            wrong[own] = [not spells(x, c) for x, c in zip(self.pieces.spell_each(paths), part)]
            for k, path in zip(own.tolist(), paths):
                ids[k] = path
        for k in order[short:].tolist():
            found = n_best(self.pieces, chunks[k], 2)
            scores[k], path = found[0]
            losses[k] = scores[k] - found[1][0] if len(found) > 1 else np.inf
            ids[k] = np.array(path, dtype="<u4").tobytes()
            wrong[k] = not spells(self.pieces.spell(list(path)), chunks[k])
        return scores, losses, wrong, ids

    def _paths(self, chunk: str) -> list[tuple[float, bytes, bytes]]:
        if chunk not in self.lists:
            found = n_best(self.pieces, chunk, self.best)
            self.lists[chunk] = [
                (score, np.array(ids, dtype="<u4").tobytes(), self.pieces.spell(list(ids))) for score, ids in found
            ]
        return self.lists[chunk]

    def ranked(self, chunks: list[str], at: np.ndarray) -> Iterator[tuple[float, bytes, dict[int, bytes]]]:
        """Score and ids (little-endian, 32 bits) of the best segmentations of a text.

        ``at`` are the numbers of its chunks. Third are the bytes of chunks, by their
        place, that do not take their best path.
        """
        sizes = self.sizes[at]
        base = self.ids[_gathered(self.starts[at], sizes)].tobytes()
        total = sum(self.scores[at].tolist())
        yield total, base, {}
        if self.best == 1 or not chunks:
            return
        losses = self.losses[at]
        count = min(self.best - 1, len(chunks))
        weak = np.flatnonzero(losses <= np.partition(losses, count - 1)[count - 1])
        weak = weak[np.argsort(losses[weak], kind="stable")[:count]].tolist()
        lists = [self._paths(chunks[k]) for k in weak]
        ends = np.cumsum(sizes) * 4
        bounds = {k: (int(ends[k]) - 4 * int(sizes[k]), int(ends[k])) for k in weak}
        # choices of one path per weak chunk, least loss first
        first = (0,) * len(weak)
        heap, seen, made = [(0.0, first)], {first}, 1
        while heap and made < self.best:
            loss, choice = heapq.heappop(heap)
            if any(choice):
                other = {k: found[c] for k, found, c in zip(weak, lists, choice)}
                own, low = [], 0
                for k in sorted(other):
                    own += [base[low : bounds[k][0]], other[k][1]]
                    low = bounds[k][1]
                made += 1
                yield total - loss, b"".join([*own, base[low:]]), {k: path[2] for k, path in other.items()}
            for i, found in enumerate(lists):
                c = choice[i]
                if c + 1 < len(found):
                    more = choice[:i] + (c + 1,) + choice[i + 1 :]
                    if more not in seen:
                        seen.add(more)
                        heapq.heappush(heap, (loss + found[c][0] - found[c + 1][0], more))

    def segment(self, chunks: list[str]) -> list[tuple[float, bytes, list[bytes]]]:
        """Score, ids and bytes, chunk by chunk, of the best segmentations of a text."""
        (at,) = self.learn([chunks])
        paths = [self.ids[a : a + n].tobytes() for a, n in zip(self.starts[at].tolist(), self.sizes[at].tolist())]
        spelled = self.pieces.spell_each(paths)
        return [
            (score, ids, [other.get(k, own) for k, own in enumerate(spelled)])
            for score, ids, other in self.ranked(chunks, at)
        ]


SCHEMA = (
    "doc_id long, rank long, score double, n_pieces long, ids_crc32 long, round_trip boolean, ids binary"
)


def segmented(segmenter: Segmenter, keys: list[int | None], texts: list[str]) -> list[tuple]:
    """Rows of ``SCHEMA``; every segmentation is decoded, equal paths of a chunk once."""
    cut = [chunks_of(t) for t in texts]
    rows: list[tuple] = []
    for key, text, chunks, at in zip(keys, texts, cut, segmenter.learn(cut)):
        wrong = set(np.flatnonzero(segmenter.wrong[at]).tolist())
        for rank, (score, ids, other) in enumerate(segmenter.ranked(chunks, at), 1):
            same = wrong <= other.keys() and all(spells(x, chunks[k]) for k, x in other.items())
            rows.append((key, rank, score, len(ids) // 4, zlib.crc32(ids), same and BLANK not in text, ids))
    return rows


@functools.lru_cache(maxsize=1)
def _segmenter(path: str, best: int, changed: int) -> Segmenter:
    """That of this worker, which stays for its next tasks."""
    return Segmenter(Pieces(path), best)


def segment_documents(docs: DataFrame, path: str | None = None, best: int = BEST) -> DataFrame:
    """The ``best`` best segmentations (or all) of each row of ``docs(doc_id, text)``.

    One pass, no shuffle. ``ids`` are little-endian 32-bit ids; ``round_trip``
    tells of each segmentation whether it decodes to the text. Null and empty texts have one
    segmentation, of no pieces. U+2581 in a text reads as a blank, as the model's
    format has it. Rows are segmented each; null ids stay null.
    """
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = _segmenter(path, best, os.stat(path).st_mtime_ns)
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for batch in batches:
            for low in range(0, len(batch), 500):
                part = batch.slice(low, 500)
                texts = [t or "" for t in part.column(1).to_pylist()]
                rows = segmented(segmenter, part.column(0).to_pylist(), texts)
                types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
                arrays = [pa.array(c, type=t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(
        run, SCHEMA
    )


def decode_ids(df: DataFrame, ids_col: str = "ids", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``df`` with the text of each row's little-endian 32-bit ids as a last column.

    Null ids have a null text, no ids an empty one; an id that is no piece is an
    error. Another column of the name ``text_col`` is replaced.
    """
    path = path or model_path()
    if text_col == ids_col:
        raise ValueError("the text needs a column of its own")
    rows = df.drop(text_col)
    names = [*rows.columns, text_col]
    at = rows.columns.index(ids_col)
    schema = T.StructType([*rows.schema.fields, T.StructField(text_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        for batch in batches:
            ids = batch.column(at).to_pylist()
            texts = [None if x is None else pieces.decode(np.frombuffer(x, dtype="<u4").tolist()) for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, type=pa.string())], names=names)

    return rows.mapInArrow(run, schema)
