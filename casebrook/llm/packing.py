"""Hierarchical multi-length packing of token sequences.

Windows come in tiers of 2048, 1024, 512 and 256 tokens. A document gives whole
longest windows first; what remains is routed to the shortest tier that holds
it. Each tier is packed, longest first: the gap beside a document is filled with
the largest pieces of shorter tiers that fit, then closed by cutting one more.
Where no shorter piece is left, a window is halved and its rest routed down. The
last few tokens of a block are cut at powers of two, so no padding is needed.

Packing needs no view of the whole table: each task packs blocks of a bounded
number of tokens from its own split, and there is no shuffle. Within a block
rows are packed in the order of ``doc_id``, so a repeated task gives the same
sequences if its split holds the same rows in the same blocks.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from casebrook.llm import tokens

TIERS = (2048, 1024, 512, 256)
END_ID = 1
BLOCK_TOKENS = 4 << 20
STEP_TOKENS = 1 << 17
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, tier long, step_group long"
)

Item = tuple[int, int, int]  # length, document, start
Window = tuple[int, list[Item]]  # size, pieces in order


class _Pools:
    """Pieces that wait, by tier, each tier in ascending order of length."""

    def __init__(self, tiers: tuple[int, ...]) -> None:
        self.tiers = tiers
        self.by_tier: dict[int, list[Item]] = {t: [] for t in tiers}

    def route(self, item: Item) -> None:
        fitting = [t for t in self.tiers if t >= item[0]]
        insort(self.by_tier[fitting[-1]], item)

    def shorter(self, tier: int) -> list[int]:
        """Tiers from which a window of ``tier`` may be filled."""
        return [t for t in self.tiers if t < tier] or [tier]

    def fill(self, pieces: list[Item], gap: int, tier: int) -> int:
        """Add pieces until the gap is closed or nothing is left; the gap then."""
        for t in self.shorter(tier):
            pool = self.by_tier[t]
            while gap and pool:
                at = bisect_right(pool, (gap, 1 << 62, 0)) - 1
                if at < 0:
                    break
                pieces.append(pool.pop(at))
                gap -= pieces[-1][0]
        if gap:
            for t in reversed(self.shorter(tier)):
                if self.by_tier[t]:
                    length, doc, start = self.by_tier[t].pop()
                    pieces.append((gap, doc, start))
                    self.route((length - gap, doc, start + gap))
                    return 0
        return gap


def _halved(pieces: list[Item], size: int) -> tuple[list[Item], list[Item]]:
    """The first ``size`` tokens of a window's pieces, and the rest."""
    first, rest = [], []
    for length, doc, start in pieces:
        take = min(length, size)
        if take:
            first.append((take, doc, start))
        if length > take:
            rest.append((length - take, doc, start + take))
        size -= take
    return first, rest


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[Window]:
    """Windows that hold every token of documents of these lengths once.

    Every window is full. Its size is a tier, or a lower power of two for the
    last few tokens of all.
    """
    done: list[Window] = []
    pools = _Pools(tiers)
    top = tiers[0]
    for doc, length in enumerate(lengths):
        whole = length // top
        done.extend((top, [(top, doc, k * top)]) for k in range(whole))
        if length - whole * top:
            pools.route((length - whole * top, doc, whole * top))
    for tier in tiers:
        pool = pools.by_tier[tier]
        while pool:
            pieces = [pool.pop()]
            gap = pools.fill(pieces, tier - pieces[0][0], tier)
            if not gap:
                done.append((tier, pieces))
            elif tier > tiers[-1]:
                first, rest = _halved(pieces, tier // 2)
                done.append((tier // 2, first))
                for item in rest:
                    pools.route(item)
            else:
                left = tier - gap
                while left:
                    size = 1 << (left.bit_length() - 1)
                    first, pieces = _halved(pieces, size)
                    done.append((size, first))
                    left -= size
    return done


def step_groups(sizes: list[int], step: int = STEP_TOKENS) -> list[int]:
    """A step number for each window, so that steps hold equal token counts.

    Steps are of one tier as long as a tier fills them; the rests of all tiers
    share further steps, longest windows first. Only the last may be short.
    """
    out = [0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    number, rests = 0, []
    by_size: dict[int, list[int]] = {}
    for i in order:
        by_size.setdefault(sizes[i], []).append(i)
    for size, own in by_size.items():
        each = max(1, step // size)
        full = len(own) // each * each
        for k, i in enumerate(own[:full]):
            out[i] = number + k // each
        number += full // each
        rests.extend(own[full:])
    held = 0
    for i in rests:
        if held + sizes[i] > step:
            number, held = number + 1, 0
        out[i] = number
        held += sizes[i]
    return out


def pack_documents(
    docs: DataFrame,
    path: str | None = None,
    pattern: str | None = None,
    tiers: tuple[int, ...] = TIERS,
    end_id: int = END_ID,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """Pack ``docs(doc_id, text)``: one row per piece.

    ``<|endoftext|>`` in a text is one id, as the public tokenizer file has it. A
    null or empty text is its end id alone. A null ``doc_id`` stays null and
    sorts first; repeated rows are packed as often as they come; an empty table
    gives no rows; other columns are not read. ``sequence_id`` joins the task's
    number and a counter. A document of any length is cut into windows.
    """
    path = path or tokens.vocabulary_path()
    pattern = pattern or tokens.vocabulary_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tokens.encoder(path, pattern)
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 36
        sequences = steps = 0
        held: list[tuple[int | None, np.ndarray]] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal sequences, steps
            held.sort(key=lambda d: (d[0] is not None, d[0] or 0, len(d[1])))
            windows = pack([len(d[1]) for d in held], tiers)
            groups = step_groups([w[0] for w in windows])
            rows: list[tuple] = []
            for k, (tier, pieces) in enumerate(windows):
                offset = 0
                for length, doc, start in pieces:
                    key, own = held[doc]
                    part = own[start : start + length].astype("<u4").tobytes()
                    rows.append(
                        (key, start, length, zlib.crc32(part), len(own), base + sequences + k,
                         offset, tier, base + steps + groups[k])
                    )
                    offset += length
            sequences += len(windows)
            steps += max(groups, default=-1) + 1
            names = [f.split()[0] for f in SCHEMA.split(", ")]
            columns = list(zip(*rows)) or [()] * len(names)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, type=pa.int64()) for c in columns], names=names
            )

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for key, text in zip(keys, batch.column(1)):
                own = np.append(tokens.ids_with_special(encoding, text.as_py()), np.uint32(end_id))
                held.append((key, own))
                size += len(own)
                if size >= block_tokens:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(
        run, SCHEMA
    )
