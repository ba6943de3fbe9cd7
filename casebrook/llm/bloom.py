"""A Bloom filter of bounded size, built by Spark and probed with NumPy.

The bits lie in blocks of 64 KiB; all bits of a key are in one block. Tasks set
the bits of their own blocks, so the filter is put together from disjoint parts
and the driver never holds more than the filter itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from casebrook.llm.arrowwords import mix

BLOCK_BYTES = 1 << 16
_BLOCK_BITS = BLOCK_BYTES * 8
PROBES = 5
KEYS = "block int, keys binary"


class Bloom:
    """Bits and the probing of them; false hits only."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits
        self.blocks = len(bits) // BLOCK_BYTES

    def contains(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), dtype=bool)
        live = np.arange(len(keys))
        at = blocks_of(keys, self.blocks) * BLOCK_BYTES
        one, two = _pair(keys)
        for i in range(PROBES):
            bit = _bit(one, two, i)
            hit = (self.bits[at + (bit >> 3)] >> (bit & 7).astype(np.uint8)) & 1 == 1
            live, at, one, two = live[hit], at[hit], one[hit], two[hit]
        out[live] = True
        return out


def _pair(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mixed = mix(keys ^ np.uint64(0xA0761D6478BD642F))
    return mixed, (mixed >> np.uint64(32)) | np.uint64(1)


def _bit(one: np.ndarray, two: np.ndarray, i: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((one + np.uint64(i) * two) & np.uint64(_BLOCK_BITS - 1)).astype(np.int64)


def blocks_of(keys: np.ndarray, blocks: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


def n_blocks(keys: int, bits_per_key: int, max_bytes: int) -> int:
    """Blocks for so many keys, never more than ``max_bytes`` of them."""
    return max(1, min(max_bytes // BLOCK_BYTES, -(-keys * bits_per_key // _BLOCK_BITS)))


def filled(keys: np.ndarray, bits_per_key: int) -> np.ndarray:
    """The bits of a filter of these keys, as large as they need."""
    blocks = max(1, -(-len(keys) * bits_per_key // _BLOCK_BITS))
    bits = np.zeros(blocks * _BLOCK_BITS, dtype=bool)
    at = blocks_of(keys, blocks) * _BLOCK_BITS
    one, two = _pair(keys)
    for i in range(PROBES):
        bits[at + _bit(one, two, i)] = True
    return np.packbits(bits, bitorder="little")


def dealt(keys: np.ndarray, blocks: int) -> pa.RecordBatch:
    """Keys by block, as rows of ``KEYS``."""
    keys = np.sort(keys)
    own = blocks_of(keys, blocks)
    cuts = np.flatnonzero(np.diff(own)) + 1
    low, high = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(keys)]))
    if not len(keys):
        low = high = np.zeros(0, dtype=np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(own[low], type=pa.int32()),
            pa.array([keys[a:b].tobytes() for a, b in zip(low, high)], type=pa.binary()),
        ],
        names=["block", "keys"],
    )


def of_blocks(rows: DataFrame, blocks: int) -> Bloom:
    """The filter of rows of ``KEYS``; a block's rows are streamed, not gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, bits = None, np.zeros(_BLOCK_BITS, dtype=bool)

        def done() -> pa.RecordBatch:
            packed = np.packbits(bits, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays(
                [pa.array([current], type=pa.int32()), pa.array([packed], type=pa.binary())],
                names=["block", "keys"],
            )

        for batch in batches:
            for block, keys in zip(batch.column(0).to_pylist(), batch.column(1)):
                if block != current:
                    if current is not None:
                        yield done()
                    current, bits[:] = block, False
                one, two = _pair(np.frombuffer(keys.as_buffer(), dtype=np.uint64))
                for i in range(PROBES):
                    bits[_bit(one, two, i)] = True
        if current is not None:
            yield done()

    parts = min(blocks, 64)
    together = rows.repartition(parts, "block").sortWithinPartitions("block")
    whole = np.zeros(blocks * BLOCK_BYTES, dtype=np.uint8)
    for row in together.mapInArrow(run, KEYS).collect():
        low = row["block"] * BLOCK_BYTES
        whole[low : low + BLOCK_BYTES] = np.frombuffer(row["keys"], dtype=np.uint8)
    return Bloom(whole)


def of_column(df: DataFrame, column: str, bits_per_key: int, max_bytes: int) -> Bloom:
    """The filter of the values of a 64-bit integer column without nulls."""
    blocks = n_blocks(df.count(), bits_per_key, max_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield dealt(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), blocks)

    return of_blocks(df.select(column).mapInArrow(run, KEYS), blocks)
