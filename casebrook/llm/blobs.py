"""Sorted 64-bit keys that travel as binary blobs, dealt to shards by high bits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def joined(column: pa.Array | pa.ChunkedArray, dtype: type) -> np.ndarray:
    """The values of all blobs of a column, one after another."""
    parts = [np.frombuffer(x.as_buffer(), dtype=dtype) for x in column]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=dtype)


def cut_by_shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard begins and ends in ascending keys; shards: a power of two."""
    if shards == 1:
        return np.array([0, len(keys)])
    bounds = np.arange(1, shards, dtype=np.uint64) << np.uint64(64 - (shards.bit_length() - 1))
    return np.concatenate(([0], np.searchsorted(keys, bounds), [len(keys)]))


def shards_for(size: int, least: int = 4, most: int = 16) -> int:
    """A power of two of shards for so many bytes of text, 16 MiB to each."""
    return 1 << max(least, min(most, int(size >> 24).bit_length()))
