"""A log-frequency Bloom filter, laid out in shards of 64 KiB blocks.

A key of level q is put in as several numbers: 1, the multiples of ``STRIDE`` up to
q, and those from the last multiple (or 1) to q. Its level is read back by probing
1, then the multiples until one is missing, then the numbers after the last one
found until one is missing. Levels are never read too low. The first number
decides whether a key was ever stored and takes as many probes as the caller asks
for; multiples take ``STRIDE_PROBES``, as a false one weighs most, the others
``MORE_PROBES``. At the size given by ``blocks_for`` half of the bits are set, so n
probes are all hit by chance in one of 2 ** n keys.

A key's shard is its highest bits, its block in the shard the bits below them. All
its probes lie in that block, so ascending keys read the filter in order, and a
shard can be built and probed alone: with the whole filter or only a shard of it
in hand, a key reads the same level.
"""

from __future__ import annotations

import math

import numpy as np

from casebrook.llm.arrowwords import mix
from casebrook.llm.bloom import BLOCK_BYTES, blocks_of

STRIDE = 8
STRIDE_PROBES = 12
MORE_PROBES = 7
MOST = 255
_BLOCK_BITS = BLOCK_BYTES * 8
_BLOCK, _MASK = np.uint64(_BLOCK_BITS), np.uint64(_BLOCK_BITS - 1)
_THREE, _SEVEN = np.uint64(3), np.uint64(7)
_ROUND = 8  # probes from one pair of hashes
_STEP = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.uint64(0xD1B54A32D192ED03)
_SLICE = 64  # blocks that are built at a time


def bits_of(levels: np.ndarray, first_probes: int) -> np.ndarray:
    """How many bits a key of each level sets."""
    steps, rest = levels // STRIDE, levels % STRIDE
    more = np.where(steps > 0, rest, np.maximum(rest - 1, 0))
    return (levels > 0) * (first_probes + steps * STRIDE_PROBES + more * MORE_PROBES)


def blocks_for(bits: int) -> int:
    """Blocks of which so many bits fill a half."""
    return max(1, math.ceil(bits / math.log(2) / _BLOCK_BITS))


def _shard_bits(shards: int) -> np.uint64:
    return np.uint64(shards.bit_length() - 1)


def shards_of(keys: np.ndarray, shards: int) -> np.ndarray:
    if shards == 1:
        return np.zeros(len(keys), dtype=np.int64)
    return (keys >> (np.uint64(64) - _shard_bits(shards))).astype(np.int64)


def _pairs(keys: np.ndarray, number: np.ndarray | int, turn: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        mixed = mix(keys + np.uint64(number) * _STEP + np.uint64(turn) * _TURN)
    return mixed, (mixed >> np.uint64(32)) | np.uint64(1)


def _probes(number: int, first_probes: int) -> int:
    if number == 1:
        return first_probes
    return MORE_PROBES if number % STRIDE else STRIDE_PROBES


def built(keys: np.ndarray, levels: np.ndarray, blocks: int, shards: int, first_probes: int) -> bytes:
    """The bits of one shard's ascending keys; a few blocks are open at a time."""
    own = blocks_of(keys << _shard_bits(shards), blocks)
    parts = []
    for low in range(0, blocks, _SLICE):
        high = min(low + _SLICE, blocks)
        a, b = np.searchsorted(own, [low, high])
        held, wanted, base = keys[a:b], levels[a:b], (own[a:b] - low).astype(np.uint64) * _BLOCK
        bits = np.zeros((high - low) * _BLOCK_BITS, dtype=bool)
        for number in range(1, int(wanted.max(initial=0)) + 1):
            # multiples for all levels above, others for those up to the next multiple
            put = wanted >= number
            if number > 1 and number % STRIDE:
                put &= wanted // STRIDE == number // STRIDE
            some, at = held[put], base[put]
            for i in range(_probes(number, first_probes) if len(some) else 0):
                if i % _ROUND == 0:
                    one, two = _pairs(some, number, i // _ROUND)
                bits[at + (one & _MASK)] = True
                one += two
        parts.append(np.packbits(bits, bitorder="little").tobytes())
    return b"".join(parts)


class CountFilter:
    """Bits and where each shard begins and how long it is, in blocks."""

    def __init__(
        self, bits: np.ndarray, starts: np.ndarray, sizes: np.ndarray, first_probes: int
    ) -> None:
        self.bits, self.first_probes = bits, first_probes
        self.starts, self.sizes = starts.astype(np.int64), sizes.astype(np.uint64)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Levels of ascending keys; those of a shard without blocks have none."""
        shards = len(self.starts)
        out = np.zeros(len(keys), dtype=np.uint8)
        shard = shards_of(keys, shards)
        live = np.flatnonzero(self.sizes[shard] > 0)
        keys, shard = keys[live], shard[live]
        block = ((keys << _shard_bits(shards)) >> np.uint64(32)) * self.sizes[shard] >> np.uint64(32)
        base = (self.starts[shard].astype(np.uint64) + block) * _BLOCK
        here = self._has(keys, base, np.ones(len(keys), dtype=np.uint64), self.first_probes)
        live, keys, base = live[here], keys[here], base[here]
        out[live] = 1
        number = STRIDE
        at, held, places = live, keys, base
        while len(at) and number <= MOST:
            here = self._has(held, places, np.full(len(at), number, dtype=np.uint64), STRIDE_PROBES)
            at, held, places = at[here], held[here], places[here]
            out[at] = number
            number += STRIDE
        step = 1
        while len(live) and step < STRIDE:
            following = out[live].astype(np.uint64) + np.uint64(1)
            # the next multiple was missing already
            open_ = following % np.uint64(STRIDE) != 0
            live, keys, base, following = live[open_], keys[open_], base[open_], following[open_]
            here = self._has(keys, base, following, MORE_PROBES)
            live, keys, base = live[here], keys[here], base[here]
            out[live] += 1
            step += 1
        return out

    def _has(
        self, keys: np.ndarray, base: np.ndarray, numbers: np.ndarray, probes: int
    ) -> np.ndarray:
        """Where the keys' numbers are all hit."""
        live = np.arange(len(keys))
        for i in range(probes):
            if not len(live):
                break
            if i % _ROUND == 0:
                one, two = _pairs(keys, numbers, i // _ROUND)
            at = base + (one & _MASK)
            one += two
            byte = self.bits[(at >> _THREE).view(np.int64)]
            hit = (byte >> (at & _SEVEN).astype(np.uint8)) & 1 == 1
            if not hit.all():
                live, keys, base, numbers = live[hit], keys[hit], base[hit], numbers[hit]
                one, two = one[hit], two[hit]
        return live
