"""An FM-index over word sequences: truncated suffix order, BWT, wavelet matrix.

Suffixes are ordered by their first ``2 ** ROUNDS`` words, enough for patterns
one word shorter. Backward search then narrows an interval of suffixes word by
word, with two rank queries on the wavelet matrix each; all patterns of a batch
take each step together.
"""

from __future__ import annotations

import numpy as np

ROUNDS = 4
MAX_PATTERN = (1 << ROUNDS) - 1


class _Ranks:
    """A bit vector with the number of ones before any place."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, dtype=bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate(([0], np.cumsum(ones)[:-1]))

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class FMIndex:
    """Index of sequences of 64-bit words; no match runs from one to the next."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray) -> None:
        """``words``: all sequences one after another; ``lengths``: of each."""
        self.alphabet, codes = np.unique(words, return_inverse=True)
        # 0 ends each sequence
        total = len(words) + len(lengths)
        at = np.arange(len(words)) + np.repeat(np.arange(len(lengths)), lengths)
        text = np.zeros(total, dtype=np.int64)
        text[at] = codes + 1
        self.text = text
        self.starts = np.cumsum(lengths) - lengths + np.arange(len(lengths))
        order = text.copy()
        for k in range(ROUNDS):
            step = 1 << k
            after = np.zeros(total, dtype=np.int64)
            after[:-step] = order[step:] + 1
            order = np.unique(order * (total + len(self.alphabet) + 2) + after, return_inverse=True)[1]
        self.suffixes = np.argsort(order, kind="stable")
        bwt = text[self.suffixes - 1]
        symbols = len(self.alphabet) + 1
        self.smaller = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols))))
        self.levels = []
        for shift in range(max(1, (symbols - 1).bit_length()) - 1, -1, -1):
            bits = (bwt >> shift) & 1 == 1
            self.levels.append((shift, _Ranks(bits), int(np.count_nonzero(~bits))))
            bwt = np.concatenate((bwt[~bits], bwt[bits]))
        every = np.arange(symbols)
        self.origin = self._descend(every, np.zeros(symbols, dtype=np.int64))

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, ranks, zeros in self.levels:
            ones = ranks.ones(at)
            at = np.where((symbols >> shift) & 1 == 1, zeros + ones, at - ones)
        return at

    def step(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where an interval's bound moves when a symbol is put before the pattern."""
        return self.smaller[symbols] + self._descend(symbols, at) - self.origin[symbols]

    def codes(self, words: np.ndarray) -> np.ndarray:
        """Symbols of words; -1 for a word that the index has not."""
        if not len(self.alphabet):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.alphabet, words), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == words, at + 1, -1)

    def match(
        self, codes: np.ndarray, ends: np.ndarray, reach: np.ndarray, least: int = 1
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics at places of a streamed sequence of symbols.

        For the words that end before ``ends``, read backwards for up to
        ``reach`` words: the length of the longest run that the index holds at
        ``least`` times, and the interval of its suffixes. Symbols below 1 match
        nothing.
        """
        if len(reach) and reach.max() > MAX_PATTERN:
            raise ValueError(f"patterns of more than {MAX_PATTERN} words")
        length = np.zeros(len(ends), dtype=np.int64)
        low = np.zeros(len(ends), dtype=np.int64)
        high = np.full(len(ends), len(self.text), dtype=np.int64)
        live = np.arange(len(ends))
        while len(live):
            live = live[reach[live] > length[live]]
            symbols = codes[ends[live] - 1 - length[live]]
            live, symbols = live[symbols > 0], symbols[symbols > 0]
            new_low, new_high = self.step(symbols, low[live]), self.step(symbols, high[live])
            found = new_high - new_low >= least
            live = live[found]
            low[live], high[live] = new_low[found], new_high[found]
            length[live] += 1
        return length, low, high
