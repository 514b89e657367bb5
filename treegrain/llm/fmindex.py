"""A compressed FM-index over words: Burrows-Wheeler transform in a wavelet matrix of packed bits, searched for many patterns at once."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a sequence of non-negative integers (a shorter suffix before its extensions), by prefix doubling."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + ahead
        order = np.argsort(key, kind="stable" if n < 64 else None)
        sorted_key = key[order]
        new = np.zeros(n, np.int64)
        new[order[1:]] = np.cumsum(sorted_key[1:] != sorted_key[:-1])
        rank = new
        if n == 0 or rank[order[-1]] == n - 1 or width >= n:
            return order
        width *= 2


class BitVector:
    """Bits packed in 64-bit words, with a count before each word; rank in constant time."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words)[:-1], out=self.before[1:])

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        w = i >> 6
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))


class WaveletMatrix:
    """Sequence of integers below 2**levels; counts of any symbol in any prefix take one rank per level."""

    def __init__(self, values: np.ndarray):
        self.levels = max(1, int(values.max(initial=0)).bit_length())
        self.bits, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (values >> level) & 1
            self.bits.append(BitVector(bit))
            self.zeros.append(int(len(values) - bit.sum()))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, symbol: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
        """How often each symbol occurs before each end."""
        begin = np.zeros(len(symbol), np.int64)
        ends = [e.copy() for e in ends]
        for k in range(self.levels):
            one = ((symbol >> (self.levels - 1 - k)) & 1).astype(bool)
            for x in (begin, *ends):
                r = self.bits[k].rank1(x)
                x[:] = np.where(one, self.zeros[k] + r, x - r)
        return [e - begin for e in ends]


class FMIndex:
    """Index of sequences of symbols (1 and up), each followed by a separator that no pattern holds. A sequence may stand for several equal ones (weights)."""

    def __init__(self, sequences: list[np.ndarray], weights: list[int] | None = None):
        self.starts = np.cumsum([0, *(len(s) + 1 for s in sequences)])
        text = np.zeros(int(self.starts[-1]) + 1, np.int64)
        for s, at in zip(sequences, self.starts):
            text[at : at + len(s)] = s + 1
            text[at + len(s)] = 1
        self.text = text
        order = suffix_array(text)
        # Occurrences of an interval's pattern: of each suffix, as many as the sequences that it stands for.
        times = np.append(np.repeat(np.ones(len(sequences), np.int64) if weights is None else np.asarray(weights, np.int64), np.diff(self.starts)), 0)
        self.times = np.append(0, np.cumsum(times[order]))
        self.wavelet = WaveletMatrix(text[order - 1])
        self.below = np.zeros(int(text.max(initial=0)) + 2, np.int64)
        np.cumsum(np.bincount(text, minlength=len(self.below) - 1), out=self.below[1:])

    def matching_statistics(self, ends: np.ndarray, most: int, occurrences: int = 2) -> np.ndarray:
        """For each place of the indexed text, the length (up to `most`) of the longest run of symbols ending there that occurs so often in the index.

        All places go back symbol by symbol together; one leaves when its interval stands for too few occurrences.
        """
        length = np.zeros(len(ends), np.int64)
        active, at = np.arange(len(ends)), ends.copy()
        lo, hi = np.zeros(len(ends), np.int64), np.full(len(ends), len(self.text), np.int64)
        for _ in range(most):
            symbol = self.text[at]
            a, b = self.wavelet.rank(symbol, lo, hi)
            base = self.below[symbol]
            lo, hi = base + a, base + b
            go = (self.times[hi] - self.times[lo] >= occurrences) & (symbol > 1)
            active, at, lo, hi = active[go], at[go] - 1, lo[go], hi[go]
            if not len(active):
                break
            length[active] += 1
            inside = at >= 0
            active, at, lo, hi = active[inside], at[inside], lo[inside], hi[inside]
        return length
