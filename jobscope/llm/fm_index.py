"""A compressed FM-index over integer symbols, searched many patterns at a time.

The Burrows-Wheeler transform is kept as a wavelet matrix: one bit for each
symbol and level, with a running count for each 64 bits.  Suffixes are ordered
by their first ``DEPTH`` symbols, which is all that patterns of at most that
length can see.
"""

from __future__ import annotations

import numpy as np

DEPTH = 16


class Bits:
    """Bits with rank."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])[:-1]

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        w = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, size: int):
        """``symbols`` are below ``size``."""
        self.levels, self.zeros = [], []
        self.depth = max(1, int(size - 1).bit_length())
        for level in reversed(range(self.depth)):
            bit = (symbols >> level & 1).astype(bool)
            self.levels.append(Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        self.first = self._down(np.arange(size), np.zeros(size, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, level in enumerate(reversed(range(self.depth))):
            ones = self.levels[k].rank(at)
            at = np.where(symbol >> level & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        return self._down(symbol, at) - self.first[symbol]


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in the order of their first DEPTH symbols, equal ones by place."""
    n = len(text)
    rank = text.astype(np.int64)
    length = 1
    order = np.argsort(rank, kind="stable")
    while length < DEPTH:
        later = np.zeros(n, np.int64)
        later[: n - length] = rank[length:] + 1
        key = rank * (int(rank.max(initial=0)) + 2) + later
        order = np.argsort(key, kind="stable")
        run = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], run[1:] != run[:-1]]))
        length *= 2
    return order


class FMIndex:
    def __init__(self, text: np.ndarray, size: int):
        """``text``: symbols below ``size``."""
        self.n = len(text)
        self.order = suffix_order(text)
        self.bwt = WaveletMatrix(text[self.order - 1], size)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of each row: the range of its suffixes (empty if it doesn't occur)."""
        n = len(patterns)
        low, high = np.zeros(n, np.int64), np.full(n, self.n, np.int64)
        for symbol in patterns.T[::-1]:
            both = self.bwt.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
            low, high = self.starts[symbol] + both[:n], self.starts[symbol] + both[n:]
        return low, np.maximum(low, high)
