"""Word-level FM-index: a k-ordered suffix array's BWT in a wavelet matrix, searched backwards for many patterns at once."""

from __future__ import annotations

import numpy as np


class Bits:
    """Bit vector with constant-time rank."""

    def __init__(self, flags: np.ndarray):
        self.n = len(flags)
        pad = np.zeros((self.n // 64 + 1) * 64, np.uint8)
        pad[: self.n] = flags
        self.words = np.packbits(pad, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]).astype(np.uint32 if self.n < 1 << 32 else np.int64)

    def rank(self, pos: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        w = pos >> 6
        low = (np.uint64(1) << (pos & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & low)


class WaveletMatrix:
    def __init__(self, x: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits: list[Bits] = []
        self.zeros: list[int] = []
        for k in range(self.levels - 1, -1, -1):
            b = (x >> k & 1).astype(bool)
            self.bits.append(Bits(b))
            self.zeros.append(int(len(x) - b.sum()))
            x = np.concatenate([x[~b], x[b]])
        self.start = self._descend(np.arange(sigma), np.zeros(sigma, np.int64))

    def _descend(self, c: np.ndarray, pos: np.ndarray) -> np.ndarray:
        for k, (b, z) in enumerate(zip(self.bits, self.zeros)):
            one = b.rank(pos)
            pos = np.where(c >> (self.levels - 1 - k) & 1, z + one, pos - one)
        return pos

    def rank(self, c: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """How often each symbol comes before its position."""
        return self._descend(c, pos) - self.start[c]


def k_ranks(text: np.ndarray, k: int) -> np.ndarray:
    """Dense ranks of positions by their next k symbols (past the end: 0)."""

    def joined(r: np.ndarray, shifts: list[int]) -> np.ndarray:
        base = int(r.max()) + 1
        key = np.zeros(len(r), np.int64)
        for s in shifts:
            key *= base
            key[: len(r) - s] += r[s:]
        return np.unique(key, return_inverse=True)[1].astype(np.int64)

    r, have = text.astype(np.int64), 1
    while have < k:
        parts = 3 if int(r.max()) < 1 << 20 else 2
        step = [min(have * j, k - have) for j in range(1, parts)]
        r = joined(r, [0, *dict.fromkeys(step)])
        have = step[-1] + have
    return r


class FMIndex:
    """Text of symbols 1..; 0 parts its pieces.  Patterns of up to ``k`` symbols have exact row intervals.

    Rows are ordered by their next k symbols only (ties by position), which keeps every interval of a pattern of at most
    k symbols contiguous and its bounds countable, so backward search is exact up to that length.
    """

    def __init__(self, text: np.ndarray, k: int):
        self.k, self.n = k, len(text)
        r = k_ranks(text, k)
        self.rows = np.argsort(r, kind="stable").astype(np.int32 if self.n < 1 << 31 else np.int64)
        sigma = int(text.max()) + 1
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])[:-1]
        self.bwt = WaveletMatrix(text[self.rows - 1].astype(np.int64), sigma)
        new = np.ones(self.n, bool)
        new[1:] = np.diff(r[self.rows]) != 0
        self.group_start = np.flatnonzero(new)
        self.group = (np.cumsum(new, dtype=np.int64) - 1).astype(self.rows.dtype)

    def extend(self, c: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Row bound of each pattern with a symbol put before it."""
        return self.before[c] + self.bwt.rank(c, lo)

    def interval(self, pattern: np.ndarray) -> tuple[int, int]:
        """Rows that begin with a pattern of 1 to k known symbols."""
        lo, hi = np.zeros(1, np.int64), np.full(1, self.n)
        for c in pattern[::-1]:
            one = np.asarray([c])
            lo, hi = self.extend(one, lo), self.extend(one, hi)
        return int(lo[0]), int(hi[0])

    def stream(self, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        """Matching statistics of indexed pieces, cut at k: yields (piece, position, group of rows with the same k symbols).

        All pieces are read from their right ends together.  A piece is in the index itself, so every step keeps a match;
        once k symbols long, its row lies in the group of rows that share the window's k symbols.
        """
        order = np.argsort(-lengths, kind="stable")
        sizes = lengths[order]
        ends = (starts + lengths)[order]
        lo = np.zeros(len(order), np.int64)
        alive = len(order)
        for t in range(1, int(sizes[0]) + 1 if len(order) else 0):
            while alive and sizes[alive - 1] < t:
                alive -= 1
            at = ends[:alive] - t
            lo[:alive] = self.extend(text[at].astype(np.int64), lo[:alive])
            if t >= self.k:
                group = self.group[lo[:alive]]
                lo[:alive] = self.group_start[group]  # the window's interval: rows of a group are in no further order
                yield order[:alive], at, group
