"""Order statistics of moving windows.

A window's values are kept in sorted blocks that take a value in or out, and tell the value of a rank, in logarithmic time; a window
moves to the next sample by the few values that leave and enter.  Sums come from running sums.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame

from .ordered import DAY, over_chunks

#: Qn's consistency factor at the Gaussian and its corrections for 2 to 9 values.
QN_SCALE = 2.2219
QN_SMALL = {2: 0.399, 3: 0.994, 4: 0.512, 5: 0.844, 6: 0.611, 7: 0.857, 8: 0.669, 9: 0.872}


class SortedWindow:
    """A multiset of numbers in sorted blocks of at most ``2 * load``."""

    def __init__(self, load: int = 1024):
        self.load, self.blocks, self.tops, self._before, self.size = load, [], [], None, 0

    def __len__(self) -> int:
        return self.size

    def add(self, x: float) -> None:
        self._before = None
        self.size += 1
        if not self.blocks:
            self.blocks, self.tops = [[x]], [x]
            return
        k = min(bisect_left(self.tops, x), len(self.tops) - 1)
        block = self.blocks[k]
        insort(block, x)
        if len(block) > 2 * self.load:
            self.blocks[k : k + 1] = [block[: self.load], block[self.load :]]
            self.tops[k : k + 1] = [block[self.load - 1], block[-1]]
        else:
            self.tops[k] = block[-1]

    def remove(self, x: float) -> None:
        self._before = None
        self.size -= 1
        k = bisect_left(self.tops, x)
        block = self.blocks[k]
        del block[bisect_left(block, x)]
        if block:
            self.tops[k] = block[-1]
        else:
            del self.blocks[k], self.tops[k]

    def at(self, i: int) -> float:
        if len(self.blocks) == 1:
            return self.blocks[0][i]
        if self._before is None:
            self._before = list(accumulate(map(len, self.blocks)))
        k = bisect_right(self._before, i)
        return self.blocks[k][i - (self._before[k - 1] if k else 0)]

    def below(self, x: float) -> int:
        """How many are less than ``x``."""
        k = bisect_left(self.tops, x)
        return sum(map(len, self.blocks[:k])) + (bisect_left(self.blocks[k], x) if k < len(self.blocks) else 0)

    def quantile(self, p: float) -> float:
        """Interpolated between the two nearest ranks; NaN of nothing."""
        n = len(self)
        if not n:
            return np.nan
        place = (n - 1) * min(max(p, 0.0), 1.0)
        i = int(place)
        a = self.at(i)
        return a if place == i else a + (self.at(i + 1) - a) * (place - i)

    def values(self) -> list[float]:
        return [x for b in self.blocks for x in b]

    def deviation(self, k: int, m: float, split: int) -> float:
        """The k-th (from 0) of all distances to ``m``, where ``split`` values are less than it: a search for how many of the nearest
        k lie on the left, whose distances grow to the left, as the right ones do to the right."""
        n = len(self)
        lo, hi = max(0, k - (n - split)), min(k, split)
        while lo < hi:
            i = (lo + hi) // 2
            if m - self.at(split - 1 - i) < self.at(split + k - i - 1) - m:
                lo = i + 1
            else:
                hi = i
        left = m - self.at(split - 1 - lo) if lo < split else np.inf
        right = self.at(split + k - lo) - m if split + k - lo < n else np.inf
        return min(left, right)

    def mad(self) -> tuple[float, float]:
        """Median, and median distance to it."""
        n = len(self)
        if not n:
            return np.nan, np.nan
        m = (self.at((n - 1) // 2) + self.at(n // 2)) / 2
        split = self.below(m)
        d = self.deviation((n - 1) // 2, m, split)
        return m, d if n % 2 else (d + self.deviation(n // 2, m, split)) / 2


def kth_difference(x: np.ndarray, k: int) -> float:
    """The k-th smallest (from 1) of the differences of all pairs of the sorted ``x``, of which none but the last few are made: row j
    holds x[j + m] - x[j], rising in m; weighted medians of the rows' middles cut the rows until about n differences are left."""
    n = len(x)
    row = np.arange(n - 1)
    lo, hi = np.zeros(n - 1, np.int64), n - 1 - row

    def fewer(a: float, with_equal: bool) -> np.ndarray:
        low, high = np.zeros(n - 1, np.int64), n - 1 - row
        while (open_ := low < high).any():
            mid = (low + high) // 2
            d = x[np.minimum(row + mid + 1, n - 1)] - x[row]
            yes = open_ & ((d <= a) if with_equal else (d < a))
            low, high = np.where(yes, mid + 1, low), np.where(open_ & ~yes, mid, high)
        return low

    while (hi - lo).sum() > 2 * n:
        live = np.flatnonzero(hi > lo)
        mids = x[live + (lo[live] + hi[live]) // 2 + 1] - x[live]
        order = np.argsort(mids, kind="stable")
        weight = np.cumsum((hi - lo)[live][order])
        a = mids[order][np.searchsorted(weight, weight[-1] / 2)]
        less = fewer(a, False)
        if k <= less.sum():
            hi = np.minimum(hi, less)
            continue
        upto = fewer(a, True)
        if k <= upto.sum():
            return float(a)
        lo = np.maximum(lo, upto)
    size = hi - lo
    j = np.repeat(row, size)
    m = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + lo[j] + 1
    left = x[j + m] - x[j]
    at = k - int(lo.sum()) - 1
    return float(np.partition(left, at)[at])


def qn(values: np.ndarray) -> float:
    """Rousseeuw and Croux's Qn of sorted values; NaN of fewer than two."""
    n = len(values)
    if n < 2:
        return np.nan
    h = n // 2 + 1
    return _scaled(kth_difference(values, h * (h - 1) // 2), n)


def _scaled(d: float, n: int) -> float:
    return QN_SCALE * d * (QN_SMALL[n] if n in QN_SMALL else n / (n + 1.4) if n % 2 else n / (n + 3.8))


def sliding(t: np.ndarray, x: np.ndarray, half: int, rows: np.ndarray, weights: np.ndarray | None = None) -> Iterator[SortedWindow]:
    """The known values in (t - half, t + half] of each of ``rows``, one window that moves; with whole ``weights`` values are in it
    so many times."""
    window, lo, hi = SortedWindow(), 0, 0
    first = np.searchsorted(t, t[rows] - half, side="right")
    last = np.searchsorted(t, t[rows] + half, side="right")
    xs, times = x.tolist(), [1] * len(x) if weights is None else weights.tolist()
    known = (~np.isnan(x)).tolist()
    for a, b in zip(first.tolist(), last.tolist()):
        if a >= hi:  # nothing in common with the window before
            window, lo, hi = SortedWindow(), a, a
        for i in range(hi, b):
            if known[i]:
                for _ in range(times[i]):
                    window.add(xs[i])
        for i in range(lo, a):
            if known[i]:
                for _ in range(times[i]):
                    window.remove(xs[i])
        lo, hi = a, b
        yield window


def _reach(x: np.ndarray, a: float) -> np.ndarray:
    """For each of the sorted ``x`` the place after the last number that is at most ``a`` more, as differences are rounded."""
    n = len(x)
    if a < 0:
        return np.arange(1, n + 1)
    h = np.searchsorted(x, x + a, side="right")
    while (more := (h < n) & (x[np.minimum(h, n - 1)] - x <= a)).any():
        h = np.where(more, np.searchsorted(x, x[np.minimum(h, n - 1)], side="right"), h)
    while (less := x[h - 1] - x > a).any():
        h = np.where(less, np.searchsorted(x, x[h - 1], side="left"), h)
    return h


class QnWindow:
    """Qn of a multiset that numbers enter and leave.

    How many differences are at most ``low``, and which lie in (low, high], is kept up with each number that comes or goes: it
    meets few others at such a distance.  The bracket holds a few differences a number, and is laid anew when the wanted
    rank, which moves by a share of the numbers a step, has left it; so a step costs little more in large windows than in small ones.
    """

    def __init__(self, per: float = 4.0):
        self.per, self.x, self.low, self.high, self.until, self.inner, self.count = per, [], None, 0.0, 0, None, 0

    def _change(self, v: float, sign: int) -> None:
        """Takes the differences between ``v`` and all of ``x`` (without it) in or out."""
        x, off = self.x, lambda u: u - v
        i, j = bisect_left(x, -self.low, key=off), bisect_right(x, self.low, key=off)
        if self.low < 0:  # no difference is that small
            i = j = bisect_left(x, v)
        self.until += sign * (j - i)
        h, k = bisect_left(x, -self.high, 0, i, key=off), bisect_right(x, self.high, j, key=off)
        self.count += sign * (i - h + k - j)
        if self.inner is not None:
            each = self.inner.add if sign > 0 else self.inner.remove
            for u in x[h:i]:
                each(v - u)
            for u in x[j:k]:
                each(u - v)

    def add(self, v: float) -> None:
        if self.low is not None:
            self._change(v, 1)
        insort(self.x, v)

    def remove(self, v: float) -> None:
        del self.x[bisect_left(self.x, v)]
        if self.low is not None:
            self._change(v, -1)

    def _lay(self, x: np.ndarray, k: int, low: float, high: float) -> bool:
        """A bracket, if it holds rank ``k`` and not too many differences."""
        a, b = _reach(x, low), _reach(x, high)
        place = np.arange(1, len(x) + 1)
        until, count = int((a - place).sum()), int((b - a).sum())
        if not until < k <= until + count or count > 4 * self.per * len(x) + 64:
            return False
        self.low, self.high, self.until, self.count, self.inner = low, high, until, count, SortedWindow()
        size = b - a
        d = x[np.arange(count) + np.repeat(a - np.cumsum(size) + size, size)] - np.repeat(x, size)
        d.sort()
        load = self.inner.load
        self.inner.blocks = [d[i : i + load].tolist() for i in range(0, count, load)]
        self.inner.tops, self.inner.size = [b[-1] for b in self.inner.blocks], count
        return True

    def _anew(self, k: int) -> None:
        x = np.array(self.x)
        half = self.per * len(x) / 2
        if self.low is not None and self.count and self.high > self.low:  # from the last one, by the density of its differences
            wide = (self.high - self.low) / self.count
            middle = self.low + (k - self.until) * wide
            if self._lay(x, k, max(middle - half * wide, -1.0), middle + half * wide):
                return
        pairs = len(x) * (len(x) - 1) // 2
        low = kth_difference(x, max(1, int(k - half)))
        if not self._lay(x, k, np.nextafter(low, -np.inf), kth_difference(x, min(pairs, int(k + half) + 1))):
            # very many equal differences: these alone, counted
            only = kth_difference(x, k)
            self.low, self.high, self.inner = float(np.nextafter(only, -np.inf)), only, None
            a, b = _reach(x, self.low), _reach(x, only)
            self.until, self.count = int((a - np.arange(1, len(x) + 1)).sum()), int((b - a).sum())

    def qn(self) -> float:
        n = len(self.x)
        if n < 16:
            self.low = None
            return qn(np.array(self.x))
        h = n // 2 + 1
        k = h * (h - 1) // 2
        if self.low is None or not self.until < k <= self.until + self.count:
            self._anew(k)
        d = self.high if self.inner is None else self.inner.at(k - self.until - 1)
        return _scaled(d, n)


def rolling_qn_of(t: np.ndarray, x: np.ndarray, half: int, rows: np.ndarray) -> list[float]:
    """Qn of the known values in (t - half, t + half] of each of ``rows``."""
    window, lo, hi, out = QnWindow(), 0, 0, []
    first, last = (np.searchsorted(t, t[rows] + e, side="right").tolist() for e in (-half, half))
    xs, known = x.tolist(), np.isfinite(x).tolist()
    if not np.isfinite(x[~np.isnan(x)]).all():  # infinite values have no differences
        return [qn(np.array(w.values())) for w in sliding(t, x, half, rows)]
    for a, b in zip(first, last):
        if a >= hi:  # nothing in common with the window before
            window, lo, hi = QnWindow(), a, a
        for i in range(hi, b):
            if known[i]:
                window.add(xs[i])
        for i in range(lo, a):
            if known[i]:
                window.remove(xs[i])
        lo, hi = a, b
        out.append(window.qn())
    return out


def window_sums(v: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Sums over the runs [first, last) as differences of running sums, in extended precision; ``v`` must be finite."""
    run = np.concatenate([[0], np.cumsum(v, dtype=np.longdouble)])
    return (run[last] - run[first]).astype(float)


def window_max(v: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Largest of the runs [first, last), by runs of powers of two; minus infinity of empty ones."""
    out = np.full(len(first), -np.inf)
    size, top, span = last - first, v.astype(float), 1
    while (live := size >= span).any():
        now = np.flatnonzero(live & (size < 2 * span))
        out[now] = np.maximum(top[first[now]], top[last[now] - span])
        top, span = np.maximum(top[:-span], top[span:]) if len(top) > span else top[:0], 2 * span
    return out


def members(first: np.ndarray, last: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Members of the runs [first, last), none of them empty, laid end to end, about ``most`` at a time: which runs (from, to), the
    members' places, each one's run, and where runs start."""
    size = last - first
    cuts = np.flatnonzero(np.diff(np.cumsum(size) // most, prepend=-1))
    for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(size)]):
        k = size[lo:hi]
        starts = np.cumsum(k) - k
        yield lo, hi, np.arange(k.sum()) + np.repeat(first[lo:hi] - starts, k), np.repeat(np.arange(hi - lo), k), starts


def rolling_order(df: DataFrame, keys: list[str], us: str, value: str, window_us: int, outputs: dict[str, str], fn: Callable[[SortedWindow, float], tuple], *, chunk_us: int = DAY) -> DataFrame:
    """``fn`` of each sample's centred window, and of its own value, gives the values of ``outputs`` (name: SQL type)."""

    def go(t: np.ndarray, cols: dict[str, np.ndarray], own: np.ndarray) -> dict:
        x = cols[value].astype(float)
        got = [fn(w, v) for w, v in zip(sliding(t, x, window_us // 2, own), x[own].tolist())]
        return dict(zip(outputs, zip(*got))) if got else {k: [] for k in outputs}

    return over_chunks(df, keys, us, window_us, outputs, go, chunk_us=chunk_us)
