"""Changes of clock: as late as can be, measured gases by averaging only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError
from .circular import circular_mean
from .ordered import DAY, last_known, over_chunks
from .propagate import random_of_mean, random_of_median, systematic_of_mean
from .windowed import SortedWindow, window_sums

BIN_STATISTICS = {"mean": lambda x: F.avg(x), "median": lambda x: F.percentile(x, F.lit(0.5)), "circular": circular_mean}


def _window_mean(x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    fine = np.isfinite(x)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = window_sums(np.where(fine, x, 0.0), first, last) / (last - first)
    for i in np.flatnonzero(window_sums(~fine, first, last)):
        out[i] = x[first[i] : last[i]].mean()
    return out


def _window_median(x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    order = SortedWindow()
    out, lo, hi, xs = np.full(len(first), np.nan), 0, 0, np.where(np.isnan(x), np.inf, x).tolist()
    for i, (a, b) in enumerate(zip(first.tolist(), last.tolist())):
        if a >= hi:
            order, lo, hi = SortedWindow(), a, a
        for j in range(hi, b):
            order.add(xs[j])
        for j in range(lo, a):
            order.remove(xs[j])
        lo, hi = a, b
        out[i] = order.quantile(0.5)
    return out


def _window_circular(x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    s, c = (_window_mean(f(np.radians(x)), first, last) for f in (np.sin, np.cos))
    return np.where(s * s + c * c > 1e-24, np.degrees(np.arctan2(s, c)) % 360.0, np.nan)


#: ``BIN_STATISTICS`` of the runs [first, last), neither of which falls.
WINDOW_STATISTICS = {"mean": _window_mean, "median": _window_median, "circular": _window_circular}


def interpolate(targets: DataFrame, source: DataFrame, keys: list[str], us: str, values: list[str], *, max_gap_us: int | None = None, clamp: bool = True, angles: tuple[str, ...] = (), chunk_us: int = DAY) -> DataFrame:
    """Targets with the source's ``values`` lerped onto their times.

    Outside the source's span the end value holds (``clamp``) or the result is null; with ``max_gap_us`` it is null where
    the source's samples about a target are further apart.  Source rows with a null among the values are passed over.
    ``angles`` are values in degrees: they turn along the shorter arc and come out in [0, 360).
    """
    known = source.where(" and ".join(f"`{v}` is not null" for v in values)).select(*keys, us, F.struct(F.col(us).alias("t"), *values).alias("_s"))
    known = known.groupBy(*keys, us).agg(F.min("_s").alias("_s")).withColumn("_kind", F.lit(0))
    rows = targets.withColumn("_s", F.lit(None).cast(known.schema["_s"].dataType)).withColumn("_kind", F.lit(1))
    both = rows.unionByName(known, allowMissingColumns=True)
    # a source row comes before targets of its time going up, and after them in the same order going down
    both = last_known(both, keys, us, F.col("_s"), "_a", tie=["_kind"], chunk_us=chunk_us)
    both = both.withColumn("_last", 1 - F.col("_kind"))
    both = last_known(both, keys, us, F.col("_s"), "_b", tie=["_last"], chunk_us=chunk_us, down=True)
    at = both.where("_kind = 1")
    a, b, t = F.col("_a"), F.col("_b"), F.col(us)
    gap = b["t"] - a["t"]

    def lerp(v: str) -> Column:
        step = F.pmod(b[v] - a[v] + 180.0, F.lit(360.0)) - 180.0 if v in angles else b[v] - a[v]
        inner = F.when(gap == 0, a[v]).otherwise(a[v] + step * ((t - a["t"]) / F.nullif(gap, F.lit(0))))
        if max_gap_us is not None:
            inner = F.when(gap <= max_gap_us, inner)
        edge = F.coalesce(a[v], b[v]) if clamp else F.lit(None).cast("double")
        out = F.when(a.isNull() | b.isNull(), edge).otherwise(inner)
        return F.pmod(out, F.lit(360.0)) if v in angles else out

    return at.select(*[c for c in targets.columns if c not in values], *(lerp(v).alias(v) for v in values))


def pair(fast: DataFrame, slow: DataFrame, keys: list[str], us: str, fast_value: str, slow_value: str, period_us: int, *, statistic: str = "mean") -> DataFrame:
    """Slow samples with the fast ones in [t - period/2, t + period/2) binned: x (fast), n_native, y (slow).

    Unknown values take no part, and slow samples with no fast one are dropped: no pair is made up.
    """
    half = period_us // 2
    cells = slow.where(F.col(slow_value).isNotNull()).groupBy(*keys, F.col(us).alias("t"), F.col(slow_value).alias("y")).agg(F.count("*").alias("_k"))
    pts = fast.where(F.col(fast_value).isNotNull()).select(*keys, F.col(us).alias("t"), F.col(fast_value).cast("double").alias("_x"))
    of = WINDOW_STATISTICS[statistic]

    def go(t: np.ndarray, c: dict[str, np.ndarray], own: np.ndarray) -> dict:
        known = np.flatnonzero(np.isnan(c["_k"].astype(float)))  # a slow sample has a number of copies, a fast one has none
        x, at = c["_x"].astype(float)[known], t[known]
        first, last = np.searchsorted(at, t[own] - half), np.searchsorted(at, t[own] - half + period_us)
        return {"x": of(x, first, last), "_n": last - first}

    # slow samples and fast ones by time: a window moves over these, and pairs of both are never rows
    both = cells.withColumn("_x", F.lit(None).cast("double")).unionByName(pts, allowMissingColumns=True)
    met = over_chunks(both, keys, "t", 2 * period_us + 2, {"x": "double", "_n": "bigint"}, go, only=F.col("_k").isNotNull(), chunk_us=max(DAY, 2 * period_us))
    return met.where("_n > 0").select(*keys, F.col("t").alias(us), "x", "y", (F.col("_n") * F.col("_k")).alias("n_native"))


def check_grid(step_us: int, periods_us: dict[str, int]) -> None:
    """Refuses a grid finer than the slowest stream (measured periods may jitter by a hundredth)."""
    slow = [k for k, p in sorted(periods_us.items()) if step_us < p * 0.99]
    if slow:
        raise ConfigError(f"a grid of {step_us} us is finer than the sampling of {slow}")


def output_grid(df: DataFrame, keys: list[str], us: str, value: str, step_us: int, start_us: int, end_us: int, *, statistic: str = "mean", sigma_rand: str | None = None, sigma_sys: str | None = None) -> DataFrame:
    """Every cell of [start, end) for every key: cell_us, value (null where no sample is), n_native.

    With names of sigma columns also each cell's propagated sigma under these names; it is null where a sample's is unknown.
    Statistic ``circular`` averages degrees as vectors; no sigma is propagated through it.
    """
    cell = (F.floor((F.col(us) - start_us) / F.lit(step_us)) * step_us + start_us).alias("cell_us")
    of = {sigma_rand: random_of_median if statistic == "median" else random_of_mean, sigma_sys: systematic_of_mean}
    of = {c: f for c, f in of.items() if c and statistic != "circular"}
    own = {c: F.when(F.col(value).isNotNull(), F.col(c)) for c in of}
    sigmas = [F.when(F.count(own[c]) == F.count(value), f(own[c])).alias(c) for c, f in of.items()]
    inside = df.where((F.col(us) >= start_us) & (F.col(us) < end_us)).select(*keys, cell, value, *of)
    binned = inside.groupBy(*keys, "cell_us").agg(BIN_STATISTICS[statistic](F.col(value)).alias("_v"), F.count(value).alias("n_native"), *sigmas).withColumnRenamed("_v", value)
    n = -(-(end_us - start_us) // step_us)
    cells = df.sparkSession.range(n).select((F.col("id") * step_us + start_us).alias("cell_us"))
    names = df.select(*keys).distinct()  # streams, a handful
    grid = names.join(cells)
    return grid.join(binned, [*keys, "cell_us"], "left").withColumn("n_native", F.coalesce("n_native", F.lit(0)))


def pmf_matrix(grid: DataFrame, stream: str, value: str, species: list[str], extra: dict[str, Column] | None = None) -> DataFrame:
    """A row a cell, a column a species, and its n_native (and what ``extra`` names)."""
    return grid.groupBy("cell_us").pivot(stream, species).agg(F.first(value).alias("value"), F.first("n_native").alias("n_native"), *(c.alias(k) for k, c in (extra or {}).items()))
