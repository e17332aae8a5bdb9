"""Rolling low-quantile baselines and their uncertainty."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import DAY, over_chunks, rolling
from .windowed import SortedWindow, rolling_order, window_sums


def baseline_sweep(df: DataFrame, keys: list[str], us: str, value: str, windows_us: list[int], quantiles: list[float], *, min_valid_fraction: float = 0.0, min_valid: int = 2, sigma: str | None = None, chunk_us: int = DAY) -> DataFrame:
    """One row a sample, window and quantile: window_us, quantile, baseline, enhancement, n_valid.

    ``sigma``, a method of ``baseline_sigma``, adds that column.  The baseline is null where fewer than ``min_valid`` values, or than ``min_valid_fraction`` of the window's rows, masked
    ones included, are known.  A window's quantiles share one pass; windows are passes of their own.
    """
    out = None
    for w in windows_us:
        names = [f"_q{i}" for i in range(len(quantiles))]

        def go(s, roller, names=names) -> dict:
            n = roller.count()
            rows = s.fillna(0.0).rolling(roller.window, center=True, min_periods=1).count()
            ok = (n >= min_valid) & (n >= min_valid_fraction * rows)
            return {"n_valid": n.astype("int64").to_numpy()} | {k: roller.quantile(q).where(ok).to_numpy() for k, q in zip(names, quantiles)}

        one = rolling(df, keys, us, value, w, {"n_valid": "bigint"} | dict.fromkeys(names, "double"), go, chunk_us=max(chunk_us, w))
        sigmas = {k: f"_s{i}" for i, k in enumerate(names)} if sigma else {}
        if sigma == "order":  # all quantiles of a window in one pass
            one = rolling_order(one, keys, us, value, w, dict.fromkeys(sigmas.values(), "double"), lambda win, _, qs=tuple(quantiles): tuple(order_sigma(win, q) for q in qs), chunk_us=max(chunk_us, w))
        elif sigma:
            for q, k in zip(quantiles, names):
                one = baseline_sigma(one, keys, us, value, w, q, method=sigma, name=sigmas[k], chunk_us=chunk_us)
        known = lambda c: F.nanvl(F.col(c), F.lit(None))
        each = F.array(*(F.struct(F.lit(float(q)).alias("quantile"), known(k).alias("baseline"), *([known(sigmas[k]).alias("baseline_sigma")] if sigma else [])) for q, k in zip(quantiles, names)))
        one = one.withColumn("_e", F.explode(each)).withColumn("window_us", F.lit(w).cast("long")).select(*df.columns, "window_us", "_e.*", "n_valid")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("enhancement", F.col(value) - F.col("baseline"))


def order_sigma(window: SortedWindow, q: float, efficiency: float = 1.0) -> float:
    """Half the interval between the order statistics one binomial deviation below and above rank ``q``; NaN of fewer than two values.

    ``efficiency`` is the number of independent samples that one sample counts for, under 1 in correlated noise.
    """
    n = len(window)
    if n < 2:
        return np.nan
    d = (q * (1 - q) / (n * efficiency)) ** 0.5
    return (window.quantile(q + d) - window.quantile(q - d)) / 2


def _poisson(u: Column) -> Column:
    """Draws of a Poisson law of mean 1 from uniform numbers: the steps of its distribution function."""
    steps, p, total = [], math.exp(-1), 0.0
    for k in range(1, 9):
        total += p
        steps.append(total)
        p /= k
    return sum((F.when(u >= s, 1).otherwise(0) for s in steps), F.lit(0))


def block_weights(us: Column, block_us: int, replicates: int, seed: int) -> Column:
    """How often each replicate of a moving-block bootstrap draws the block that a time lies in: a whole number by hash of seed,
    replicate and block.  A replicate's blocks begin at an offset of its own."""

    def uniform(*parts) -> Column:
        return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, 8), 16, 10).cast("double") / 4294967296.0

    def one(r: int) -> Column:
        shift = F.floor(uniform(F.lit(f"offset{r}")) * block_us)
        return _poisson(uniform(F.lit(str(r)), F.floor((us + shift) / F.lit(block_us)).cast("string")))

    return F.array(*(one(r) for r in range(replicates)))


def baseline_sigma(df: DataFrame, keys: list[str], us: str, value: str, window_us: int, quantile: float, *, method: str = "order", efficiency: float = 1.0, block_us: int = 3_600_000_000, replicates: int = 20, seed: int = 0, name: str = "baseline_sigma", chunk_us: int = DAY) -> DataFrame:
    """``name``: the standard uncertainty of the rolling quantile at every sample.

    ``order``: half the interval of the order statistics a binomial deviation either side of the quantile.  ``bootstrap``: sample
    deviation of the quantile over replicates of a moving-block bootstrap, whose blocks of ``block_us`` keep the noise's
    correlation; all windows share a replicate's draws, which are weights of whole numbers.  Null in windows with fewer than
    two known values, or fewer than two replicates that draw any.
    """
    wide = max(chunk_us, window_us)
    if method == "order":
        out = rolling_order(df, keys, us, value, window_us, {name: "double"}, lambda w, _: (order_sigma(w, quantile, efficiency),), chunk_us=wide)
    elif method == "bootstrap":

        def go(t: np.ndarray, c: dict[str, np.ndarray], own: np.ndarray) -> dict:
            x, weights = c[value].astype(float), np.stack(c["_w"])
            first, last = (np.searchsorted(t, t[own] + e, side="right") for e in (-(window_us // 2), window_us // 2))
            enough = window_sums(~np.isnan(x), first, last) >= 2
            q = np.array([drawn_quantile(t, x, weights[:, r])[own] for r in range(replicates)])
            some = (~np.isnan(q)).sum(axis=0)
            mean = np.nansum(q, axis=0) / np.maximum(some, 1)
            var = np.nansum((q - mean) ** 2, axis=0) / np.maximum(some - 1, 1)
            return {name: np.where(enough & (some >= 2), np.sqrt(var), np.nan)}

        def drawn_quantile(t: np.ndarray, x: np.ndarray, times: np.ndarray) -> np.ndarray:
            """Of every sample's window in which values are so many times as they are drawn: each sample has an unknown value, for
            its window, and its own value ``times``."""
            size = times + 1
            mark = np.cumsum(size) - size
            v = np.repeat(x, size)
            v[mark] = np.nan
            s = pd.Series(v, index=pd.to_datetime(np.repeat(t, size), unit="us"))
            return s.rolling(pd.Timedelta(window_us, "us"), center=True, min_periods=1).quantile(quantile).to_numpy()[mark]

        drawn = df.withColumn("_w", block_weights(F.col(us), block_us, replicates, seed))
        out = over_chunks(drawn, keys, us, window_us, {name: "double"}, go, chunk_us=wide).drop("_w")
    else:
        raise ValueError(f"no such method: {method}")
    return out.withColumn(name, F.nanvl(F.col(name), F.lit(None)))
