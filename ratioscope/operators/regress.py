"""Straight lines through pairs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from .ordered import over_chunks
from .windowed import window_max, window_sums


def ols(df: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """slope, intercept, r2, sigma_slope, n of each key; a vertical or single-point group has no slope."""
    c, s = F.col(x), F.col(y)
    both = df.where(c.isNotNull() & s.isNotNull())
    out = both.groupBy(*keys).agg(F.regr_slope(s, c).alias("slope"), F.regr_intercept(s, c).alias("intercept"), F.regr_r2(s, c).alias("r2"), F.count("*").alias("n"), F.regr_sxx(s, c).alias("_sxx"), F.regr_syy(s, c).alias("_syy"), F.regr_sxy(s, c).alias("_sxy"))
    rest = F.greatest(F.lit(0.0), F.col("_syy") - F.col("slope") * F.col("_sxy"))
    return out.withColumn("sigma_slope", F.when((F.col("n") > 2) & (F.col("_sxx") > 0), F.sqrt(rest / (F.col("n") - 2) / F.col("_sxx")))).drop("_sxx", "_syy", "_sxy")


@dataclass
class Line:
    slope: float = np.nan
    intercept: float = np.nan
    sigma_slope: float = np.nan
    sigma_intercept: float = np.nan
    s: float = np.nan
    n: int = 0
    rounds: int = 0


def york_line(x: np.ndarray, y: np.ndarray, sx: np.ndarray, sy: np.ndarray, r: np.ndarray | float = 0.0, rounds: int = 100, tol: float = 1e-14) -> Line:
    """York's errors-in-both fit of one group; no slope with fewer than two distinct x."""
    n = len(x)
    if n < 2 or np.ptp(x) == 0:
        return Line(n=n)
    wx, wy = 1 / sx**2, 1 / sy**2
    alpha = np.sqrt(wx * wy)
    b = np.polyfit(x - x.mean(), y, 1)[0]
    for k in range(1, rounds + 1):
        w = wx * wy / (wx + b * b * wy - 2 * b * r * alpha)
        xm, ym = w @ x / w.sum(), w @ y / w.sum()
        u, v = x - xm, y - ym
        beta = w * (u / wy + b * v / wx - (b * u + v) * r / alpha)
        last, b = b, (w * beta) @ v / ((w * beta) @ u)
        if not np.isfinite(b) or abs(b - last) <= tol * max(1.0, abs(b)):
            break
    a = ym - b * xm
    adj = xm + beta
    xb = w @ adj / w.sum()
    sb = 1 / np.sqrt(w @ (adj - xb) ** 2)
    return Line(b, a, sb, np.sqrt(1 / w.sum() + (xb * sb) ** 2), float(w @ (y - b * x - a) ** 2), n, k)


def odr_line(x: np.ndarray, y: np.ndarray, sx: np.ndarray, sy: np.ndarray, r: np.ndarray | float = 0.0, rounds: int = 200) -> Line:
    """Orthogonal distance regression by Gauss and Newton over line and true x together; it takes no correlation."""
    n = len(x)
    if n < 2 or np.ptp(x) == 0:
        return Line(n=n)
    b, a = np.polyfit(x, y, 1)
    wx, wy = 1 / sx**2, 1 / sy**2
    for k in range(1, rounds + 1):
        t = (wx * x + wy * b * (y - a)) / (wx + wy * b * b)  # the best true x of the line at hand
        res = y - a - b * x
        v = 1 / (1 / wy + b * b / wx)
        # normal equations of the profiled residual
        g = np.array([v @ res, (v * res) @ t])
        h = np.array([[v.sum(), v @ t], [v @ t, v @ (t * t)]])
        step = np.linalg.solve(h, g)
        a, b = a + step[0], b + step[1]
        if np.all(np.abs(step) <= 1e-14 * np.maximum(1, np.abs([a, b]))):
            break
    v = 1 / (1 / wy + b * b / wx)
    t = (wx * x + wy * b * (y - a)) / (wx + wy * b * b)
    tb = v @ t / v.sum()
    sb = 1 / np.sqrt(v @ (t - tb) ** 2)
    return Line(b, a, sb, np.sqrt(1 / v.sum() + (tb * sb) ** 2), float(v @ (y - a - b * x) ** 2), n, k)


_FIT = "slope double, intercept double, sigma_slope double, sigma_intercept double, s double, n bigint"


def fit_events(df: DataFrame, keys: list[str], line: Callable[..., Line], x: str = "x", y: str = "y", sx: str = "sx", sy: str = "sy", r: str | None = None) -> DataFrame:
    """A line a group, each in one task: for events, whose pairs are few.  For groups without a bound see ``york``."""
    cols = [x, y, sx, sy, *([r] if r else [])]
    data = df.where(" and ".join(f"`{c}` is not null" for c in cols)).select(*keys, *(F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(cols)))

    def go(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        f = line(*(pdf[f"_c{i}"].to_numpy() for i in range(len(cols))))
        return pd.DataFrame([[*key, f.slope, f.intercept, f.sigma_slope, f.sigma_intercept, f.s, f.n]])

    types = ", ".join(f"`{k}` {t}" for k, t in data.select(*keys).dtypes)
    return data.groupBy(*keys).applyInPandas(go, f"{types}, {_FIT}")


def york(df: DataFrame, keys: list[str], x: str = "x", y: str = "y", sx: str = "sx", sy: str = "sy", r: str | None = None, *, rounds: int = 12, tol: float = 1e-12, scratch: Scratch | None = None) -> DataFrame:
    """York's fit of groups of any size: every round is one aggregation over all pairs.

    Slopes start from least squares.  Rounds stop when no group's slope moves by more than ``tol`` of itself.  At a slope, the mean
    and the next slope are made of sums of 1, x, y, xx, xy, yy under four weights; pairs are centred first, so that these keep
    their digits.
    """
    scratch = scratch or Scratch(df.sparkSession, "york")
    need = [x, y, sx, sy, *([r] if r else [])]
    rows = df.where(" and ".join(f"`{c}` is not null" for c in need)).select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), (1 / F.pow(sx, 2)).alias("wx"), (1 / F.pow(sy, 2)).alias("wy"), (F.col(r).cast("double") if r else F.lit(0.0)).alias("r"))
    first = scratch.write(rows.groupBy(*keys).agg(F.regr_slope("y", "x").alias("b"), F.avg("x").alias("x0"), F.avg("y").alias("y0")).where("b is not null"), "starts")
    c = F.col
    rows = rows.join(first.drop("b"), keys).withColumn("x", c("x") - c("x0")).withColumn("y", c("y") - c("y0")).drop("x0", "y0")
    rows, fit = scratch.write(rows, "pairs"), first.select(*keys, "b")
    alpha = F.sqrt(c("wx") * c("wy"))
    w = c("wx") * c("wy") / (c("wx") + c("b") * c("b") * c("wy") - 2 * c("b") * c("r") * alpha)
    weights = {"w": c("w"), "p": c("w") * c("w") / c("wy"), "q": c("w") * c("w") / c("wx"), "o": c("w") * c("w") * c("r") / alpha}
    powers = {"": F.lit(1.0), "x": c("x"), "y": c("y"), "xx": c("x") * c("x"), "xy": c("x") * c("y"), "yy": c("y") * c("y")}
    sums = [F.sum(v * m).alias(f"_{k}{n}") for k, v in weights.items() for n, m in powers.items()]
    xm, ym = c("_wx") / c("_w"), c("_wy") / c("_w")

    def about(k: str, a: str, b: str) -> Column:
        """Sum of (a - its mean) (b - its mean) under weight ``k``."""
        mean = {"x": xm, "y": ym}
        return c(f"_{k}{a}{b}") - mean[a] * c(f"_{k}{b}") - mean[b] * c(f"_{k}{a}") + mean[a] * mean[b] * c(f"_{k}")

    up = about("p", "x", "y") + c("b") * about("q", "y", "y") - c("b") * about("o", "x", "y") - about("o", "y", "y")
    down = about("p", "x", "x") + c("b") * about("q", "x", "y") - c("b") * about("o", "x", "x") - about("o", "x", "y")
    for k in range(rounds):
        got = rows.join(fit.select(*keys, "b"), keys).withColumn("w", w).groupBy(*keys).agg(F.first("b").alias("b"), *sums)
        fit = scratch.write(got.select(*keys, (up / down).alias("b"), c("b").alias("last")), f"slopes{k}")
        if not fit.where(F.abs(c("b") - c("last")) > tol * F.greatest(F.lit(1.0), F.abs("b"))).head(1):
            break
    weighed = rows.join(fit.select(*keys, "b"), keys).withColumn("w", w)
    mean = weighed.groupBy(*keys).agg((F.sum(c("w") * c("x")) / F.sum("w")).alias("xm"), (F.sum(c("w") * c("y")) / F.sum("w")).alias("ym"))
    u, v = c("x") - c("xm"), c("y") - c("ym")
    # beta is how far adjusted points lie from xm: the spread of these is taken about their own mean
    end = weighed.join(mean, keys).withColumn("a", c("ym") - c("b") * c("xm")).withColumn("d", c("w") * (u / c("wy") + c("b") * v / c("wx") - (c("b") * u + v) * c("r") / alpha))
    out = end.groupBy(*keys).agg(F.first("b").alias("slope"), F.first("a").alias("_a"), F.sum("w").alias("sw"), F.sum(c("w") * c("d")).alias("wd"), F.sum(c("w") * c("d") * c("d")).alias("wdd"), F.first("xm").alias("xm"), F.sum(c("w") * F.pow(c("y") - c("b") * c("x") - c("a"), 2)).alias("s"), F.count("*").alias("n"))
    sb = F.sqrt(1 / (c("wdd") - c("wd") * c("wd") / c("sw")))
    out = out.join(first.select(*keys, "x0", "y0"), keys).withColumn("intercept", c("_a") + c("y0") - c("slope") * c("x0"))
    return out.select(*keys, "slope", "intercept", sb.alias("sigma_slope"), F.sqrt(1 / c("sw") + F.pow((c("xm") + c("x0") + c("wd") / c("sw")) * sb, 2)).alias("sigma_intercept"), "s", "n")


def ratios(fit: DataFrame, *, min_points: int = 8, confidence: float = 0.95, scale_x: float = 0.0, scale_y: float = 0.0) -> DataFrame:
    """Fits as ratios: sigma_sys from relative scale errors of the axes, total sigma, Gaussian bounds, goodness s / (n - 2).

    Groups under ``min_points`` keep their row, flagged, with a null ratio.
    """
    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    enough = F.col("n") >= min_points
    out = fit.withColumn("enough", enough).withColumn("ratio", F.when(enough, F.col("slope"))).withColumn("sigma_fit", F.when(enough, F.col("sigma_slope")))
    out = out.withColumn("sigma_sys", F.abs("ratio") * F.lit((scale_x**2 + scale_y**2) ** 0.5)).withColumn("sigma", F.sqrt(F.pow("sigma_fit", 2) + F.pow("sigma_sys", 2)))
    if "s" in fit.columns:
        out = out.withColumn("goodness", F.when(F.col("n") > 2, F.col("s") / (F.col("n") - 2)))
    return out.withColumn("low", F.col("ratio") - z * F.col("sigma")).withColumn("high", F.col("ratio") + z * F.col("sigma"))


def birge(fits: DataFrame, keys: list[str], slope: str = "slope", sigma: str = "sigma_slope") -> DataFrame:
    """birge, mean, n_fits of the fits of each key; null for fewer than two."""
    w = 1 / F.pow(sigma, 2)
    ok = fits.where(F.col(slope).isNotNull() & (F.col(sigma) > 0))
    m = ok.groupBy(*keys).agg((F.sum(w * F.col(slope)) / F.sum(w)).alias("mean"))
    return ok.join(m, keys).groupBy(*keys).agg(F.first("mean").alias("mean"), F.count("*").alias("n_fits"), F.sum(w * F.pow(F.col(slope) - F.col("mean"), 2)).alias("_q")).select(*keys, F.sqrt(F.col("_q") / F.nullif(F.col("n_fits") - 1, F.lit(0))).alias("birge"), "mean", "n_fits")


def method_sigma(cells: DataFrame, keys: list[str], ratio: str = "ratio") -> DataFrame:
    """Spread of a ratio over the sweep's cells: sample standard deviation (our choice)."""
    return cells.groupBy(*keys).agg(F.stddev_samp(ratio).alias("sigma_method"), F.count(ratio).alias("n_cells"))


def total_sigma(fit: Column, sys: Column, method: Column) -> Column:
    zero = F.lit(0.0)
    return F.sqrt(F.pow(fit, 2) + F.pow(F.coalesce(sys, zero), 2) + F.pow(F.coalesce(method, zero), 2))


def closing_cells(cells: DataFrame, keys: list[str], ties: tuple[str, ...] = ()) -> DataFrame:
    """Sweep cells ranked by how near their Birge ratio is to 1 (candidate rule for primary cells), equals by ``ties``.

    A cell is a row: without keys one task ranks as many rows as the sweep has combinations.
    """
    order = [F.abs(F.col("birge") - 1), *(F.col(t) for t in ties)]
    rank = Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order)
    return cells.where("birge is not null").withColumn("closure_rank", F.row_number().over(rank))


def rolling_ols(df: DataFrame, keys: list[str], us: str, x: str, y: str, window_us: int, *, chunk_us: int = 86_400_000_000) -> DataFrame:
    """Least squares over a centred window at every pair: slope, n."""

    def go(t: np.ndarray, c: dict[str, np.ndarray], own: np.ndarray) -> dict:
        u, v = c[x].astype(float), c[y].astype(float)
        first, last = (np.searchsorted(t, t[own] + e, side="right") for e in (-(window_us // 2), window_us // 2))
        n = last - first
        good = np.isfinite(u) & np.isfinite(v)
        u, v = (np.where(good, w - (w[good].mean() if good.any() else 0.0), 0.0) for w in (u, v))  # centred, so that sums keep their digits
        sx, sy, sxx, sxy = (window_sums(w, first, last) for w in (u, v, u * u, u * v))
        several = window_max(u, first, last) > -window_max(-u, first, last)
        whole = window_sums(~good, first, last) == 0
        with np.errstate(divide="ignore", invalid="ignore"):
            slope = (sxy - sx * sy / n) / (sxx - sx * sx / n)
        return {"slope": np.where(several & whole, slope, np.nan), "n": n}

    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return over_chunks(both, keys, us, window_us, {"slope": "double", "n": "bigint"}, go, chunk_us=max(chunk_us, window_us))


def york_windows(x: np.ndarray, y: np.ndarray, sx: np.ndarray, sy: np.ndarray, r: np.ndarray, first: np.ndarray, last: np.ndarray, *, rounds: int = 100, tol: float = 1e-14, pairs: int = 1 << 20) -> np.ndarray:
    """York's fits of the runs [first, last) of pairs: slope, intercept, sigma_slope, sigma_intercept, s, n by row.

    All windows are iterated together, those that have settled drop out; a round's sums are taken over the windows' members laid end
    to end, ``pairs`` of them at a time (or one window).
    """
    out = np.full((len(first), 6), np.nan)
    out[:, 5] = last - first
    wx, wy = 1 / sx**2, 1 / sy**2
    alpha = np.sqrt(wx * wy)
    slabs = np.flatnonzero(np.diff(np.cumsum(last - first) // pairs, prepend=-1))
    for lo, hi in zip(slabs, [*slabs[1:], len(first)]):
        live = lo + np.flatnonzero(last[lo:hi] - first[lo:hi] >= 2)
        b = None
        for k in range(rounds + 1):
            if not len(live):
                break
            size = last[live] - first[live]
            starts = np.cumsum(size) - size
            at = np.arange(size.sum()) + np.repeat(first[live] - starts, size)
            of = np.repeat(np.arange(len(live)), size)
            total = lambda v: np.add.reduceat(v, starts)  # noqa: B023, E731
            px, py = x[at], y[at]
            if b is None:  # least squares to start from; windows with a single x have no slope
                u = px - (total(px) / size)[of]
                sxx = total(u * u)
                spread = np.maximum.reduceat(px, starts) > np.minimum.reduceat(px, starts)
                b = (total(u * py) / np.where(spread, sxx, 1.0))[spread]
                live = live[spread]
                continue
            c = b[of]
            w = wx[at] * wy[at] / (wx[at] + c * c * wy[at] - 2 * c * r[at] * alpha[at])
            sw = total(w)
            xm, ym = total(w * px) / sw, total(w * py) / sw
            u, v = px - xm[of], py - ym[of]
            beta = w * (u / wy[at] + c * v / wx[at] - (c * u + v) * r[at] / alpha[at])
            with np.errstate(divide="ignore", invalid="ignore"):
                new = total(w * beta * v) / total(w * beta * u)
            settled = ~np.isfinite(new) | (np.abs(new - b) <= tol * np.maximum(1.0, np.abs(new))) | (k == rounds)
            a = ym - new * xm
            adj = xm[of] + beta
            xb = total(w * adj) / sw
            sb = 1 / np.sqrt(total(w * (adj - xb[of]) ** 2))
            rest = total(w * (py - new[of] * px - a[of]) ** 2)
            out[live[settled], :5] = np.stack([new, a, sb, np.sqrt(1 / sw + (xb * sb) ** 2), rest], axis=1)[settled]
            live, b = live[~settled], new[~settled]
    return out


#: Windows of fewer pairs are fitted pair by pair; larger ones are this many at a time.
DENSE, SLAB = 512, 20_000


def york_dense(x: np.ndarray, y: np.ndarray, sx: np.ndarray, sy: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """``york_windows`` of uncorrelated errors at a cost that doesn't grow with the windows' sizes.

    A round needs sums over a window that are smooth functions of its slope.  They are taken, as differences of running sums, at
    Chebyshev nodes of the span of the windows' slopes, so many that what lies between is right to a double's digits.
    """
    ok = np.isfinite(x).all() and np.isfinite(y).all() and np.isfinite(sx).all() and np.isfinite(sy).all() and (sx > 0).all() and (sy > 0).all()
    dense = (last - first >= DENSE) & ok
    out = np.full((len(first), 6), np.nan)
    out[~dense] = york_windows(x, y, sx, sy, np.zeros(len(x)), first[~dense], last[~dense])
    at = np.flatnonzero(dense)
    for i in range(0, len(at), SLAB):
        rows = at[i : i + SLAB]
        lo, hi = first[rows].min(), last[rows].max()
        out[rows] = _york_slab(x[lo:hi], y[lo:hi], sx[lo:hi], sy[lo:hi], first[rows] - lo, last[rows] - lo)
    return out


def _york_slab(x: np.ndarray, y: np.ndarray, sx: np.ndarray, sy: np.ndarray, first: np.ndarray, last: np.ndarray, *, rounds: int = 100, tol: float = 1e-13) -> np.ndarray:
    out = np.full((len(first), 6), np.nan)
    n = out[:, 5] = last - first
    x0, y0 = x.mean(), y.mean()
    x, y, vx, vy = x - x0, y - y0, sx * sx, sy * sy
    powers = {"": np.ones(len(x)), "x": x, "y": y, "xx": x * x, "xy": x * y, "yy": y * y}
    # the weight and what it is multiplied by: of a round, and of the errors at the end
    steps = [("w", k) for k in ("", "x", "y")] + [("p", k) for k in ("", "x", "y", "xx", "xy")] + [("q", k) for k in ("", "x", "y", "xy", "yy")]
    ends = [*steps, *(("w", k) for k in ("xx", "xy", "yy")), *(("pp", k) for k in ("", "x", "xx")), *(("pq", k) for k in ("", "x", "y", "xy")), *(("qq", k) for k in ("", "y", "yy"))]

    def sums(b: float, which: list, rows: np.ndarray) -> np.ndarray:
        w = 1 / (vy + b * b * vx)
        weight = {"w": w, "p": w * w * vy, "q": w * w * vx, "pp": w**3 * vy * vy, "pq": w**3 * vx * vy, "qq": w**3 * vx * vx}
        return np.stack([window_sums(weight[k] * powers[m], first[rows], last[rows]) for k, m in which])

    def about(s: dict, k: str, a: str, b: str) -> np.ndarray:
        return s[k, a + b] - s["m", a] * s[k, b] - s["m", b] * s[k, a] + s["m", a] * s["m", b] * s[k, ""]

    def named(got: np.ndarray, which: list) -> dict:
        s = dict(zip(which, got))
        return s | {("m", "x"): s["w", "x"] / s["w", ""], ("m", "y"): s["w", "y"] / s["w", ""]}

    fx, fy, fxx, fxy = (window_sums(powers[k], first, last) for k in ("x", "y", "xx", "xy"))
    spread = window_max(x, first, last) > -window_max(-x, first, last)
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = np.where(spread, (fxy - fx * fy / n) / (fxx - fx * fx / n), np.nan)
    far = float(np.sqrt((vy / vx).min()))  # how far from real slopes the weights have their poles
    todo, left = [np.flatnonzero(np.isfinite(slope))], np.full(len(first), rounds)
    while todo:
        rows = todo.pop()
        if not len(rows):
            continue
        lo, hi = slope[rows].min(), slope[rows].max()
        if hi - lo > far and len(rows) > 1:  # halves need fewer nodes
            low = slope[rows] <= (lo + hi) / 2
            todo += [rows[low], rows[~low]]
            continue
        half = (hi - lo) / 2 * 1.25 + 0.1 * far
        middle = (lo + hi) / 2
        m = int(np.ceil(38 / np.log((far + np.hypot(far, half)) / half))) + 4
        u = np.cos(np.pi * (np.arange(m) + 0.5) / m)
        inner = np.cos(np.outer(np.arange(m), np.arccos(u))) * (2 / m)
        inner[0] /= 2

        def share(b: np.ndarray) -> np.ndarray:  # of each node in the value at a slope, nodes by slopes
            return (np.cos(np.outer(np.arccos(np.clip((b - middle) / half, -1, 1)), np.arange(m))) @ inner).T  # noqa: B023

        nodes = np.stack([sums(middle + half * v, steps, rows) for v in u])
        b, live, away = slope[rows].copy(), np.arange(len(rows)), []
        while len(live):
            s = named(np.einsum("mr,mkr->kr", share(b[live]), nodes[:, :, live]), steps)
            c = b[live]
            with np.errstate(divide="ignore", invalid="ignore"):
                new = (about(s, "p", "x", "y") + c * about(s, "q", "y", "y")) / (about(s, "p", "x", "x") + c * about(s, "q", "x", "y"))
            left[rows[live]] -= 1
            none = ~np.isfinite(new)
            still = ~none & (np.abs(new - c) > tol * np.maximum(1.0, np.abs(new))) & (left[rows[live]] > 0)
            gone = still & (np.abs(new - middle) > half)
            b[live] = new
            away.append(live[gone])
            live = live[still & ~gone]
        slope[rows] = b
        away = np.concatenate(away)
        todo.append(rows[away])  # with nodes of their own
        done = np.setdiff1d(np.arange(len(rows)), away)
        done = done[np.isfinite(b[done]) & (np.abs(b[done] - middle) <= half)]
        ending, part = np.zeros((len(ends), len(done))), share(b[done])
        for v, k in zip(u, part):
            ending += sums(middle + half * v, ends, rows[done]) * k
        s, c = named(ending, ends), b[done]
        sw, xm, ym = s["w", ""], s["m", "x"], s["m", "y"]
        a = ym - c * xm
        # beta = w (u vy + b v vx), with u and v about the means
        wb = s["p", "x"] - xm * s["p", ""] + c * (s["q", "y"] - ym * s["q", ""])
        du = s["pp", "xx"] - 2 * xm * s["pp", "x"] + xm * xm * s["pp", ""]
        duv = s["pq", "xy"] - xm * s["pq", "y"] - ym * s["pq", "x"] + xm * ym * s["pq", ""]
        dv = s["qq", "yy"] - 2 * ym * s["qq", "y"] + ym * ym * s["qq", ""]
        wbb = du + 2 * c * duv + c * c * dv
        rest = about(s, "w", "y", "y") - 2 * c * about(s, "w", "x", "y") + c * c * about(s, "w", "x", "x")
        with np.errstate(divide="ignore", invalid="ignore"):
            sb = 1 / np.sqrt(wbb - wb * wb / sw)
            out[rows[done], :5] = np.stack([c, a + y0 - c * x0, sb, np.sqrt(1 / sw + ((xm + x0 + wb / sw) * sb) ** 2), rest], axis=1)
    return out


def rolling_york(df: DataFrame, keys: list[str], us: str, window_us: int, x: str = "x", y: str = "y", sx: str = "sx", sy: str = "sy", r: str | None = None, *, chunk_us: int = 86_400_000_000) -> DataFrame:
    """York's fit over a centred window at every pair whose values and sigmas are all known; null with fewer than two distinct x."""
    cols = [x, y, sx, sy, *([r] if r else [])]
    names = ["slope", "intercept", "sigma_slope", "sigma_intercept", "s"]
    half = window_us // 2

    def go(t: np.ndarray, c: dict[str, np.ndarray], own: np.ndarray) -> dict:
        v = [c[k].astype(float) for k in cols]
        first, last = (np.searchsorted(t, t[own] + e, side="right") for e in (-half, half))
        fit = york_windows(*v[:4], v[4], first, last) if r else york_dense(*v, first, last)
        return dict(zip(names, fit.T)) | {"n": (last - first)}

    both = df.where(" and ".join(f"`{c}` is not null" for c in cols))
    out = over_chunks(both, keys, us, window_us, dict.fromkeys(names, "double") | {"n": "bigint"}, go, chunk_us=max(chunk_us, window_us))
    return out.withColumns({k: F.nanvl(F.col(k), F.lit(None)) for k in names})


#: Fits by name for groups of bounded size.
METHODS: dict[str, Callable[..., Line]] = {"york": york_line, "odr": odr_line}
