"""Zero-phase Butterworth low-pass, segment by segment, exact whatever the size of a task.

A segment ends at steps over 1.5 median periods.  It is extended by an odd reflection at either end and filtered forwards and
backwards, starting at rest at the first value.  The filter is a cascade of second-order sections, taken as one linear system of
``2 * sections`` states: what a part of a segment does to the state is an affine map, so a long segment is cut into parts of
``part_rows`` rows, each part is run from a zero state, the states at the parts' edges follow from a table of one row a part, and a
second run adds what they contribute.  Short segments are bundled, many to a task.  Within a part blocks of samples are filtered
by products of matrices.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .ordered import DAY, islands, previous, running_sum
from .select import quantiles

BLOCK = 128


def sections(order: int, cutoff_hz: float, rate_hz: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Second-order (and one first-order, for odd orders) sections of the filter, by the bilinear transform."""
    w = math.tan(math.pi * cutoff_hz / rate_hz)
    out = []
    for k in range(order // 2):
        q = 2 * math.sin(math.pi * (2 * k + 1) / (2 * order))
        d = 1 + q * w + w * w
        out.append((np.array([w * w, 2 * w * w, w * w]) / d, np.array([2 * (w * w - 1), 1 - q * w + w * w]) / d))
    if order % 2:
        out.append((np.array([w, w, 0.0]) / (1 + w), np.array([(w - 1) / (1 + w), 0.0])))
    return out


class System:
    """The cascade as z' = A z + B x, y = C z + D x, with its powers over a block."""

    def __init__(self, order: int, cutoff_hz: float, rate_hz: float):
        sos = sections(order, cutoff_hz, rate_hz)
        k = 2 * len(sos)
        a, c = np.zeros((k, k)), np.zeros(k)
        b, self.d = self._step(sos, np.zeros(k), 1.0)
        for i in range(k):
            a[:, i], c[i] = self._step(sos, np.eye(k)[i], 0.0)
        self.a = a
        self.rest = np.linalg.solve(np.eye(k) - a, b)  # the state that a constant 1 leads to
        powers = [np.eye(k)]
        for _ in range(BLOCK):
            powers.append(powers[-1] @ a)
        self.seen = np.array([c @ p for p in powers[:BLOCK]])  # of the state in the block's outputs
        self.left = np.array([p @ b for p in powers[BLOCK - 1 :: -1]]).T  # of the block's inputs in the state
        h = np.append(self.d, self.seen[:-1] @ b)
        lag = np.arange(BLOCK)[:, None] - np.arange(BLOCK)
        self.answer = np.where(lag >= 0, h[np.maximum(lag, 0)], 0.0)
        self.powers = powers

    @staticmethod
    def _step(sos: list, z: np.ndarray, x: float) -> tuple[np.ndarray, float]:
        new = np.empty_like(z)
        for i, (b, a) in enumerate(sos):
            y = b[0] * x + z[2 * i]
            new[2 * i], new[2 * i + 1] = b[1] * x - a[0] * y + z[2 * i + 1], b[2] * x - a[1] * y
            x = y
        return new, x

    def run(self, x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Outputs and the state after the last of ``x``."""
        y, whole = np.empty(len(x)), len(x) // BLOCK
        if whole:
            xs = x[: whole * BLOCK].reshape(whole, BLOCK)
            ys, moves = xs @ self.answer.T, xs @ self.left.T
            for i in range(whole):
                ys[i] += self.seen @ z
                z = self.powers[BLOCK] @ z + moves[i]
            y[: whole * BLOCK] = ys.ravel()
        if m := len(x) - whole * BLOCK:
            rest = x[whole * BLOCK :]
            y[whole * BLOCK :] = self.answer[:m, :m] @ rest + self.seen[:m] @ z
            z = self.powers[m] @ z + self.left[:, BLOCK - m :] @ rest
        return y, z


@lru_cache(maxsize=256)
def system(order: int, cutoff_hz: float, rate_hz: float) -> System:
    return System(order, cutoff_hz, rate_hz)


def padding(n: int, order: int, cutoff_hz: float, rate_hz: float) -> int:
    return min(n - 1, 3 * (order + 1) * max(1, int(rate_hz / cutoff_hz / 6)))


def zero_phase(x: np.ndarray, order: int, cutoff_hz: float, rate_hz: float) -> np.ndarray:
    """Forwards and backwards, over an odd reflection of the ends."""
    if len(x) < 3 or cutoff_hz >= rate_hz / 2:
        return x.astype(float)
    s, pad = system(order, cutoff_hz, rate_hz), padding(len(x), order, cutoff_hz, rate_hz)
    y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    for _ in range(2):
        y = s.run(y, s.rest * y[0])[0][::-1]
    return y[pad : pad + len(x)]


def _types(df: DataFrame, cols: list[str]) -> str:
    return "".join(f"`{c}` {t}, " for c, t in df.select(*cols).dtypes)


def _short(rows: DataFrame, keys: list[str], order: int, cutoff: float, part_rows: int) -> DataFrame:
    """keys, _seg, _i, _y of segments of less than ``part_rows`` rows: bundles of segments that start within so many rows."""

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_seg", "_i"], kind="stable")
        x, out = pdf["_x"].to_numpy(float), np.empty(len(pdf))
        starts = np.flatnonzero(np.append(True, np.diff(pdf["_seg"].to_numpy()) != 0)) if len(pdf) else []
        for s, e, p in zip(starts, [*starts[1:], len(pdf)], pdf["_period"].to_numpy()[starts]):
            out[s:e] = zero_phase(x[s:e], order, cutoff, 1e6 / p)
        return pdf[[*keys, "_seg", "_i"]].assign(_y=out)

    bundle = F.floor(F.col("_first") / part_rows).alias("_bundle")
    return rows.select(*keys, "_seg", "_i", "_x", "_period", bundle).groupBy(*keys, "_bundle").applyInPandas(go, _types(rows, [*keys, "_seg", "_i"]) + "_y double")


def _edges(parts: DataFrame, keys: list[str], order: int, cutoff: float, down: bool) -> DataFrame:
    """keys, _seg, _part, _z: the state before each part, from a row a part (_rows, _moved, and _at, the value that it meets first)."""

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_part", ascending=not down)
        s = system(order, cutoff, 1e6 / pdf["_period"].iloc[0])
        z, out = s.rest * pdf["_at"].iloc[0], []
        for n, moved in zip(pdf["_rows"], pdf["_moved"]):
            out.append(z)
            z = np.linalg.matrix_power(s.a, int(n)) @ z + np.asarray(moved)
        return pdf[[*keys, "_seg", "_part"]].assign(_z=out)

    return parts.groupBy(*keys, "_seg").applyInPandas(go, _types(parts, [*keys, "_seg", "_part"]) + "_z array<double>")


def _long(rows: DataFrame, keys: list[str], order: int, cutoff: float, part_rows: int, scratch: Scratch) -> DataFrame:
    """keys, _seg, _i, _y of longer segments."""
    x, i, last = F.col("_x"), F.col("_i"), F.col("_n") - 1
    pad = F.least(last, F.lit(3 * (order + 1)) * F.greatest(F.lit(1), F.floor(F.lit(1e6) / F.col("_period") / cutoff / 6)))
    place = lambda at, v: F.struct(at.cast("long").alias("_i"), v.alias("_x"))
    copies = F.array_compact(F.array(place(i, x), F.when((i >= 1) & (i <= pad), place(-i, 2 * F.col("_x0") - x)), F.when((i < last) & (last - i <= pad), place(2 * last - i, 2 * F.col("_xn") - x))))
    part = [*keys, "_seg", "_part"]
    wide = rows.select(*keys, "_seg", "_n", "_period", F.explode(copies).alias("_c")).select(*keys, "_seg", "_n", "_period", "_c._i", "_c._x", F.floor(F.col("_c._i") / part_rows).alias("_part"))
    wide = scratch.write(wide, "extended")
    types = _types(wide, part)

    def moved(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        v, s = pdf["_x"].to_numpy(), system(order, cutoff, 1e6 / pdf["_period"].iloc[0])
        return pdf[[*part, "_period"]].iloc[:1].assign(_rows=len(v), _at=v[0], _moved=[s.run(v, np.zeros(len(s.rest)))[1]])

    def forwards(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        s = system(order, cutoff, 1e6 / pdf["_period"].iloc[0])
        y = s.run(pdf["_x"].to_numpy(), np.asarray(pdf["_z"].iloc[0]))[0]
        back = [None] * len(y)
        back[0] = s.run(y[::-1], np.zeros(len(s.rest)))[1]  # a row a part tells what the way back does
        return pdf[[*part, "_i", "_n", "_period"]].assign(_x=y, _moved=back, _rows=len(y), _at=y[-1])

    def backwards(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i", ascending=False)
        s = system(order, cutoff, 1e6 / pdf["_period"].iloc[0])
        out = pdf[[*keys, "_seg", "_i"]].assign(_y=s.run(pdf["_x"].to_numpy(), np.asarray(pdf["_z"].iloc[0]))[0])
        return out[(pdf["_i"] >= 0) & (pdf["_i"] < pdf["_n"])]

    sums = scratch.write(wide.groupBy(*part).applyInPandas(moved, types + "_period double, _rows bigint, _at double, _moved array<double>"), "forwards")
    there = wide.join(_edges(sums, keys, order, cutoff, False), part).groupBy(*part)
    there = scratch.write(there.applyInPandas(forwards, types + "_i bigint, _n bigint, _period double, _x double, _moved array<double>, _rows bigint, _at double"), "there")
    edges = _edges(there.where("_moved is not null"), keys, order, cutoff, True)
    return there.drop("_moved").join(edges, part).groupBy(*part).applyInPandas(backwards, _types(wide, [*keys, "_seg"]) + "_i bigint, _y double")


def butterworth(df: DataFrame, keys: list[str], us: str, value: str, cutoff_period_s: float, *, order: int = 4, name: str = "smooth", chunk_us: int = DAY, part_rows: int = 1 << 16, scratch: Scratch | None = None) -> DataFrame:
    """Known samples with ``name``.  Segments under three samples, and cutoffs at or above half the rate, stay as they are."""
    scratch = scratch or Scratch(df.sparkSession, "butterworth")
    known = df.where(F.col(value).isNotNull())
    step = previous(known, keys, us, [us], "_p", chunk_us=chunk_us).select(*keys, (F.col(us) - F.col(f"_p.{us}")).alias("_d"))
    step = quantiles(step, keys, {"_period": (F.col("_d"), [0.5])}).select(*keys, F.col("_period")[0].alias("_period"))
    seg = islands(known.join(step, keys), keys, us, F.col("_period") * 1.5, "_seg", chunk_us=chunk_us)
    seg = scratch.write(running_sum(seg, keys, us, F.lit(1).cast("long"), "_row", chunk_us=chunk_us), "segments")
    row, x = F.col("_row"), F.col(value).cast("double")
    ends = seg.groupBy(*keys, "_seg").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"), F.min_by(x, row).alias("_x0"), F.max_by(x, row).alias("_xn"))
    rows = seg.join(ends, [*keys, "_seg"]).select(*keys, "_seg", "_first", "_n", "_x0", "_xn", "_period", (row - F.col("_first")).alias("_i"), x.alias("_x"))
    cutoff = 1 / cutoff_period_s
    live = (F.col("_period") > 0) & (F.col("_n") >= 3) & (F.lit(2 * cutoff / 1e6) * F.col("_period") < 1)
    smooth = _short(rows.where(live & (F.col("_n") < part_rows)), keys, order, cutoff, part_rows)
    if ends.where(F.col("_n") >= part_rows).head(1):
        smooth = smooth.unionByName(_long(rows.where(live & (F.col("_n") >= part_rows)), keys, order, cutoff, part_rows, scratch))
    both = seg.join(ends.select(*keys, "_seg", "_first"), [*keys, "_seg"]).withColumn("_i", row - F.col("_first")).join(smooth, [*keys, "_seg", "_i"], "left")
    return both.select(*df.columns, F.coalesce("_y", x).alias(name))
