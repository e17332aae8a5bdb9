"""Change points of a signal's mean, as a third detector's model (our choice).

A segmentation costs the squared distances of its samples from their segment's mean, in their sigma, plus a penalty a change.  The
cheapest one is found sample by sample: a candidate is a place where the last segment may begin; candidates that can't win any
more are pruned, so few are left where changes are (pruned exact linear time, Killick et al. 2012).

A gap-free segment is cut into parts of ``part_rows`` samples.  A part needs of all before it only its candidates (their costs and the
sums of their samples), which are handed over in a table of a row a segment; all segments' parts of one number are run together,
and so are the ways back, part by part from the last.  No task holds more than a part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .ordered import DAY, islands, running_sum

class Candidates:
    """Where the last segment may begin, the cost before it, and sums of 1, x and x^2, over sigma^2, of the samples since."""

    def __init__(self, penalty: float, state: tuple | None = None):
        self.penalty = penalty
        best, at, *rest = state if state else (-penalty, [], [], [], [], [])
        self.best, self.at = best, np.array(at, np.int64)
        self.cost, self.w, self.wx, self.wxx = (np.array(x, float) for x in rest)

    def add(self, i: int, x: float, w: float) -> int:
        """Takes in sample ``i``; the place where the last segment begins in the cheapest segmentation up to it, of equally cheap
        ones the earliest."""
        self.at = np.append(self.at, i)
        self.cost = np.append(self.cost, self.best + self.penalty)
        self.w, self.wx, self.wxx = (np.append(s, 0.0) + v for s, v in ((self.w, w), (self.wx, w * x), (self.wxx, w * x * x)))
        mean = np.divide(self.wx, self.w, out=np.zeros_like(self.wx), where=self.w > 0)
        own = self.cost + np.maximum(self.wxx - mean * self.wx, 0.0)
        k = int(own.argmin())
        self.best, first = float(own[k]), int(self.at[k])
        keep = own <= self.best + self.penalty
        self.at, self.cost, self.w, self.wx, self.wxx = (s[keep] for s in (self.at, self.cost, self.w, self.wx, self.wxx))
        return first

    def state(self) -> tuple:
        return self.best, self.at.tolist(), self.cost.tolist(), self.w.tolist(), self.wx.tolist(), self.wxx.tolist()


def change_points(df: DataFrame, keys: list[str], us: str, value: str, sigma: str, *, penalty: float, max_gap_us: int, part_rows: int = 1 << 17, chunk_us: int = DAY, scratch: Scratch | None = None) -> DataFrame:
    """keys, segment (number of the gap-free segment), start_us, end_us, level (weighted mean), n: the pieces of constant level.

    ``penalty`` is in squared sigmas.  Samples without a value or a positive sigma are left out.  Samples of one time follow each
    other by value.  Values are taken about their segment's first, to keep digits.
    """
    scratch = scratch or Scratch(df.sparkSession, "changes")
    rows = df.where(F.col(value).isNotNull() & (F.col(sigma) > 0)).select(*keys, us, F.col(value).cast("double").alias("_x"), (1 / F.pow(sigma, 2)).alias("_w"))
    rows = scratch.write(running_sum(islands(rows, keys, us, max_gap_us, "_seg", chunk_us=chunk_us), keys, us, F.lit(1).cast("long"), "_row", tie=["_x"], chunk_us=chunk_us), "rows")
    seg = [*keys, "_seg"]
    first = rows.groupBy(*seg).agg(F.min("_row").alias("_first"), F.min_by("_x", "_row").alias("_x0"))
    rows = scratch.write(rows.join(first, seg).select(*seg, us, (F.col("_x") - F.col("_x0")).alias("_x"), "_x0", "_w", (F.col("_row") - F.col("_first")).alias("_i"), F.floor((F.col("_row") - F.col("_first")) / part_rows).alias("_part")), "parts")
    types = "".join(f"`{k}` {t}, " for k, t in rows.select(*seg).dtypes)
    most = rows.agg(F.max("_part")).first()[0]
    out_types = types + f"`{us}` bigint, _x double, _x0 double, _w double, _i bigint, _begin bigint"

    def forwards(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        state = pdf.iloc[0]
        c = Candidates(penalty, None if state["_at"] is None else tuple(state[k] for k in ("_best", "_at", "_cost", "_w0", "_wx", "_wxx")))
        begin = [c.add(i, x, w) for i, x, w in zip(pdf["_i"].tolist(), pdf["_x"].tolist(), pdf["_w"].tolist())]
        out = pdf[[*seg, us, "_x", "_x0", "_w", "_i"]].assign(_begin=begin)
        for k, v in zip(("_best", "_at", "_cost", "_w1", "_wx", "_wxx"), c.state()):
            out[k] = [None] * (len(out) - 1) + [v]
        return out

    def backwards(pdf: pd.DataFrame) -> pd.DataFrame:
        """Pieces of a part, from ``_end``, the last sample that no piece holds yet; the earliest one may begin before the part."""
        pdf = pdf.sort_values("_i")
        i, begin = pdf["_i"].to_numpy(), pdf["_begin"].to_numpy()
        end, no = int(pdf["_end"].iloc[0]), np.empty(len(pdf), np.int64)
        while end >= i[0]:
            b = int(begin[end - i[0]])
            no[max(b - i[0], 0) : end - i[0] + 1] = b
            end = b - 1
        if int(pdf["_end"].iloc[0]) < i[-1]:  # the rest is of a piece that a later part has named
            no[max(int(pdf["_end"].iloc[0]) - i[0] + 1, 0) :] = int(pdf["_open"].iloc[0])
        return pdf[[*seg, us, "_x", "_x0", "_w"]].assign(_piece=no, _left=end, _lowest=int(no[0]))

    state, parts = None, []
    carry = ("_best", "_at", "_cost", "_w1", "_wx", "_wxx")
    for p in range((most if most is not None else -1) + 1):
        own = rows.where(F.col("_part") == p)
        if state is None:
            given = own.select("*", F.lit(None).cast("double").alias("_best"), *(F.lit(None).cast(t).alias(n) for n, t in (("_at", "array<bigint>"), ("_cost", "array<double>"), ("_w0", "array<double>"), ("_wx", "array<double>"), ("_wxx", "array<double>"))))
        else:
            given = own.join(state.withColumnRenamed("_w1", "_w0"), seg)
        done = given.groupBy(*seg).applyInPandas(forwards, out_types + ", _best double, _at array<bigint>, _cost array<double>, _w1 array<double>, _wx array<double>, _wxx array<double>")
        parts.append(scratch.write(done, f"part{p}"))
        state = parts[-1].where("_at is not null").select(*seg, *carry)
    pieces, left = None, None
    for done in reversed(parts):
        last = done.groupBy(*seg).agg(F.max("_i").alias("_last"))
        if left is None:
            ends = last.select(*seg, F.col("_last").alias("_end"), F.lit(-1).cast("long").alias("_open"))
        else:
            ends = last.join(left, seg, "left").select(*seg, F.coalesce("_left", "_last").alias("_end"), F.coalesce("_lowest", F.lit(-1)).alias("_open"))
        got = done.select(*seg, us, "_x", "_x0", "_w", "_i", "_begin").join(ends, seg).groupBy(*seg).applyInPandas(backwards, types + f"`{us}` bigint, _x double, _x0 double, _w double, _piece bigint, _left bigint, _lowest bigint")
        got = scratch.write(got, "back")
        left = got.groupBy(*seg).agg(F.min("_left").alias("_left"), F.min("_lowest").alias("_lowest"))
        own = got.groupBy(*seg, "_piece").agg(F.min(us).alias("start_us"), F.max(us).alias("end_us"), F.sum(F.col("_w") * F.col("_x")).alias("_wx"), F.sum("_w").alias("_w"), F.first("_x0").alias("_x0"), F.count("*").alias("n"))
        pieces = own if pieces is None else pieces.unionByName(own)
    if pieces is None:
        return df.sparkSession.createDataFrame([], "".join(f"`{k}` {t}, " for k, t in df.select(*keys).dtypes) + "segment bigint, start_us bigint, end_us bigint, level double, n bigint")
    whole = pieces.groupBy(*seg, "_piece").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), (F.sum("_wx") / F.sum("_w") + F.first("_x0")).alias("level"), F.sum("n").alias("n"))
    return whole.select(*keys, F.col("_seg").cast("long").alias("segment"), "start_us", "end_us", "level", "n")
