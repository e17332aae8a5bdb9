"""Ordered operators without a task that holds a whole stream.

A stream is cut into chunks of time.  What crosses a chunk's edge - a previous row, a last known value, a running sum - is
carried by a small table of one row a chunk; rolling windows get a halo of copied rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = "_chunk"
DAY = 86_400_000_000
_ARROW = {"double": pa.float64(), "bigint": pa.int64(), "boolean": pa.bool_()}


def chunked(df: DataFrame, us: str, chunk_us: int) -> DataFrame:
    return df.withColumn(CHUNK, F.floor(F.col(us) / F.lit(chunk_us)))


def _within(keys: list[str], order: list[Column]):
    return Window.partitionBy(*keys, CHUNK).orderBy(*order)


def _carried(c: DataFrame, keys: list[str], summary: Column, carry: Callable[[Column, object], Column], name: str, down: bool = False) -> DataFrame:
    """Rows with what the chunks before theirs hand over."""
    chunks = c.groupBy(*keys, CHUNK).agg(summary.alias("_sum"))
    # without keys this is one task, over a row a chunk
    over = Window.partitionBy(*keys).orderBy(F.desc(CHUNK) if down else F.col(CHUNK))
    return c.join(chunks.withColumn(name, carry(F.col("_sum"), over)).drop("_sum"), [*keys, CHUNK])


def previous(df: DataFrame, keys: list[str], us: str, values: list[str], name: str, *, tie: list[str] | None = None, chunk_us: int = DAY) -> DataFrame:
    """Struct ``name`` of the values of the row before (null at a stream's start); rows of one time are ordered by ``tie``."""
    order = [F.col(us), *(F.col(t) for t in tie or [])]
    c = chunked(df, us, chunk_us).withColumn("_v", F.struct(*values))
    w = _within(keys, order)
    c = c.withColumn("_in", F.lag("_v").over(w)).withColumn("_n", F.row_number().over(w))
    c = _carried(c, keys, F.max_by("_v", F.struct(*order)), lambda s, over: F.lag(s).over(over), "_carry")
    return c.withColumn(name, F.when(F.col("_n") == 1, F.col("_carry")).otherwise(F.col("_in"))).drop(CHUNK, "_v", "_in", "_n", "_carry")


def last_known(df: DataFrame, keys: list[str], us: str, value: Column, name: str, *, tie: list[str] | None = None, chunk_us: int = DAY, down: bool = False) -> DataFrame:
    """Last non-null value at or before each row; with ``down`` the first at or after it."""
    raw = [F.col(us), *(F.col(t) for t in tie or [])]
    order = [o.desc() for o in raw] if down else raw
    c = chunked(df, us, chunk_us).withColumn("_v", value)
    run = _within(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("_in", F.last("_v", ignorenulls=True).over(run))
    rank = F.when(F.col("_v").isNotNull(), F.struct(*raw))
    edge = F.min_by("_v", rank) if down else F.max_by("_v", rank)
    c = _carried(c, keys, edge, lambda s, over: F.last(s, ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)), "_carry", down)
    return c.withColumn(name, F.coalesce("_in", "_carry")).drop(CHUNK, "_v", "_in", "_carry")


def running_sum(df: DataFrame, keys: list[str], us: str, value: Column, name: str, *, tie: list[str] | None = None, chunk_us: int = DAY) -> DataFrame:
    """Sum up to and with each row; nulls count nothing."""
    order = [F.col(us), *(F.col(t) for t in tie or [])]
    c = chunked(df, us, chunk_us).withColumn("_v", value)
    c = c.withColumn("_in", F.sum("_v").over(_within(keys, order).rowsBetween(Window.unboundedPreceding, 0)))
    c = _carried(c, keys, F.sum("_v"), lambda s, over: F.sum(s).over(over.rowsBetween(Window.unboundedPreceding, -1)), "_carry")
    zero = F.lit(0)
    return c.withColumn(name, F.coalesce("_in", zero) + F.coalesce("_carry", zero)).drop(CHUNK, "_v", "_in", "_carry")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by the columns ``order``; of rows that are equal in them any.  Rows are combined before the shuffle."""
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in df.columns if c not in keys)), F.struct(*order)).alias("_row"))
    return top.select(*(c if c in keys else F.col("_row").getField(c).alias(c) for c in df.columns))


def islands(df: DataFrame, keys: list[str], us: str, gap_us: int | Column, name: str, *, chunk_us: int = DAY) -> DataFrame:
    """Number, from 0, of the run of rows that follow each other by at most ``gap_us``; 0 starts a run."""
    gap = F.lit(gap_us) if isinstance(gap_us, int) else gap_us
    p = previous(df, keys, us, [us], "_prev", chunk_us=chunk_us)
    out = running_sum(p, keys, us, F.when(F.col(us) - F.col(f"_prev.{us}") > gap, 1).otherwise(0).cast("long"), name, chunk_us=chunk_us)
    return out.drop("_prev")


class _Columns(dict):
    """A chunk's columns in its order of time, made when asked for."""

    def __init__(self, table: pa.Table, order: np.ndarray):
        super().__init__()
        self.table, self.order = table, order

    def __missing__(self, name: str) -> np.ndarray:
        self[name] = self.table[name].to_numpy()[self.order]
        return self[name]


def over_chunks(df: DataFrame, keys: list[str], us: str, window_us: int, outputs: dict[str, str], fn: Callable[[np.ndarray, dict[str, np.ndarray], np.ndarray], dict], *, chunk_us: int = DAY, only: Column | None = None) -> DataFrame:
    """``df`` with ``outputs`` (name: SQL type), made chunk by chunk, each with half a window of copied rows on either side.

    ``fn(times, columns, own)`` gets a chunk's rows by time, copies among them, and the places of the chunk's own rows; it returns
    arrays for these.  A task holds a chunk and its halo, not a stream, as Arrow; columns that ``fn`` doesn't ask for stay so.
    No chunk is longer than a day or a window, whatever ``chunk_us`` says: dense streams have many samples in either.
    With ``only`` rows that it isn't true for are seen by ``fn``, but have no output.
    """
    half, chunk_us = window_us // 2, min(chunk_us, max(DAY, window_us))
    t = F.col(us)
    span = F.sequence(F.floor((t - half) / F.lit(chunk_us)), F.floor((t + half) / F.lit(chunk_us)))
    own_chunk = F.floor(t / F.lit(chunk_us))
    copies = df.withColumn("_own", own_chunk if only is None else F.when(only, own_chunk)).withColumn(CHUNK, F.explode(span))
    columns = list(df.columns)  # the function must not hold the frame
    schema = T.StructType(list(df.schema.fields) + [T.StructField(k, T._parse_datatype_string(v)) for k, v in outputs.items()])

    def go(table: pa.Table) -> pa.Table:
        order = np.argsort(table[us].to_numpy(), kind="stable")
        c = _Columns(table, order)
        own = np.flatnonzero(c["_own"] == c[CHUNK])
        got = fn(c[us], c, own) if len(own) else {k: [] for k in outputs}
        out = table.select(columns).take(order[own])
        for k, v in outputs.items():
            out = out.append_column(k, pa.array(got[k], _ARROW[v], from_pandas=True))
        return out

    return copies.groupBy(*keys, CHUNK).applyInArrow(go, schema)


def rolling(df: DataFrame, keys: list[str], us: str, value: str, window_us: int, outputs: dict[str, str], fn: Callable[[pd.Series, object], dict], *, chunk_us: int = DAY) -> DataFrame:
    """Centred windows (t - w/2, t + w/2] by pandas.

    ``fn(series, roller)`` gets a chunk's values, indexed by time, and pandas' roller over them; it returns arrays of the
    series' length for ``outputs``.
    """

    def go(t: np.ndarray, cols: dict[str, np.ndarray], own: np.ndarray) -> dict:
        s = pd.Series(cols[value].astype(float), index=pd.to_datetime(t, unit="us"))
        return {k: v[own] for k, v in fn(s, s.rolling(pd.Timedelta(window_us, "us"), center=True, min_periods=1)).items()}

    return over_chunks(df, keys, us, window_us, outputs, go, chunk_us=chunk_us)


def range_join(spans: DataFrame, points: DataFrame, lo: str, hi: str, us: str, bucket_us: int, *, on: list[str] | None = None, how: str = "inner", closed: bool = False) -> DataFrame:
    """Points in [lo, hi) (``closed``: [lo, hi]) of each span, as an equi-join on time buckets that a span covers.

    ``how``: inner, or left_anti / left_semi, which keep points with no / some span.
    """
    on = on or []
    b = F.lit(bucket_us)
    wide = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col(lo) / b), F.floor(F.col(hi) / b))))
    at = points.withColumn("_b", F.floor(F.col(us) / b))
    s, p = wide.alias("s"), at.alias("p")
    cond = (F.col("s._b") == F.col("p._b")) & (F.col(f"p.{us}") >= F.col(f"s.{lo}")) & ((F.col(f"p.{us}") <= F.col(f"s.{hi}")) if closed else (F.col(f"p.{us}") < F.col(f"s.{hi}")))
    for k in on:
        cond &= F.col(f"s.{k}") == F.col(f"p.{k}")
    if how != "inner":
        return p.join(s, cond, how).drop("_b")
    cols = [F.col(f"s.{c}") for c in spans.columns] + [F.col(f"p.{c}") for c in points.columns if c not in on]
    return s.join(p, cond).select(*cols)
