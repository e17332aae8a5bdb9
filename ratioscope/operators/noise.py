"""Noise scales from the data themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import MAD_SCALE, floor_sigma
from ..scratch import Scratch
from .ordered import DAY, over_chunks, previous, rolling
from .select import quantiles
from .windowed import rolling_order, rolling_qn_of

_SQRT2 = 2**0.5


def abs_steps(df: DataFrame, keys: list[str], us: str, value: str, name: str, *, chunk_us: int = DAY) -> DataFrame:
    """Absolute difference to the known value before; unknown values have none and are stepped over."""
    p = previous(df.where(F.col(value).isNotNull()), keys, us, [value], "_p", chunk_us=chunk_us)
    return p.withColumn(name, F.abs(F.col(value) - F.col(f"_p.{value}"))).drop("_p")


def diff_mad(df: DataFrame, keys: list[str], us: str, value: str, *, step: float | None = None, chunk_us: int = DAY) -> DataFrame:
    """sigma and n of each key: scaled median of absolute first differences; null with fewer than two values."""
    d = Scratch(df.sparkSession, "steps").write(abs_steps(df, keys, us, value, "_d", chunk_us=chunk_us).select(*keys, "_d", value), "steps")
    mid = quantiles(d, keys, {"_m": (F.col("_d"), [0.5])})
    n = d.groupBy(*keys).agg(F.count(value).alias("n"))
    return n.join(mid, keys).select(*keys, floor_sigma(F.col("_m")[0] * F.lit(MAD_SCALE / _SQRT2), step).alias("sigma"), "n")


def mad(df: DataFrame, keys: list[str], us: str, value: str, *, step: float | None = None, chunk_us: int = DAY) -> DataFrame:
    """sigma and n of each key: scaled median deviation from the median."""
    rows = Scratch(df.sparkSession, "values").write(df.select(*keys, value), "values")
    mid = quantiles(rows, keys, {"_m": (F.col(value), [0.5])})
    off = quantiles(rows.join(mid, keys), keys, {"_o": (F.abs(F.col(value) - F.col("_m")[0]), [0.5])})
    n = rows.groupBy(*keys).agg(F.count(value).alias("n"))
    return n.join(off, keys).select(*keys, floor_sigma(F.col("_o")[0] * F.lit(MAD_SCALE), step).alias("sigma"), "n")


def rolling_diff_mad(df: DataFrame, keys: list[str], us: str, value: str, window_us: int, *, name: str = "sigma", step: float | None = None, chunk_us: int = DAY) -> DataFrame:
    """``diff_mad`` of a centred window at every known sample."""
    d = abs_steps(df, keys, us, value, "_d", chunk_us=chunk_us)
    out = rolling(d, keys, us, "_d", window_us, {name: "double"}, lambda s, r: {name: (r.median() * (MAD_SCALE / _SQRT2)).to_numpy()}, chunk_us=max(chunk_us, window_us))
    return out.withColumn(name, floor_sigma(F.nanvl(F.col(name), F.lit(None)), step)).drop("_d")


def rolling_mad(df: DataFrame, keys: list[str], us: str, value: str, window_us: int, *, name: str = "sigma", step: float | None = None, chunk_us: int = DAY) -> DataFrame:
    """``mad`` of a centred window at every sample."""
    out = rolling_order(df, keys, us, value, window_us, {name: "double"}, lambda w, _: (MAD_SCALE * w.mad()[1],), chunk_us=max(chunk_us, window_us))
    return out.withColumn(name, floor_sigma(F.nanvl(F.col(name), F.lit(None)), step))


def rolling_qn(df: DataFrame, keys: list[str], us: str, value: str, window_us: int, *, name: str = "sigma", step: float | None = None, chunk_us: int = DAY) -> DataFrame:
    """Qn of a centred window's values at every sample; null with fewer than two."""
    go = lambda t, c, own: {name: rolling_qn_of(t, c[value].astype(float), window_us // 2, own)}
    out = over_chunks(df, keys, us, window_us, {name: "double"}, go, chunk_us=max(chunk_us, window_us))
    return out.withColumn(name, floor_sigma(F.nanvl(F.col(name), F.lit(None)), step))


def rolling_diff_qn(df: DataFrame, keys: list[str], us: str, value: str, window_us: int, *, name: str = "sigma", step: float | None = None, chunk_us: int = DAY) -> DataFrame:
    """Qn of the signed first differences in a centred window, over the square root of 2, at every known sample."""
    p = previous(df.where(F.col(value).isNotNull()), keys, us, [value], "_p", chunk_us=chunk_us)
    out = rolling_qn(p.withColumn("_d", F.col(value) - F.col(f"_p.{value}")).drop("_p"), keys, us, "_d", window_us, name=name, chunk_us=chunk_us)
    return out.withColumn(name, floor_sigma(F.col(name) / _SQRT2, step)).drop("_d")


def resolution(df: DataFrame, keys: list[str], us: str, value: str, *, chunk_us: int = DAY) -> DataFrame:
    """Smallest step between neighbours that isn't 0: a guess at the reporting resolution (our choice; none is specified)."""
    d = abs_steps(df, keys, us, value, "_d", chunk_us=chunk_us)
    return d.groupBy(*keys).agg(F.min(F.when(F.col("_d") > 0, F.col("_d"))).alias("step"))


#: Estimators by name, over all of a key's samples and over a window.  Qn is for windows: a key's pairs have no bound.
ESTIMATORS: dict[str, Callable[..., DataFrame]] = {"diff_mad": diff_mad, "mad": mad}
ROLLING: dict[str, Callable[..., DataFrame]] = {"diff_mad": rolling_diff_mad, "mad": rolling_mad, "diff_qn": rolling_diff_qn, "qn": rolling_qn}
