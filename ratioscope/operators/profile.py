"""Statistical fingerprint of a real series."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ProfilingError
from ..functions.scalar import MAD_SCALE, known
from ..scratch import Scratch
from .baseline import baseline_sweep
from .noise import diff_mad
from .ordered import DAY, islands, previous, running_sum
from .select import quantiles


@dataclass
class Profile:
    """``stats``: a row a series; ``blocks``: name, block_id, values (mean-centred, gap-free)."""

    stats: DataFrame
    blocks: DataFrame

    def summary(self, name: str) -> str:
        r = self.stats.where(F.col("name") == name).first()
        tau = "none" if r["decorrelation_timescale_s"] is None else f"{r['decorrelation_timescale_s']:.3g} s"
        return f"{name}: {r['n_source_points']} samples every {r['sample_period_s']:.3g} s; residual {r['residual_sigma']:.4g}, noise {r['noise_sigma']:.4g}, lag-1 {r['lag1_autocorr']:.4f}, tau {tau}; background {r['background_median']:.6g} (IQR {r['background_iqr']:.4g})"


def lag1(df: DataFrame, keys: list[str], us: str, value: str, *, chunk_us: int = DAY) -> DataFrame:
    """lag1_autocorr of each key: correlation of neighbours, 0 where undefined (fewer than three, constant)."""
    p = previous(df, keys, us, [value], "_p", chunk_us=chunk_us)
    x, y = F.col(value), F.col(f"_p.{value}")
    pair = p.where(x.isNotNull() & y.isNotNull())
    r = F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))
    out = pair.groupBy(*keys).agg(r.alias("_r"), F.count("*").alias("_n"))
    good = (F.col("_n") >= 2) & F.col("_r").isNotNull() & ~F.isnan("_r")
    return df.select(*keys).distinct().join(out, keys, "left").select(*keys, F.when(good, F.col("_r")).otherwise(0.0).alias("lag1_autocorr"))


def ar1_timescale(rho, period_s):
    """-dt / ln rho where 0 < rho < 1 and dt > 0, else null."""
    return F.when((rho > 0) & (rho < 1) & (period_s > 0), -period_s / F.log(rho))


def check_sorted(df: DataFrame, us: str, order: str) -> None:
    """Refuses a series whose times fall along the whole numbers ``order``."""
    p = previous(df.select(order, us), [], order, [us], "_p", chunk_us=1_000_000)
    if p.where(F.col(us) < F.col(f"_p.{us}")).head(1):
        raise ProfilingError("the series' times are not in order")


def profile(df: DataFrame, name: str, us: str, value: str, *, window_us: int = 1_800_000_000, quantile: float = 0.10, block_length: int = 512, max_blocks: int = 2000, chunk_us: int = DAY, scratch: Scratch | None = None) -> Profile:
    """Profiles of all series of ``df``, told apart by column ``name``.

    Unknown values count for the sample period only.  A gap is a step longer than 1.5 periods; blocks never span one.
    """
    if block_length < 2 or max_blocks < 1:
        raise ProfilingError("block_length must be at least 2 and max_blocks at least 1")
    scratch = scratch or Scratch(df.sparkSession, "profile")
    keys = [name]
    rows = scratch.write(df.select(name, us, known(F.col(value).cast("double")).alias("x")), "series")
    steps = previous(rows, keys, us, [us], "_p", chunk_us=chunk_us).select(name, (F.col(us) - F.col(f"_p.{us}")).alias("d"))
    period = quantiles(steps, keys, {"m": (F.col("d"), [0.5])}, scratch=scratch).select(name, F.coalesce(F.col("m")[0], F.lit(0.0)).alias("period_us"))
    base = baseline_sweep(rows.where("x is not null"), keys, us, "x", [window_us], [quantile], chunk_us=chunk_us)
    base = scratch.write(base.select(name, us, "x", "baseline", F.col("enhancement").alias("res")), "residual")
    if not base.where("baseline is not null").head(1):
        raise ProfilingError("no known values, or windows without two of them")
    noise = diff_mad(base, keys, us, "x", chunk_us=chunk_us).select(name, F.col("sigma").alias("noise_sigma"))
    mid = quantiles(base, keys, {"m": (F.col("res"), [0.5]), "q": (F.col("baseline"), [0.25, 0.5, 0.75])}, scratch=scratch).join(base.groupBy(name).agg(F.count("x").alias("n_source_points")), name)
    mid = mid.withColumn("m", F.col("m")[0])
    off = quantiles(base.join(mid.select(name, "m"), name), keys, {"o": (F.abs(F.col("res") - F.col("m")), [0.5])}, scratch=scratch)
    spread = off.select(name, (F.col("o")[0] * MAD_SCALE).alias("residual_sigma"))
    rho = lag1(base, keys, us, "res", chunk_us=chunk_us)
    p = F.col("period_us") / 1e6
    stats = mid.join(spread, name).join(noise, name).join(rho, name).join(period, name).select(F.col(name).alias("name"), "residual_sigma", "noise_sigma", "lag1_autocorr", ar1_timescale(F.col("lag1_autocorr"), p).alias("decorrelation_timescale_s"), F.col("q")[1].alias("background_median"), (F.col("q")[2] - F.col("q")[0]).alias("background_iqr"), p.alias("sample_period_s"), "n_source_points")
    return Profile(scratch.write(stats, "stats"), blocks(base.where("res is not null").join(period, name), keys, us, "res", F.col("period_us") * 1.5, block_length, max_blocks, chunk_us=chunk_us).withColumnRenamed(name, "name"))


def blocks(df: DataFrame, keys: list[str], us: str, value: str, gap_us, length: int, most: int, *, chunk_us: int = DAY) -> DataFrame:
    """keys, block_id (from 0), values: full runs of ``length`` gap-free samples, less their means; at most ``most`` a key.

    A block's number is its place in its segment beyond the blocks of the segments before: a sum over a row a segment, so that no
    task orders a stream's blocks, and rows of blocks beyond ``most`` go before blocks are made.
    """
    rows = running_sum(islands(df, keys, us, gap_us, "_seg", chunk_us=chunk_us), keys, us, F.lit(1).cast("long"), "_row", chunk_us=chunk_us)
    segments = rows.groupBy(*keys, "_seg").agg(F.min("_row").alias("_first"), F.floor(F.count("*") / length).alias("_k"))
    segments = running_sum(segments, keys, "_seg", F.col("_k"), "_upto", chunk_us=100_000).where("_k > 0").withColumn("_before", F.col("_upto") - F.col("_k"))
    at = rows.join(segments, [*keys, "_seg"]).withColumn("_b", F.floor((F.col("_row") - F.col("_first")) / length)).where("_b < _k")
    at = at.withColumn("block_id", F.col("_before") + F.col("_b")).where(F.col("block_id") < most)
    full = at.groupBy(*keys, "block_id").agg(F.array_sort(F.collect_list(F.struct(us, value))).alias("_v"), F.avg(value).alias("_m"))
    return full.select(*keys, "block_id", F.transform(F.col("_v"), lambda s: s[value] - F.col("_m")).alias("values"))
