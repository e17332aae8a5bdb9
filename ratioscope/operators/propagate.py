"""Uncertainty of binned values: random parts average down, systematic ones do not."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Standard error of a median over that of a mean, for Gaussian noise.
MEDIAN_FACTOR = math.sqrt(math.pi / 2)


def random_of_mean(sigma: Column) -> Column:
    """Of an equally weighted mean: root of summed squares over n."""
    return F.sqrt(F.sum(sigma * sigma)) / F.count(sigma)


def random_of_weighted_mean(sigma: Column) -> Column:
    """Of the mean weighted by inverse variances."""
    return F.sqrt(1.0 / F.sum(1.0 / (sigma * sigma)))


def weighted_mean(x: Column, sigma: Column) -> Column:
    w = F.when(x.isNotNull(), 1.0 / (sigma * sigma))
    return F.sum(w * x) / F.sum(w)


def systematic_of_mean(sigma: Column) -> Column:
    """Fully correlated: the mean of the sigmas."""
    return F.avg(sigma)


def systematic_of_weighted_mean(sigma_sys: Column, sigma_rand: Column) -> Column:
    w = 1.0 / (sigma_rand * sigma_rand)
    return F.sum(w * sigma_sys) / F.sum(w)


def random_of_median(sigma: Column) -> Column:
    return random_of_mean(sigma) * F.lit(MEDIAN_FACTOR)


def effective_n(n: Column, spacing_s: Column, tau_s: float) -> Column:
    """Independent samples among n that decorrelate over tau, within [1, n]."""
    rho = F.exp(-spacing_s / F.lit(tau_s))
    return F.least(n.cast("double"), F.greatest(F.lit(1.0), n * (1 - rho) / (1 + rho)))


def exact_random_of_mean(df: DataFrame, cell: list[str], us: str, sigma: str, tau_s: float) -> DataFrame:
    """The double sum of rho_ij sigma_i sigma_j over a cell's samples, rho = exp(-|dt| / tau): cell, sigma_mean.

    A cell's samples are gathered in one array, by time: what all earlier ones add to a sample decays from one sample to the next, so
    the double sum is one pass.
    """
    got = df.where(F.col(sigma).isNotNull()).groupBy(*cell).agg(F.sort_array(F.collect_list(F.struct(F.col(us).alias("t"), F.col(sigma).cast("double").alias("s")))).alias("_a"))
    a = F.col("_a")
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("before"), a[0]["t"].alias("t"))

    def step(acc: Column, p: Column) -> Column:
        before = acc["before"] * F.exp((acc["t"] - p["t"]) / F.lit(tau_s * 1e6))
        return F.struct((acc["total"] + p["s"] * (p["s"] + 2 * before)).alias("total"), (before + p["s"]).alias("before"), p["t"].alias("t"))

    return got.select(*cell, (F.sqrt(F.aggregate(a, start, step, lambda acc: acc["total"])) / F.size(a)).alias("sigma_mean"))
