"""Numbers of single samples."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scale that makes a median absolute deviation estimate a Gaussian's standard deviation.
MAD_SCALE = 1.4826


def known(x: Column) -> Column:
    """NaN and infinite become null, so that aggregates pass over them."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def missing(x: Column) -> Column:
    return x.isNull() | F.isnan(x)


def convert(x: Column, scale: float = 1.0, offset: float = 0.0) -> Column:
    return x * F.lit(scale) + F.lit(offset)


def declared_sigma(x: Column, absolute: float = 0.0, relative: float = 0.0) -> Column:
    """Noise floor and share of reading, in quadrature."""
    return F.sqrt(F.lit(absolute * absolute) + F.pow(F.lit(relative) * x, 2))


def reported_sigma(column: Column, scale: float = 1.0) -> Column:
    """A reported spread in the converted unit: scaled, never shifted, never negative."""
    return F.abs(column * F.lit(scale))


def quantize(x: Column, step: float) -> Column:
    """Nearest multiple of a step, halves to even."""
    return F.rint(x / F.lit(step)) * F.lit(step)


def quantization_sigma(step: float) -> float:
    """Spread of rounding to a step: the least that a noise scale can be."""
    return step / 12**0.5


def floor_sigma(sigma: Column, step: float | Column | None) -> Column:
    """At least the spread of rounding to ``step``; an unknown sigma stays unknown."""
    return sigma if step is None else F.when(sigma.isNotNull(), F.greatest(sigma, (step if isinstance(step, Column) else F.lit(step)) / 12**0.5))


def wrap_angle(x: Column) -> Column:
    return F.pmod(x, F.lit(360.0))


def quantile_offset(q: float) -> float:
    """How far, in sigmas, pure noise lies above its own q-quantile."""
    return -NormalDist().inv_cdf(q)


def source_label(declared: Column, reported: Column) -> Column:
    """Where a sigma comes from: declared, reported, else empirical."""
    return F.when(declared.isNotNull(), "declared").when(reported.isNotNull(), "reported").otherwise("empirical")
