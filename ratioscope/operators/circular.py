"""Angles averaged as unit vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def circular_mean(degrees: Column) -> Column:
    """Direction of the mean vector, in [0, 360); null where the vectors cancel."""
    s, c = F.avg(F.sin(F.radians(degrees))), F.avg(F.cos(F.radians(degrees)))
    return F.when(s * s + c * c > 1e-24, F.pmod(F.degrees(F.atan2(s, c)), F.lit(360.0)))


def circular_sd(degrees: Column) -> Column:
    """Root of -2 ln R in degrees (our choice; none is specified)."""
    s, c = F.avg(F.sin(F.radians(degrees))), F.avg(F.cos(F.radians(degrees)))
    r = F.least(F.lit(1.0), F.sqrt(s * s + c * c))
    return F.when(r > 1e-12, F.degrees(F.sqrt(-2 * F.log(r))))


def yamartino_sd(degrees: Column) -> Column:
    """Yamartino's single-pass estimate, in degrees."""
    s, c = F.avg(F.sin(F.radians(degrees))), F.avg(F.cos(F.radians(degrees)))
    e = F.sqrt(F.greatest(F.lit(0.0), 1 - (s * s + c * c)))
    return F.degrees(F.asin(e) * (1 + (2 / 3**0.5 - 1) * e * e * e))
