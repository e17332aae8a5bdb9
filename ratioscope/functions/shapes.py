"""Plume kernels: unit peak, zero outside their support."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Support in widths: before and after the centre, and for the tail in decay times.
CORE, TAIL = 4.0, 6.0


def log_erfcx(z: np.ndarray) -> np.ndarray:
    """ln(exp(z^2) erfc(z)) without overflow."""
    out = np.empty_like(z)
    low, high = z < -25, z > 25
    mid = ~(low | high)
    out[low] = math.log(2.0) + z[low] ** 2
    out[mid] = [math.log(math.erfc(v)) + v * v for v in z[mid]]
    v = z[high]
    i = 1 / (2 * v * v)
    out[high] = np.log((1 - i + 3 * i**2 - 15 * i**3) / (v * math.sqrt(math.pi)))
    return out


@dataclass(frozen=True)
class Kernel:
    """Times in seconds about the centre.  ``tau`` 0: a Gaussian."""

    sigma: float
    tau: float = 0.0
    before: float = 0.0
    after: float = 0.0
    peak: float = 0.0
    log_peak: float = 0.0

    @classmethod
    def build(cls, sigma: float, tau: float = 0.0) -> Kernel:
        before, after = CORE * sigma, CORE * sigma + TAIL * tau
        if not tau:
            return cls(sigma, 0.0, before, after)
        raw = cls(sigma, tau, before, after)
        lo, hi = -before, after
        for n in (2001, 401, 401, 401):  # each grid is laid about the best point of the one before
            t = np.linspace(lo, hi, n)
            best, step = t[np.argmax(raw.log_shape(t))], t[1] - t[0]
            lo, hi = best - step, best + step
        return cls(sigma, tau, before, after, float(best), float(raw.log_shape(np.array([best]))[0]) + 1e-12)

    def log_shape(self, t: np.ndarray) -> np.ndarray:
        u = np.asarray(t, float) / self.sigma
        if not self.tau:
            return -u * u / 2
        ratio = self.sigma / self.tau
        z = (ratio - u) / math.sqrt(2)
        # beyond the seam the tail is a plain exponential
        tail = math.log(2.0) + ratio * ratio / 2 - u * ratio
        return np.where(z < -25, tail, -u * u / 2 + log_erfcx(np.maximum(z, -25)))

    def evaluate(self, t: np.ndarray) -> np.ndarray:
        t = np.asarray(t, float)
        return np.where((t >= -self.before) & (t <= self.after), np.exp(np.minimum(self.log_shape(t) - self.log_peak, 0.0)), 0.0)

    def column(self, t: Column) -> Column:
        """The same for a column: a Gaussian is an expression, others an Arrow function."""
        inside = (t >= -self.before) & (t <= self.after)
        if not self.tau:
            return F.when(inside, F.exp(-F.pow(t / self.sigma, 2) / 2)).otherwise(0.0)
        own = self

        @F.pandas_udf("double")
        def shape(x: pd.Series) -> pd.Series:
            return pd.Series(own.evaluate(x.to_numpy()))

        return shape(t)
