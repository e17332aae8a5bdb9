"""The parameter sweep: every combination of the lists, sharing what combinations have in common."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import quantile_offset
from ..scratch import Scratch
from .baseline import baseline_sweep
from .detect import events, in_event
from .noise import ROLLING
from .ordered import DAY
from .states import DETECTORS


def detection_sweep(df: DataFrame, keys: list[str], us: str, value: str, *, windows_us: list[int], quantiles: list[float], enter: list[float], leave: float, noise: str = "diff_mad", noise_window_us: int, max_gap_us: int, min_duration_us: int, min_valid_fraction: float = 0.5, sigma: str | None = None, step: float | None = None, baseline_sigma: str | None = None, detector: str = "hysteresis", chunk_us: int = DAY, scratch: Scratch | None = None) -> DataFrame:
    """Events of every (window_us, quantile, enter_sigma): noise once, a baseline a window, its quantiles in one pass.

    Thresholds apply to the enhancement less what noise alone shows at the quantile.  ``sigma`` names a column that holds each
    sample's noise; without it, noise is estimated from the values.  ``baseline_sigma``, a method of ``baseline.baseline_sigma``, adds
    the baseline's own uncertainty in quadrature to the sigma that thresholds are multiples of, and gives events their
    amplitude_sigma.  ``detector``: a name of ``states.DETECTORS``, for which ``enter`` and ``leave`` stand.
    """
    scratch = scratch or Scratch(df.sparkSession, "sweep")
    known = df.where(F.col(value).isNotNull())
    sig = known.withColumn("sigma", F.col(sigma)) if sigma else ROLLING[noise](known, keys, us, value, noise_window_us, step=step, chunk_us=chunk_us)
    base = scratch.write(baseline_sweep(sig, keys, us, value, windows_us, quantiles, min_valid_fraction=min_valid_fraction, sigma=baseline_sigma, chunk_us=chunk_us), "baselines")
    z = F.create_map(*(x for q in quantiles for x in (F.lit(float(q)), F.lit(quantile_offset(q)))))
    cells = base.withColumn("delta", F.col("enhancement") - F.element_at(z, F.col("quantile")) * F.col("sigma"))
    cells = cells.withColumn("enter_sigma", F.explode(F.array(*(F.lit(float(e)) for e in enter))))
    by = [*keys, "window_us", "quantile", "enter_sigma"]
    if baseline_sigma:
        cells = cells.withColumn("sigma", F.sqrt(F.pow("sigma", 2) + F.pow(F.coalesce("baseline_sigma", F.lit(0.0)), 2)))
    if detector == "hysteresis":
        st = in_event(cells, by, us, F.col("delta"), F.col("sigma"), F.col("enter_sigma"), leave, chunk_us=chunk_us)
    else:  # a detector with a model of its own is run once a value
        find = DETECTORS[detector]
        st = reduce(DataFrame.unionByName, [find(cells.where(F.col("enter_sigma") == float(e)), by, us, F.col("delta"), F.col("sigma"), e, leave, chunk_us=chunk_us) for e in enter])
    return events(st, by, us, "delta", "state", max_gap_us=max_gap_us, min_duration_us=min_duration_us, sigma="sigma" if baseline_sigma else None, chunk_us=chunk_us)
