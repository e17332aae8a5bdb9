"""Events: enhancement that rises over a high threshold and has not yet fallen below a low one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import quantile_offset
from ..functions.time import from_us
from .ordered import DAY, islands, last_known, range_join


def corrected(enhancement: Column, sigma: Column, quantile: float) -> Column:
    """Enhancement less what pure noise shows above its own quantile."""
    return enhancement - F.lit(quantile_offset(quantile)) * sigma


def in_event(df: DataFrame, keys: list[str], us: str, delta: Column, sigma: Column, enter: float, leave: float, name: str = "state", *, chunk_us: int = DAY) -> DataFrame:
    """1 from delta > enter * sigma until delta < leave * sigma, else 0; unknown delta changes nothing."""
    turn = F.when(delta > enter * sigma, 1).when(delta < leave * sigma, 0)
    out = last_known(df, keys, us, turn, name, chunk_us=chunk_us)
    return out.withColumn(name, F.coalesce(name, F.lit(0)))


def events(df: DataFrame, keys: list[str], us: str, delta: str, state: str, *, max_gap_us: int, min_duration_us: int, sigma: str | None = None, chunk_us: int = DAY) -> DataFrame:
    """One row an event: keys, event_no (from 0 by start), start_us, peak_us, end_us, amplitude, n, and with ``sigma``, the name of
    a column, amplitude_sigma, which is its value at the peak.

    Runs of samples inside events whose neighbours are at most ``max_gap_us`` apart are one event, dips between them
    included; events shorter than ``min_duration_us`` are dropped.  Of equal peaks the first counts.
    """
    run = islands(df.where(F.col(state) == 1), keys, us, max_gap_us, "_run", chunk_us=chunk_us)
    top = F.struct(F.col(delta), -F.col(us))
    out = run.groupBy(*keys, "_run").agg(F.min(us).alias("start_us"), F.max_by(us, top).alias("peak_us"), F.max(us).alias("end_us"), F.max(delta).alias("amplitude"), F.count("*").alias("n"), *([F.max_by(sigma, top).alias("amplitude_sigma")] if sigma else []))
    out = out.where(F.col("end_us") - F.col("start_us") >= min_duration_us)
    # events are far fewer than samples
    return out.withColumn("event_no", F.row_number().over(Window.partitionBy(*keys).orderBy("start_us")) - 1).drop("_run")


def catalog(ev: DataFrame, stream: str) -> DataFrame:
    """Events with ids and times."""
    return ev.select(F.format_string("%s_%05d", F.col(stream), F.col("event_no")).alias("event_id"), F.col(stream), *(from_us(F.col(f"{c}_us")).alias(f"{c}_time") for c in ("start", "peak", "end")), "amplitude", "n")


def nested_links(ev: DataFrame, keys: list[str], level: str, *, bucket_us: int = DAY) -> DataFrame:
    """child_no, parent_no by keys and level: the tightest event of the next level that holds the child's whole span.

    ``level`` numbers baseline windows from the shortest, 0.
    """
    parent = ev.select(*keys, (F.col(level) - 1).alias("child_level"), F.col("event_no").alias("parent_no"), F.col("start_us").alias("p0"), F.col("end_us").alias("p1"))
    child = ev.select(*keys, F.col(level).alias("child_level"), F.col("event_no").alias("child_no"), F.col("start_us").alias("c0"), F.col("end_us").alias("c1"))
    both = range_join(parent, child, "p0", "p1", "c0", bucket_us, on=[*keys, "child_level"], closed=True).where("c1 <= p1")
    rank = Window.partitionBy(*keys, "child_level", "child_no").orderBy(F.col("p1") - F.col("p0"), "parent_no")
    return both.withColumn("_k", F.row_number().over(rank)).where("_k = 1").select(*keys, "child_level", "child_no", "parent_no")


def score(found: DataFrame, truth: DataFrame, keys: list[str], *, bucket_us: int = DAY) -> DataFrame:
    """One row a true event: event_id, hit, n_found, overlap_us.  Both need start_us and end_us, truth also event_id.

    Detections that meet no true event are false alarms: see ``false_alarms``.
    """
    met = _overlaps(found, truth, keys, bucket_us).groupBy("event_id").agg(F.count("*").alias("n_found"), F.sum("overlap_us").alias("overlap_us"))
    return truth.select("event_id").join(met, "event_id", "left").select("event_id", F.col("n_found").isNotNull().alias("hit"), F.coalesce("n_found", F.lit(0)).alias("n_found"), F.coalesce("overlap_us", F.lit(0)).alias("overlap_us"))


def false_alarms(found: DataFrame, truth: DataFrame, keys: list[str], *, bucket_us: int = DAY) -> DataFrame:
    """Detections that meet no true event."""
    met = _overlaps(found, truth, keys, bucket_us).select(*keys, "f0", "f1").distinct()
    return found.join(met.withColumnsRenamed({"f0": "start_us", "f1": "end_us"}), [*keys, "start_us", "end_us"], "left_anti")


def _overlaps(found: DataFrame, truth: DataFrame, keys: list[str], bucket_us: int) -> DataFrame:
    b = F.lit(bucket_us)

    def wide(df: DataFrame, lo: str, hi: str, cols: list[Column]) -> DataFrame:
        return df.select(*keys, *cols, F.explode(F.sequence(F.floor(F.col(lo) / b), F.floor(F.col(hi) / b))).alias("_b"))

    f = wide(found, "start_us", "end_us", [F.col("start_us").alias("f0"), F.col("end_us").alias("f1")])
    t = wide(truth, "start_us", "end_us", [F.col("event_id"), F.col("start_us").alias("t0"), F.col("end_us").alias("t1")])
    both = f.join(t, [*keys, "_b"]).where("f0 <= t1 and t0 <= f1").drop("_b").distinct()
    return both.withColumn("overlap_us", F.least("f1", "t1") - F.greatest("f0", "t0"))
