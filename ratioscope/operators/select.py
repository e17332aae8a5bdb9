"""Exact quantiles of groups of any size.

A group of up to ``most`` values is one aggregation, whose state is bounded by that size.  A larger one is searched: its values are
counted in equal bins between its least and its largest, the bins that hold the ranks asked for are kept and searched again, until
what is left of a bin is small or all equal.  A round's tables have a row a bin, and only kept bins' rows are written, so no task
ever holds a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import known
from ..scratch import Scratch

MOST = 1 << 20
BINS = 4096


def _ranked(rows: DataFrame, keys: list[str], ranks: DataFrame, scratch: Scratch, most: int, bins: int) -> DataFrame:
    """keys, _rank, _value: the values of ranks (from 0) in their groups; ``rows`` are keys, _v."""
    rows, goals = rows.withColumn("_cell", F.lit("")), ranks.withColumn("_cell", F.lit("")).withColumn("_left", F.col("_rank"))
    cell, found = [*keys, "_cell"], None
    v, lo, hi = F.col("_v") / 2, F.col("_min") / 2, F.col("_max") / 2  # halves: a difference of doubles stays finite
    for k in range(200):
        spans = scratch.write(rows.groupBy(*cell).agg(F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.count("*").alias("_n")), f"spans{k}")
        small = (F.col("_n") <= most) | (F.col("_min") == F.col("_max"))
        few = rows.join(spans.where(F.col("_n") <= most).select(*cell), cell).groupBy(*cell).agg(F.sort_array(F.collect_list("_v")).alias("_all"))
        at = goals.join(spans.where(small), cell).join(few, cell, "left")
        at = at.select(*keys, "_rank", F.when(F.col("_min") == F.col("_max"), F.col("_min")).otherwise(F.element_at("_all", (F.col("_left") + 1).cast("int"))).alias("_value"))
        found = at if found is None else found.unionByName(at)
        large = spans.where(~small)
        if not large.head(1):
            return found
        bin_of = F.least(F.lit(bins - 1), F.floor((v - lo) / (hi - lo) * bins)).alias("_bin")
        binned = rows.join(large.select(*cell, "_min", "_max"), cell).select(*cell, "_v", bin_of)
        hist = scratch.write(binned.groupBy(*cell, "_bin").agg(F.count("*").alias("_k")), f"bins{k}")
        before = F.sum("_k").over(Window.partitionBy(*cell).orderBy("_bin")) - F.col("_k")
        goals = goals.join(hist.withColumn("_before", before), cell).where("_left >= _before and _left < _before + _k")
        goals = scratch.write(goals.select(*keys, "_rank", (F.col("_left") - F.col("_before")).alias("_left"), "_cell", "_bin"), f"goals{k}")
        deeper = F.concat_ws(".", "_cell", F.col("_bin").cast("string")).alias("_cell")
        rows = scratch.write(binned.join(goals.select(*cell, "_bin").distinct(), [*cell, "_bin"], "left_semi").select(*keys, "_v", deeper), f"rows{k}")
        goals = goals.select(*keys, "_rank", "_left", deeper)
    raise AssertionError("200 rounds of 4096 bins part all doubles")


def quantiles(df: DataFrame, keys: list[str], values: dict[str, tuple[Column, list[float]]], *, most: int = MOST, bins: int = BINS, scratch: Scratch | None = None) -> DataFrame:
    """A row a key: for each of ``values`` (name: column, probabilities) an array of interpolated quantiles, null where no value is known.

    Unknown values (null, NaN, infinite) count nothing; keys whose values are all unknown keep their row.
    """
    scratch = scratch or Scratch(df.sparkSession, "quantiles")
    rows = scratch.write(df.select(*keys, *(known(c.cast("double")).alias(n) for n, (c, _) in values.items())), "values")
    sizes = rows.groupBy(*keys).agg(*(F.count(n).alias(n) for n in values))
    largest = sizes.agg(F.max(F.greatest(*values) if len(values) > 1 else F.col(next(iter(values))))).first()[0] or 0
    if largest <= most:
        return rows.groupBy(*keys).agg(*(F.percentile(n, F.array(*(F.lit(float(p)) for p in ps))).alias(n) for n, (_, ps) in values.items()))
    out = sizes = scratch.write(sizes, "sizes")
    out = out.select(*keys)
    for n, (_, ps) in values.items():
        own = rows.select(*keys, F.col(n).alias("_v")).where("_v is not null")
        place = [(F.col(n) - 1) * F.lit(float(p)) for p in ps]
        wanted = F.explode(F.array_distinct(F.array(*(x for p in place for x in (F.floor(p), F.ceil(p))))))
        got = _ranked(own, keys, sizes.where(F.col(n) > 0).select(*keys, wanted.alias("_rank")), scratch, most, bins)
        got = got.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_of"))  # two ranks a probability at most
        with_of = sizes.join(got, keys, "left")
        value = lambda p: F.col("_of")[F.floor(p)] + F.when(F.ceil(p) > F.floor(p), (F.col("_of")[F.ceil(p)] - F.col("_of")[F.floor(p)]) * (p - F.floor(p))).otherwise(0.0)
        out = out.join(with_of.select(*keys, F.when(F.col("_of").isNotNull(), F.array(*map(value, place))).alias(n)), keys)
    return out
