"""Areas under events and their ratios (our choices; no method is prescribed for them).

An area is the integral of a stream's enhancement over an event, the signal taken as straight between neighbouring samples: a
trapezoid cut by the event's edges counts with the part inside.  So each sample has a weight, an area is a weighted sum, and its
uncertainty has a random part, of independent samples, and a baseline part, common to all of them.  Steps longer than ``max_gap_us``
hold no area; what is covered is reported.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import DAY, previous


def event_areas(samples: DataFrame, events: DataFrame, keys: list[str], us: str, value: str, *, event: str = "event_no", sigma: str | None = None, common: str | None = None, max_gap_us: int, chunk_us: int = DAY) -> DataFrame:
    """keys, event, area (value times seconds), sigma_rand, sigma_base, covered_us, n of each of ``events`` (keys, event, start_us, end_us).

    ``sigma`` and ``common`` name the samples' random sigma and what they share, as the baseline's; without them these parts are 0, and
    they are null where a sample's is unknown.  Unknown values are stepped over.  Events of another stream take the samples of
    theirs by ``keys`` all the same: edges need no sample.  An event that no step meets has area 0 and covers nothing.
    """
    zero = F.lit(0.0)
    rows = samples.where(F.col(value).isNotNull()).select(*keys, us, F.struct(F.col(us).alias("t"), F.col(value).cast("double").alias("v"), (F.col(sigma).cast("double") if sigma else zero).alias("s"), (F.col(common).cast("double") if common else zero).alias("c")).alias("_b"))
    steps = previous(rows, keys, us, ["_b"], "_p", chunk_us=chunk_us).select(*keys, F.col("_p._b").alias("_a"), "_b")
    steps = steps.where((F.col("_b.t") > F.col("_a.t")) & (F.col("_b.t") - F.col("_a.t") <= max_gap_us))
    # a step meets an event in the bucket that its end is in; an event covers the buckets where such steps may end
    bucket = F.lit(max(chunk_us, max_gap_us))
    wide = events.select(*keys, event, F.col("start_us").alias("_lo"), F.col("end_us").alias("_hi"))
    wide = wide.withColumn("_k", F.explode(F.sequence(F.floor(F.col("_lo") / bucket), F.floor((F.col("_hi") + max_gap_us) / bucket))))
    t0, t1 = F.col("_a.t"), F.col("_b.t")
    met = steps.withColumn("_k", F.floor(t1 / bucket)).join(wide, [*keys, "_k"]).where((t1 > F.col("_lo")) & (t0 < F.col("_hi")))
    lo, hi, span = F.greatest(t0, F.col("_lo")), F.least(t1, F.col("_hi")), (t1 - t0).cast("double")
    late = (F.pow(hi - t0, 2) - F.pow(lo - t0, 2)) / (2 * span)  # what the later sample weighs, in us
    ends = F.array(F.struct(F.col("_a").alias("at"), ((hi - lo) - late).alias("w")), F.struct(F.col("_b").alias("at"), late.alias("w")))
    each = met.select(*keys, event, (hi - lo).alias("_span"), F.posexplode(ends).alias("_i", "_e"))
    by_sample = each.groupBy(*keys, event, F.col("_e.at").alias("_at")).agg((F.sum("_e.w") / 1e6).alias("w"), F.sum(F.when(F.col("_i") == 1, F.col("_span")).otherwise(0)).alias("_span"))
    w, known = F.col("w"), lambda c, x: F.when(F.count(c) == F.count("*"), x)
    s, c = F.col("_at.s"), F.col("_at.c")
    got = by_sample.groupBy(*keys, event).agg(F.sum(w * F.col("_at.v")).alias("area"), known(s, F.sqrt(F.sum(w * w * s * s))).alias("sigma_rand"), known(c, F.sum(w * c)).alias("sigma_base"), F.sum("_span").alias("covered_us"), F.count("*").alias("n"))
    out = events.select(*keys, event).join(got, [*keys, event], "left")
    none = F.col("n").isNull()
    return out.select(*keys, event, *(F.when(none, 0.0).otherwise(F.col(x)).alias(x) for x in ("area", "sigma_rand", "sigma_base")), *(F.coalesce(x, F.lit(0)).alias(x) for x in ("covered_us", "n")))


def net_areas(areas: DataFrame, links: DataFrame, keys: list[str], level: str, *, event: str = "event_no") -> DataFrame:
    """``areas`` with net_area, net_sigma_rand and n_children: an event's area less those of the events linked to it directly.

    ``links``: keys, child_level, child_no, parent_no, where a parent's level is the next.  An event is taken off its own parent
    only, whose whole area is taken off in turn one level up, so nets of a tree sum up to its root's area.  A nested event's
    samples are its parent's too: their random parts are taken off as variances.
    """
    child = areas.select(*keys, F.col(level).alias("child_level"), F.col(event).alias("child_no"), F.col("area").alias("_a"), F.col("sigma_rand").alias("_s"))
    inner = child.join(links, [*keys, "child_level", "child_no"]).groupBy(*keys, (F.col("child_level") + 1).alias(level), F.col("parent_no").alias(event)).agg(F.sum("_a").alias("_a"), F.sum(F.col("_s") * F.col("_s")).alias("_s2"), F.count("*").alias("n_children"))
    out = areas.join(inner, [*keys, level, event], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    zero = F.lit(0.0)
    return out.withColumn("net_area", F.col("area") - F.coalesce("_a", zero)).withColumn("net_sigma_rand", F.sqrt(F.greatest(zero, F.pow("sigma_rand", 2) - F.coalesce("_s2", zero)))).drop("_a", "_s2")


def area_ratios(x: DataFrame, y: DataFrame, keys: list[str], *, min_covered: float = 0.5) -> DataFrame:
    """keys, area_ratio and its sigma of the events that both have: y's area over x's, no pairing of samples needed.

    Both parts of both areas go into the sigma.  Null where x's area isn't above 0, or one side covers less than
    ``min_covered`` of what the other does.
    """
    side = lambda df, n: df.select(*keys, F.col("area").alias(f"_{n}"), F.sqrt(F.pow("sigma_rand", 2) + F.pow("sigma_base", 2)).alias(f"_s{n}"), F.col("covered_us").alias(f"_c{n}"))
    both = side(x, "x").join(side(y, "y"), keys)
    fit = (F.col("_x") > 0) & (F.least("_cx", "_cy") >= min_covered * F.greatest("_cx", "_cy"))
    r = F.when(fit, F.col("_y") / F.col("_x"))
    sigma = F.when(fit, F.sqrt(F.pow("_sy", 2) + r * r * F.pow("_sx", 2)) / F.col("_x"))
    return both.select(*keys, r.alias("area_ratio"), sigma.alias("sigma_area_ratio"))
