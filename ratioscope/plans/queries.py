"""Registered queries over the driver's tables, each with its SQL.

``events`` stands for native-rate data: event_type is the stream, ts its clock, value its reading.  Every query reads its
whole tables.  Results are rounded at the edge, on both sides alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geodesy, scalar, time
from ..operators import align, areas, circular, cluster, detect, masks, noise, ordered, profile, propagate, regress, select, states
from ..operators.baseline import baseline_sigma, baseline_sweep
from ..scratch import Scratch

SECOND = 1_000_000
HOUR = 3600 * SECOND
CHUNK = 120 * HOUR
KEYS = ["stream"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql.replace("$A", _NESTED_AREA).replace("$E", EVENTS)
        return f

    return keep


#: Trapezoids of samples' steps clipped to events, as weights of the samples.
_AREA = """
st AS (SELECT *, value - b AS v, lag({{'t': us, 'v': value - b, 's': 0.5 + 0.02 * value}}) OVER (PARTITION BY stream{more} ORDER BY us) AS a FROM {source} WHERE value - b IS NOT NULL),
m AS (SELECT st.*, x.event_no, least(st.us, hi) - greatest(a.t, lo) AS span, (pow(least(st.us, hi) - a.t, 2) - pow(greatest(a.t, lo) - a.t, 2)) / (2 * (st.us - a.t)) AS late FROM st JOIN x ON x.stream = st.stream{on} AND st.us > lo AND a.t < hi WHERE st.us > a.t AND st.us - a.t <= {gap}),
w AS (SELECT stream{more}, event_no, t, any_value(v) AS v, any_value(s) AS s, sum(w) / 1e6 AS w, sum(span) AS span FROM (SELECT stream{more}, event_no, us AS t, v, 0.5 + 0.02 * value AS s, late AS w, span FROM m UNION ALL SELECT stream{more}, event_no, a.t, a.v, a.s, span - late, 0 FROM m) GROUP BY ALL),
g AS (SELECT stream{more}, event_no, sum(w * v) AS area, sqrt(sum(w * w * s * s)) AS sigma_rand, sum(span)::BIGINT AS covered_us FROM w GROUP BY ALL)"""
_NESTED_AREA = _AREA.format(more=", level", source="bb", event="event_no", on=" AND x.level = st.level", gap=HOUR)

EVENTS = "(SELECT event_type AS stream, epoch_us(ts) AS us, event_id, user_id, value, props FROM events)"


def events(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    df = time.with_epoch(spark.read.parquet(f"{sf}/events.parquet").withColumnRenamed("event_type", "stream"), "ts")
    return df.select("stream", "us", "value", *cols)


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


_BASE = f"SELECT *, count(value) OVER w AS n_valid, quantile_cont(value, 0.05) OVER w AS b FROM $E WINDOW w AS (PARTITION BY stream ORDER BY us RANGE BETWEEN {6 * HOUR - 1} PRECEDING AND {6 * HOUR} FOLLOWING)"


@query(f"SELECT stream, event_id, round(CASE WHEN n_valid >= 2 THEN b END, 6) AS baseline, round(value - CASE WHEN n_valid >= 2 THEN b END, 6) AS enhancement FROM ({_BASE})")
def baseline_enhancement(spark, sf):
    b = baseline_sweep(events(spark, sf, "event_id"), KEYS, "us", "value", [12 * HOUR], [0.05], chunk_us=CHUNK)
    return r6(b, "baseline", "enhancement").select("stream", "event_id", "baseline", "enhancement")


def _sweep_sql() -> str:
    one = "SELECT stream, event_id, CAST({w} AS BIGINT) AS window_us, CAST({q} AS DOUBLE) AS quantile, round(CASE WHEN count(value) OVER v >= 2 THEN quantile_cont(value, {q}) OVER v END, 6) AS baseline FROM $E WINDOW v AS (PARTITION BY stream ORDER BY us RANGE BETWEEN {lo} PRECEDING AND {hi} FOLLOWING)"
    return " UNION ALL ".join(one.format(w=w, q=q, lo=w // 2 - 1, hi=w // 2) for w in (6 * HOUR, 24 * HOUR) for q in (0.01, 0.05, 0.1))


@query(_sweep_sql())
def baseline_windows(spark, sf):
    b = baseline_sweep(events(spark, sf, "event_id"), KEYS, "us", "value", [6 * HOUR, 24 * HOUR], [0.01, 0.05, 0.1], chunk_us=CHUNK)
    return r6(b, "baseline").select("stream", "event_id", "window_us", "quantile", "baseline")


_STEPS = "SELECT *, abs(value - lag(value) OVER (PARTITION BY stream ORDER BY us)) AS d FROM $E"


@query(f"SELECT stream, round(1.4826 * median(d) / sqrt(2), 6) AS sigma, count(value) AS n FROM ({_STEPS}) GROUP BY stream")
def diff_mad_noise(spark, sf):
    return r6(noise.diff_mad(events(spark, sf), KEYS, "us", "value", chunk_us=CHUNK), "sigma")


@query("SELECT stream, round(1.4826 * mad(value), 6) AS sigma, count(value) AS n FROM $E GROUP BY stream")
def mad_noise(spark, sf):
    return r6(noise.mad(events(spark, sf), KEYS, "us", "value"), "sigma")


@query(f"SELECT stream, event_id, round(greatest(1.4826 * median(d) OVER w / sqrt(2), 0.5 / sqrt(12)), 6) AS sigma FROM ({_STEPS}) WINDOW w AS (PARTITION BY stream ORDER BY us RANGE BETWEEN {12 * HOUR - 1} PRECEDING AND {12 * HOUR} FOLLOWING)")
def rolling_noise(spark, sf):
    out = noise.rolling_diff_mad(events(spark, sf, "event_id"), KEYS, "us", "value", 24 * HOUR, step=0.5, chunk_us=CHUNK)
    return r6(out, "sigma").select("stream", "event_id", "sigma")


_W12 = f"(PARTITION BY stream ORDER BY us RANGE BETWEEN {6 * HOUR - 1} PRECEDING AND {6 * HOUR} FOLLOWING)"


@query(f"SELECT stream, event_id, round(1.4826 * list_median(list_transform(l, lambda v: abs(v - list_median(l)))), 6) AS sigma FROM (SELECT *, list(value) OVER {_W12} AS l FROM $E)")
def rolling_mad_noise(spark, sf):
    return r6(noise.rolling_mad(events(spark, sf, "event_id"), KEYS, "us", "value", 12 * HOUR, chunk_us=CHUNK), "sigma").select("stream", "event_id", "sigma")


_CATALOG = f"""
WITH b AS ({_BASE}), s AS (SELECT *, 1.4826 * median(d) OVER (PARTITION BY stream) / sqrt(2) AS sigma FROM (SELECT *, abs(value - lag(value) OVER (PARTITION BY stream ORDER BY us)) AS d FROM b)),
c AS (SELECT *, CASE WHEN n_valid >= 2 THEN value - b END - 1.6448536269514722 * sigma AS delta FROM s),
t AS (SELECT *, coalesce(last_value(CASE WHEN delta > 1.0 * sigma THEN 1 WHEN delta < 0.3 * sigma THEN 0 END IGNORE NULLS) OVER (PARTITION BY stream ORDER BY us ROWS UNBOUNDED PRECEDING), 0) AS st FROM c),
i AS (SELECT *, sum(g) OVER (PARTITION BY stream ORDER BY us ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY stream ORDER BY us) > {HOUR} THEN 1 ELSE 0 END AS g FROM t WHERE st = 1)),
e AS (SELECT stream, min(us) AS start_us, arg_max(us, delta) AS peak_us, max(us) AS end_us, max(delta) AS amplitude, count(*) AS n FROM i GROUP BY stream, run HAVING max(us) - min(us) >= {60 * SECOND})
SELECT stream || '_' || lpad((row_number() OVER (PARTITION BY stream ORDER BY start_us) - 1)::VARCHAR, 5, '0') AS event_id, stream, make_timestamp(start_us) AS start_time, make_timestamp(peak_us) AS peak_time, make_timestamp(end_us) AS end_time, round(amplitude, 6) AS amplitude, n FROM e
"""


def _detected(spark, sf) -> DataFrame:
    ev = events(spark, sf)
    sig = noise.diff_mad(ev, KEYS, "us", "value", chunk_us=CHUNK).select("stream", "sigma")
    b = baseline_sweep(ev, KEYS, "us", "value", [12 * HOUR], [0.05], chunk_us=CHUNK).join(sig, "stream")
    b = b.withColumn("delta", detect.corrected(F.col("enhancement"), F.col("sigma"), 0.05))
    st = detect.in_event(b, KEYS, "us", F.col("delta"), F.col("sigma"), 1.0, 0.3, chunk_us=CHUNK)
    st = Scratch(spark, "states").write(st.select("stream", "us", "value", "delta", "state"), "states")
    return detect.events(st, KEYS, "us", "delta", "state", max_gap_us=HOUR, min_duration_us=60 * SECOND, chunk_us=CHUNK)


@query(_CATALOG)
def plume_catalog(spark, sf):
    return r6(detect.catalog(_detected(spark, sf), "stream"), "amplitude")


@query(f"SELECT stream, event_id, sum(g) OVER (PARTITION BY stream ORDER BY us ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY stream ORDER BY us) > {HOUR} THEN 1 ELSE 0 END AS g FROM $E)")
def gap_segments(spark, sf):
    return ordered.islands(events(spark, sf, "event_id"), KEYS, "us", HOUR, "segment", chunk_us=CHUNK).select("stream", "event_id", "segment")


@query("SELECT stream, event_id, round(value - lag(value) OVER (PARTITION BY stream ORDER BY us), 6) AS step, round(sum(value) OVER (PARTITION BY stream ORDER BY us ROWS UNBOUNDED PRECEDING), 4) AS total FROM $E")
def steps_and_sums(spark, sf):
    p = ordered.previous(events(spark, sf, "event_id"), KEYS, "us", ["value"], "p", chunk_us=CHUNK).select("stream", "us", "event_id", "value", (F.col("value") - F.col("p.value")).alias("step"))
    out = ordered.running_sum(p, KEYS, "us", F.col("value"), "total", chunk_us=CHUNK)
    return out.select("stream", "event_id", F.round("step", 6).alias("step"), F.round("total", 4).alias("total"))


@query(f"""
WITH s AS (SELECT *, sum(g) OVER (PARTITION BY stream ORDER BY us ROWS UNBOUNDED PRECEDING) AS seg FROM (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY stream ORDER BY us) > {2 * HOUR} THEN 1 ELSE 0 END AS g FROM $E)),
n AS (SELECT *, (row_number() OVER (PARTITION BY stream, seg ORDER BY us) - 1) // 16 AS b FROM s), f AS (SELECT stream, seg, b, list(value ORDER BY us) AS v, avg(value) AS m FROM n GROUP BY ALL HAVING count(*) = 16),
k AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY seg, b) - 1 AS block_id FROM f)
SELECT stream, block_id, unnest(generate_series(0, 15)) AS pos, round(unnest(v) - m, 6) + 0.0 AS value FROM k WHERE block_id < 2000
""")
def block_centre(spark, sf):
    b = profile.blocks(events(spark, sf), KEYS, "us", "value", 2 * HOUR, 16, 2000, chunk_us=CHUNK)
    return r6(b.select("stream", F.col("block_id").cast("long").alias("block_id"), F.posexplode("values").alias("pos", "value")).withColumn("pos", F.col("pos").cast("long")), "value").withColumn("value", F.col("value") + 0.0)


@query("""
WITH p AS (SELECT *, lag(value) OVER w AS v, lag(us) OVER w AS u FROM $E WINDOW w AS (PARTITION BY stream ORDER BY us)),
r AS (SELECT stream, coalesce(covar_pop(value, v) / nullif(stddev_pop(CASE WHEN v IS NOT NULL THEN value END) * stddev_pop(v), 0), 0) AS rho, median(us - u) / 1e6 AS dt FROM p GROUP BY stream)
SELECT stream, round(rho, 6) AS lag1_autocorr, round(dt, 6) AS sample_period_s, round(CASE WHEN rho > 0 AND rho < 1 THEN -dt / ln(rho) END, 3) AS tau_s FROM r
""")
def lag1_tau(spark, sf):
    ev = events(spark, sf)
    rho = profile.lag1(ev, KEYS, "us", "value", chunk_us=CHUNK)
    steps = ordered.previous(ev, KEYS, "us", ["us"], "p", chunk_us=CHUNK).select("stream", (F.col("us") - F.col("p.us")).alias("d"))
    dt = select.quantiles(steps, KEYS, {"m": (F.col("d"), [0.5])}).select("stream", (F.col("m")[0] / 1e6).alias("dt"))
    return rho.join(dt, "stream").select("stream", F.round("lag1_autocorr", 6).alias("lag1_autocorr"), F.round("dt", 6).alias("sample_period_s"), F.round(profile.ar1_timescale(F.col("lag1_autocorr"), F.col("dt")), 3).alias("tau_s"))


@query(f"""
WITH b AS (SELECT *, quantile_cont(value, 0.1) OVER w AS q FROM $E WINDOW w AS (PARTITION BY stream ORDER BY us RANGE BETWEEN {6 * HOUR - 1} PRECEDING AND {6 * HOUR} FOLLOWING)),
d AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY stream ORDER BY us)) AS d, us - lag(us) OVER (PARTITION BY stream ORDER BY us) AS dt, count(value) OVER {_W12} AS k FROM b)
SELECT stream AS name, round(1.4826 * mad(CASE WHEN k >= 2 THEN value - q END), 6) AS residual_sigma, round(1.4826 * median(d) / sqrt(2), 6) AS noise_sigma, round(median(CASE WHEN k >= 2 THEN q END), 6) AS background_median, round(quantile_cont(CASE WHEN k >= 2 THEN q END, 0.75) - quantile_cont(CASE WHEN k >= 2 THEN q END, 0.25), 6) AS background_iqr, round(median(dt) / 1e6, 6) AS sample_period_s, count(value) AS n_source_points FROM d GROUP BY stream
""")
def series_profile(spark, sf):
    p = profile.profile(events(spark, sf), "stream", "us", "value", window_us=12 * HOUR, quantile=0.10, block_length=16, chunk_us=CHUNK).stats
    cols = ("residual_sigma", "noise_sigma", "background_median", "background_iqr", "sample_period_s")
    return r6(p, *cols).select("name", *cols, "n_source_points")


@query("SELECT event_id, round(CASE WHEN value < 5 OR value > 200 THEN NULL ELSE value END, 6) AS value FROM events")
def qaqc_range(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.round(masks.range_mask(F.col("value"), 5.0, 200.0), 6).alias("value"))


@query("SELECT event_id, CASE WHEN (props::JSON->>'k')::INT IN (1, 2, 3) THEN NULL ELSE value END AS kept_by_bad, CASE WHEN (props::JSON->>'k')::INT IN (1, 2, 3) THEN value END AS kept_by_good FROM events")
def qaqc_flag(spark, sf):
    df = spark.read.parquet(f"{sf}/events.parquet").withColumn("k", F.get_json_object("props", "$.k"))
    return df.select("event_id", masks.flag_mask(F.col("value"), F.col("k"), bad=(1, 2, 3)).alias("kept_by_bad"), masks.flag_mask(F.col("value"), F.col("k"), good=(1, 2, 3)).alias("kept_by_good"))


@query(f"SELECT stream, event_id, CASE WHEN abs(value - list_median(l)) > 6 * 1.4826 * list_median(list_transform(l, lambda v: abs(v - list_median(l)))) THEN NULL ELSE value END AS value FROM (SELECT *, list(value) OVER {_W12} AS l FROM $E)")
def qaqc_spike(spark, sf):
    return masks.spike_mask(events(spark, sf, "event_id"), KEYS, "us", "value", 12 * HOUR, 6.0, chunk_us=CHUNK).select("stream", "event_id", "value")


@query("SELECT event_id, round(value * 1000 + 273.15, 6) AS value FROM events")
def unit_convert(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.round(scalar.convert(F.col("value"), 1000.0, 273.15), 6).alias("value"))


@query("SELECT event_id, round(sqrt(0.25 + pow(0.02 * value, 2)), 6) AS sigma, 'declared' AS source FROM events")
def declared_sigma(spark, sf):
    df = spark.read.parquet(f"{sf}/events.parquet").withColumn("s", scalar.declared_sigma(F.col("value"), 0.5, 0.02))
    return df.select("event_id", F.round("s", 6).alias("sigma"), scalar.source_label(F.col("s"), F.lit(None)).alias("source"))


@query("SELECT event_id, round(round_even(value / 0.5, 0) * 0.5, 6) AS q, round(fmod(value * 7 - 360, 360) + CASE WHEN fmod(value * 7 - 360, 360) < 0 THEN 360 ELSE 0 END, 6) AS angle FROM events")
def quantize(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.round(scalar.quantize(F.col("value"), 0.5), 6).alias("q"), F.round(scalar.wrap_angle(F.col("value") * 7 - 360), 6).alias("angle"))


@query("SELECT c_custkey, round((c_acctbal + 180) - 360 * floor((c_acctbal + 180) / 360) - 180, 6) AS lon, round(greatest(-90, least(90, c_acctbal / 50)), 6) AS lat, round(greatest(1.0, 111320 * cos(radians(greatest(-90, least(90, c_acctbal / 50))))), 6) AS m_per_deg FROM customer")
def wrap_longitude(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    lat = geodesy.clamp_latitude(F.col("c_acctbal") / 50)
    return c.select("c_custkey", F.round(geodesy.wrap_longitude(F.col("c_acctbal")), 6).alias("lon"), F.round(lat, 6).alias("lat"), F.round(geodesy.meters_per_degree_longitude(lat), 6).alias("m_per_deg"))


@query(f"""
WITH t AS (SELECT event_id, us FROM $E WHERE stream = 'click'), s AS (SELECT us, value FROM $E WHERE stream = 'view'),
a AS (SELECT t.event_id, t.us, s.us AS u0, s.value AS v0 FROM t ASOF LEFT JOIN s ON t.us >= s.us), b AS (SELECT t.event_id, s.us AS u1, s.value AS v1 FROM t ASOF LEFT JOIN s ON t.us <= s.us)
SELECT event_id, round(CASE WHEN u0 IS NULL OR u1 IS NULL THEN NULL WHEN u1 - u0 > {HOUR} THEN NULL WHEN u1 = u0 THEN v0 ELSE v0 + (v1 - v0) * ((us - u0) / (u1 - u0)) END, 6) AS guarded, round(CASE WHEN u0 IS NULL THEN v1 WHEN u1 IS NULL THEN v0 WHEN u1 = u0 THEN v0 ELSE v0 + (v1 - v0) * ((us - u0) / (u1 - u0)) END, 6) AS clamped
FROM a JOIN b USING (event_id)
""")
def aux_interp(spark, sf):
    ev = events(spark, sf, "event_id")
    t = ev.where("stream = 'click'").select("event_id", "us")
    s = ev.where("stream = 'view'").select("us", F.col("value").alias("guarded"))
    one = align.interpolate(t, s, [], "us", ["guarded"], max_gap_us=HOUR, clamp=False, chunk_us=CHUNK)
    two = align.interpolate(t, s.withColumnRenamed("guarded", "clamped"), [], "us", ["clamped"], chunk_us=CHUNK)
    return r6(one.join(two.select("event_id", "clamped"), "event_id"), "guarded", "clamped").select("event_id", "guarded", "clamped")


@query(f"""
WITH s AS (SELECT us, value AS y FROM $E WHERE stream = 'purchase'), f AS (SELECT us, value AS x FROM $E WHERE stream <> 'purchase')
SELECT s.us, round(avg(x), 6) AS x, round(y, 6) AS y, count(x) AS n_native FROM s JOIN f ON f.us >= s.us - {10 * 60 * SECOND} AND f.us < s.us + {10 * 60 * SECOND} GROUP BY s.us, y
""")
def pair_fast_slow(spark, sf):
    ev = events(spark, sf)
    out = align.pair(ev.where("stream != 'purchase'").select("us", "value"), ev.where("stream = 'purchase'").select("us", F.col("value").alias("v")), [], "us", "value", "v", 20 * 60 * SECOND)
    return r6(out, "x", "y")


_GRID = f"""
WITH c AS (SELECT unnest(generate_series(min(us) // {HOUR} * {HOUR}, max(us), {HOUR})) AS cell_us FROM $E), k AS (SELECT DISTINCT stream FROM $E),
b AS (SELECT stream, us // {HOUR} * {HOUR} AS cell_us, avg(value) AS value, count(value) AS n_native FROM $E GROUP BY ALL),
g AS (SELECT k.stream, c.cell_us, b.value, coalesce(b.n_native, 0) AS n_native FROM k CROSS JOIN c LEFT JOIN b ON b.stream = k.stream AND b.cell_us = c.cell_us)
"""


def _span(ev: DataFrame) -> tuple[int, int]:
    """The table's own span, from a whole hour on."""
    lo, hi = ev.agg(F.min("us"), F.max("us")).first()
    return (0, 0) if lo is None else (lo // HOUR * HOUR, hi + 1)


def _grid(spark, sf) -> DataFrame:
    ev = events(spark, sf)
    return align.output_grid(ev, KEYS, "us", "value", HOUR, *_span(ev))


@query(_GRID + "SELECT stream, cell_us, round(value, 6) AS value, n_native FROM g")
def output_grid(spark, sf):
    return r6(_grid(spark, sf), "value")


@query(_GRID.replace("avg(value) AS value,", "median(value) AS value, sqrt(sum(pow(0.5 + 0.02 * value, 2))) / count(value) * sqrt(pi() / 2) AS sigma_rand, avg(0.01 * value) AS sigma_sys,").replace("b.value, coalesce", "b.value, b.sigma_rand, b.sigma_sys, coalesce") + "SELECT stream, cell_us, round(value, 6) AS value, round(sigma_rand, 6) AS sigma_rand, round(sigma_sys, 6) AS sigma_sys, n_native FROM g")
def output_grid_sigma(spark, sf):
    ev = events(spark, sf).withColumn("sigma_rand", 0.5 + 0.02 * F.col("value")).withColumn("sigma_sys", 0.01 * F.col("value"))
    return r6(align.output_grid(ev, KEYS, "us", "value", HOUR, *_span(ev), statistic="median", sigma_rand="sigma_rand", sigma_sys="sigma_sys"), "value", "sigma_rand", "sigma_sys")


@query(_GRID.replace("avg(value) AS value,", "fmod(degrees(atan2(avg(sin(radians(value * 3))), avg(cos(radians(value * 3))))) + 360, 360) AS value,") + "SELECT stream, cell_us, round(value, 4) AS value, n_native FROM g")
def output_grid_circular(spark, sf):
    ev = events(spark, sf).withColumn("value", F.col("value") * 3)
    return align.output_grid(ev, KEYS, "us", "value", HOUR, *_span(ev), statistic="circular").withColumn("value", F.round("value", 4))


_STREAMS = ["click", "error", "purchase", "signup", "view"]


@query(_GRID + "SELECT cell_us, " + ", ".join(f"round(max(CASE WHEN stream = '{s}' THEN value END), 6) AS {s}_value, max(CASE WHEN stream = '{s}' THEN n_native END) AS {s}_n_native" for s in _STREAMS) + " FROM g GROUP BY cell_us")
def pmf_matrix(spark, sf):
    return r6(align.pmf_matrix(_grid(spark, sf), "stream", "value", _STREAMS), *(f"{s}_value" for s in _STREAMS))


_BINS = f"SELECT stream, us // {6 * HOUR} AS bin, value, sqrt(0.25 + pow(0.02 * value, 2)) AS s, 0.01 * value AS y FROM $E"


def _bins(spark, sf) -> DataFrame:
    ev = events(spark, sf).withColumn("bin", F.floor(F.col("us") / F.lit(6 * HOUR)))
    return ev.withColumn("s", scalar.declared_sigma(F.col("value"), 0.5, 0.02)).withColumn("y", F.lit(0.01) * F.col("value"))


@query(f"SELECT stream, bin, round(sqrt(sum(s * s)) / count(s), 6) AS random, round(sqrt(1 / sum(1 / (s * s))), 6) AS weighted, round(sum(value / (s * s)) / sum(1 / (s * s)), 6) AS mean, round(sqrt(sum(s * s)) / count(s) * sqrt(pi() / 2), 6) AS random_median FROM ({_BINS}) GROUP BY stream, bin")
def sigma_mean_random(spark, sf):
    s = F.col("s")
    out = _bins(spark, sf).groupBy("stream", "bin").agg(propagate.random_of_mean(s).alias("random"), propagate.random_of_weighted_mean(s).alias("weighted"), propagate.weighted_mean(F.col("value"), s).alias("mean"), propagate.random_of_median(s).alias("random_median"))
    return r6(out, "random", "weighted", "mean", "random_median")


@query(f"SELECT stream, bin, round(avg(y), 6) AS systematic, round(sum(y / (s * s)) / sum(1 / (s * s)), 6) AS weighted FROM ({_BINS}) GROUP BY stream, bin")
def sigma_mean_systematic(spark, sf):
    out = _bins(spark, sf).groupBy("stream", "bin").agg(propagate.systematic_of_mean(F.col("y")).alias("systematic"), propagate.systematic_of_weighted_mean(F.col("y"), F.col("s")).alias("weighted"))
    return r6(out, "systematic", "weighted")


@query(f"SELECT stream, bin, round(least(n, greatest(1, n * (1 - rho) / (1 + rho))), 6) AS n_eff FROM (SELECT *, exp(-({6 * 3600}.0 / n) / 1800.0) AS rho FROM (SELECT stream, us // {6 * HOUR} AS bin, count(value) AS n FROM $E GROUP BY ALL))")
def neff(spark, sf):
    n = _bins(spark, sf).groupBy("stream", "bin").agg(F.count("value").alias("n"))
    return n.select("stream", "bin", F.round(propagate.effective_n(F.col("n"), F.lit(21600.0) / F.col("n"), 1800.0), 6).alias("n_eff"))


@query(f"SELECT a.stream, a.bin, round(sqrt(sum(a.s * b.s * exp(-abs(a.us - b.us) / 1.8e9))) / sqrt(count(*)), 6) AS sigma_mean FROM (SELECT *, us // {HOUR} AS bin, sqrt(0.25 + pow(0.02 * value, 2)) AS s FROM $E) a JOIN (SELECT *, us // {HOUR} AS bin, sqrt(0.25 + pow(0.02 * value, 2)) AS s FROM $E) b USING (stream, bin) GROUP BY ALL")
def sigma_mean_exact(spark, sf):
    ev = events(spark, sf).withColumn("bin", F.floor(F.col("us") / F.lit(HOUR))).withColumn("s", scalar.declared_sigma(F.col("value"), 0.5, 0.02))
    return r6(propagate.exact_random_of_mean(ev, ["stream", "bin"], "us", "s", 1800.0), "sigma_mean")


@query("SELECT l_returnflag, l_linestatus, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, count(*) AS n FROM lineitem GROUP BY ALL")
def ols_ratio(spark, sf):
    out = regress.ols(spark.read.parquet(f"{sf}/lineitem.parquet"), ["l_returnflag", "l_linestatus"], "l_quantity", "l_extendedprice")
    return out.select("l_returnflag", "l_linestatus", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"), F.round("r2", 6).alias("r2"), "n")


def _york_sql(rounds: int = 14) -> str:
    head = "p AS (SELECT l_returnflag AS g, l_quantity + 20 * l_discount AS x, 0.5 * l_quantity + 20 * l_tax AS y, 1 / pow(0.5 + 0.02 * l_quantity, 2) AS wx, 1 / pow(0.4 + 0.01 * l_quantity, 2) AS wy FROM lineitem), b0 AS (SELECT g, regr_slope(y, x) AS b FROM p GROUP BY g)"
    w = "wx * wy / (wx + b * b * wy)"
    step = ", m{k} AS (SELECT g, b, sum({w} * x) / sum({w}) AS xm, sum({w} * y) / sum({w}) AS ym FROM p JOIN b{k} USING (g) GROUP BY g, b), b{n} AS (SELECT g, sum(v * t * (y - ym)) / sum(v * t * (x - xm)) AS b FROM (SELECT *, {w} AS v, {w} * ((x - xm) / wy + b * (y - ym) / wx) AS t FROM p JOIN m{k} USING (g)) GROUP BY g)"
    body = head + "".join(step.format(k=k, n=k + 1, w=w) for k in range(rounds))
    last = step.split(", b{n}")[0].format(k=rounds, w=w)
    return f"WITH {body}{last}, e AS (SELECT *, {w} AS v, {w} * ((x - xm) / wy + b * (y - ym) / wx) AS t FROM p JOIN m{rounds} USING (g)) SELECT g AS l_returnflag, round(any_value(b), 6) AS slope, round(any_value(ym - b * xm), 5) AS intercept, round(sqrt(1 / (sum(v * t * t) - sum(v * t) * sum(v * t) / sum(v))), 7) AS sigma_slope, round(sum(v * pow(y - b * x - (ym - b * xm), 2)) / (count(*) - 2), 6) AS goodness, count(*) AS n FROM e GROUP BY g"


@query(_york_sql())
def york_ratio(spark, sf):
    l = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_returnflag", (F.col("l_quantity") + 20 * F.col("l_discount")).alias("x"), (0.5 * F.col("l_quantity") + 20 * F.col("l_tax")).alias("y"), (0.5 + 0.02 * F.col("l_quantity")).alias("sx"), (0.4 + 0.01 * F.col("l_quantity")).alias("sy"))
    f = regress.ratios(regress.york(l, ["l_returnflag"]))
    return f.select("l_returnflag", F.round("slope", 6).alias("slope"), F.round("intercept", 5).alias("intercept"), F.round("sigma_slope", 7).alias("sigma_slope"), F.round("goodness", 6).alias("goodness"), "n")


@query("""
WITH f AS (SELECT o_orderpriority AS g, date_trunc('month', o_orderdate) AS m, regr_slope(l_extendedprice, l_quantity) AS b, count(*) AS n, regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_syy(l_extendedprice, l_quantity) AS syy, regr_sxy(l_extendedprice, l_quantity) AS sxy FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
s AS (SELECT *, sqrt(greatest(0, syy - b * sxy) / (n - 2) / sxx) AS e FROM f WHERE n > 2 AND sxx > 0), w AS (SELECT g, b, e, sum(b / (e * e)) OVER (PARTITION BY g) / sum(1 / (e * e)) OVER (PARTITION BY g) AS mean FROM s WHERE e > 0)
SELECT g AS o_orderpriority, round(sqrt(sum(pow(b - mean, 2) / (e * e)) / nullif(count(*) - 1, 0)), 6) AS birge, round(any_value(mean), 3) AS mean, count(*) AS k FROM w GROUP BY g
""")
def birge_ratio(spark, sf):
    l = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_quantity", "l_extendedprice")
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority", F.date_trunc("month", "o_orderdate").alias("m"))
    fits = regress.ols(l.join(o, "l_orderkey"), ["o_orderpriority", "m"], "l_quantity", "l_extendedprice")
    return regress.birge(fits, ["o_orderpriority"]).select("o_orderpriority", F.round("birge", 6).alias("birge"), F.round("mean", 3).alias("mean"), F.col("n_fits").alias("k"))


@query("SELECT stream, round(fmod(degrees(atan2(s, c)) + 360, 360), 6) AS direction, round(degrees(sqrt(-2 * ln(least(1, sqrt(s * s + c * c))))), 6) AS sd, round(degrees(asin(sqrt(1 - (s * s + c * c))) * (1 + (2 / sqrt(3) - 1) * pow(1 - (s * s + c * c), 1.5))), 6) AS yamartino FROM (SELECT stream, avg(sin(radians(value * 3))) AS s, avg(cos(radians(value * 3))) AS c FROM $E GROUP BY stream)")
def circular_mean(spark, sf):
    a = F.col("value") * 3
    out = events(spark, sf).groupBy("stream").agg(circular.circular_mean(a).alias("direction"), circular.circular_sd(a).alias("sd"), circular.yamartino_sd(a).alias("yamartino"))
    return r6(out, "direction", "sd", "yamartino")


@query("SELECT user_id, stream, event_id, us, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, stream ORDER BY us DESC, event_id DESC) AS k FROM $E) WHERE k = 1")
def dedupe_latest(spark, sf):
    return ordered.latest(events(spark, sf, "user_id", "event_id"), ["user_id", "stream"], ["us", "event_id"]).select("user_id", "stream", "event_id", "us", "value")


_PLACE = "SELECT event_id AS id, 40 + (user_id % 50) * 0.001 AS lat, -110 + value * 0.0001 AS lon, us FROM $E"


@query(f"SELECT a.id AS a, b.id AS b, round(sqrt(pow((a.lon - b.lon) * greatest(1.0, 111320 * cos(radians(a.lat))), 2) + pow((a.lat - b.lat) * 111320, 2) + pow((a.us - b.us) / 1e6 * 0.5, 2)), 4) AS distance_m FROM ({_PLACE}) a JOIN ({_PLACE}) b ON a.id < b.id AND abs(a.us - b.us) <= {1000 * SECOND} AND abs(a.lat - b.lat) <= 0.005 WHERE sqrt(pow((a.lon - b.lon) * greatest(1.0, 111320 * cos(radians(a.lat))), 2) + pow((a.lat - b.lat) * 111320, 2) + pow((a.us - b.us) / 1e6 * 0.5, 2)) <= 500")
def space_time_neighbours(spark, sf):
    p = events(spark, sf, "event_id", "user_id").select("event_id", (40 + (F.col("user_id") % 50) * 0.001).alias("lat"), (F.lit(-110.0) + F.col("value") * 0.0001).alias("lon"), "us")
    return cluster.neighbours(p, "event_id", "lat", "lon", "us", 500.0, 0.5).select("a", "b", F.round("distance_m", 4).alias("distance_m"))


_DIST = "sqrt(pow((a.lon - b.lon) * greatest(1.0, 111320 * cos(radians(a.lat))), 2) + pow((a.lat - b.lat) * 111320, 2) + pow((a.us - b.us) / 1e6 * 0.5, 2))"


@query(f"""
WITH RECURSIVE p AS MATERIALIZED ({_PLACE}), n AS MATERIALIZED (SELECT a.id AS a, b.id AS b, {_DIST} AS d FROM p a JOIN p b ON a.id < b.id AND abs(a.us - b.us) <= {600 * SECOND} AND abs(a.lat - b.lat) <= 0.003 WHERE {_DIST} <= 300),
both_ways AS MATERIALIZED (SELECT a, b, d FROM n UNION ALL SELECT b, a, d FROM n), c AS MATERIALIZED (SELECT a AS id FROM both_ways GROUP BY a HAVING count(*) + 1 >= 3),
link AS MATERIALIZED (SELECT a, b FROM both_ways WHERE a IN (SELECT id FROM c) AND b IN (SELECT id FROM c)), reach(id, root) AS (SELECT id, id FROM c UNION SELECT l.b, r.root FROM reach r JOIN link l ON l.a = r.id WHERE r.root < l.b),
home AS (SELECT id, min(root) AS cluster FROM reach GROUP BY id), edge AS (SELECT a AS id, arg_min(cluster, row(d, b)) AS cluster FROM both_ways JOIN home ON home.id = b GROUP BY a)
SELECT p.id AS event_id, coalesce(home.cluster, edge.cluster, -1) AS cluster, home.id IS NOT NULL AS core FROM p LEFT JOIN home USING (id) LEFT JOIN edge ON edge.id = p.id
""")
def space_time_clusters(spark, sf):
    p = events(spark, sf, "event_id", "user_id").select("event_id", (40 + (F.col("user_id") % 50) * 0.001).alias("lat"), (F.lit(-110.0) + F.col("value") * 0.0001).alias("lon"), "us")
    found = cluster.dbscan(p, "event_id", "lat", "lon", "us", eps_m=300.0, m_per_s=0.5, min_samples=3)
    return found.withColumn("cluster", F.coalesce("cluster", F.lit(-1)))  # -1: noise


@query(f"SELECT p.stream, count(*) AS n, round(sum(p.value), 4) AS total FROM $E p WHERE NOT EXISTS (SELECT 1 FROM $E o WHERE o.stream = 'error' AND o.value > 100 AND p.us >= o.us AND p.us < o.us + {HOUR}) GROUP BY p.stream")
def outage_delete(spark, sf):
    ev = events(spark, sf)
    gone = ev.where("stream = 'error' and value > 100").select(F.col("us").alias("lo"), (F.col("us") + HOUR).alias("hi"))
    kept = ordered.range_join(gone, ev, "lo", "hi", "us", HOUR, how="left_anti")
    return kept.groupBy("stream").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def _events_sql(name: str, window: int, q: float, enter: float) -> str:
    """Chain of tables that ends with the events ``name``_e of one cell of a sweep; noise in a day about each sample, table ``noise``."""
    z = scalar.quantile_offset(q)
    w = f"(PARTITION BY stream ORDER BY us RANGE BETWEEN {window // 2 - 1} PRECEDING AND {window // 2} FOLLOWING)"
    return f"""
{name}_b AS (SELECT *, CASE WHEN count(value) OVER {w} >= 2 THEN value - quantile_cont(value, {q}) OVER {w} END - {z!r} * sigma AS delta FROM noise),
{name}_t AS (SELECT *, coalesce(last_value(CASE WHEN delta > {enter} * sigma THEN 1 WHEN delta < 0.3 * sigma THEN 0 END IGNORE NULLS) OVER (PARTITION BY stream ORDER BY us ROWS UNBOUNDED PRECEDING), 0) AS st FROM {name}_b),
{name}_i AS (SELECT *, sum(g) OVER (PARTITION BY stream ORDER BY us ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY stream ORDER BY us) > {HOUR} THEN 1 ELSE 0 END AS g FROM {name}_t WHERE st = 1)),
{name}_r AS (SELECT stream, {window}::BIGINT AS window_us, {q}::DOUBLE AS quantile, {enter}::DOUBLE AS enter_sigma, min(us) AS start_us, arg_max(us, delta) AS peak_us, max(us) AS end_us, max(delta) AS amplitude, count(*) AS n FROM {name}_i GROUP BY stream, run HAVING max(us) - min(us) >= {60 * SECOND}),
{name}_e AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY start_us) - 1 AS event_no FROM {name}_r)"""


_NOISE = f"WITH noise AS (SELECT *, 1.4826 * median(d) OVER (PARTITION BY stream ORDER BY us RANGE BETWEEN {12 * HOUR - 1} PRECEDING AND {12 * HOUR} FOLLOWING) / sqrt(2) AS sigma FROM ({_STEPS}))"
_CELLS = [(f"c{i}", w, q, e) for i, (w, q, e) in enumerate((w, q, e) for w in (12 * HOUR, 24 * HOUR) for q in (0.05, 0.1) for e in (1.0, 2.0))]


@query(
    f"""
{_NOISE},{_events_sql("s", 12 * HOUR, 0.05, 1.0)},{_events_sql("l", 48 * HOUR, 0.05, 1.0)}
SELECT s.stream, 0::BIGINT AS child_level, s.event_no AS child_no, arg_min(l.event_no, row(l.end_us - l.start_us, l.event_no)) AS parent_no FROM s_e s JOIN l_e l ON l.stream = s.stream AND s.start_us >= l.start_us AND s.end_us <= l.end_us GROUP BY s.stream, s.event_no
"""
)
def nested_links(spark, sf):
    from ..operators.sweep import detection_sweep

    ev = detection_sweep(events(spark, sf), KEYS, "us", "value", windows_us=[12 * HOUR, 48 * HOUR], quantiles=[0.05], enter=[1.0], leave=0.3, noise_window_us=24 * HOUR, max_gap_us=HOUR, min_duration_us=60 * SECOND, chunk_us=CHUNK)
    ev = Scratch(spark, "nested").write(ev.withColumn("level", F.when(F.col("window_us") == 12 * HOUR, 0).otherwise(1)), "events")
    return detect.nested_links(ev, KEYS, "level").withColumn("child_level", F.col("child_level").cast("long"))


@query(
    _CATALOG.split("t AS (SELECT")[0].replace("WITH b AS", "WITH RECURSIVE b AS")
    + """
q AS (SELECT stream, us, event_id, row_number() OVER (PARTITION BY stream ORDER BY us) AS i, coalesce(pow(delta / sigma, 2) / 2 - pow((delta / sigma - 4) / 3, 2) / 2 - ln(3), 0) AS e FROM c),
f AS (SELECT stream, i, ln(0.02) - ln(0.98) + e AS d FROM q WHERE i = 1 UNION ALL SELECT q.stream, q.i, least(greatest(d + ln(0.9) - ln(0.98), ln(0.02) - ln(0.98)), ln(0.9) - ln(0.1)) + q.e FROM f JOIN q ON q.stream = f.stream AND q.i = f.i + 1),
g AS (SELECT stream, max(i) AS i, 0.0::DOUBLE AS d FROM q GROUP BY stream UNION ALL SELECT g.stream, g.i - 1, least(greatest(d + q.e + ln(0.9) - ln(0.98), ln(0.1) - ln(0.98)), ln(0.9) - ln(0.02)) FROM g JOIN q ON q.stream = g.stream AND q.i = g.i WHERE g.i > 1)
SELECT q.stream, q.event_id, (f.d + g.d > 0)::INT AS state FROM q JOIN f USING (stream, i) JOIN g USING (stream, i)"""
)
def hmm_states(spark, sf):
    ev = events(spark, sf, "event_id")
    sig = noise.diff_mad(ev, KEYS, "us", "value", chunk_us=CHUNK).select("stream", "sigma")
    b = baseline_sweep(ev, KEYS, "us", "value", [12 * HOUR], [0.05], chunk_us=CHUNK).join(sig, "stream")
    b = b.withColumn("delta", detect.corrected(F.col("enhancement"), F.col("sigma"), 0.05)).select("stream", "us", "event_id", "delta", "sigma")
    return states.hmm_states(b, KEYS, "us", F.col("delta"), F.col("sigma"), enter=0.02, leave=0.1, chunk_us=CHUNK).select("stream", "event_id", "state")


@query(f"""
WITH p AS (SELECT stream, us, event_id, value - 50 AS v, 5 + 0.1 * value AS s FROM $E),
k AS (SELECT a.stream, a.us, a.event_id, sum(w * b.v / (b.s * b.s)) AS kv, sum(w * w / (b.s * b.s)) AS kk FROM p a JOIN (SELECT * FROM p) b ON b.stream = a.stream AND b.us BETWEEN a.us - {2 * HOUR} AND a.us + {2 * HOUR}, LATERAL (SELECT exp(-pow((b.us - a.us) / 1e6 / 1800, 2) / 2) AS w) GROUP BY ALL),
c AS (SELECT stream, us, event_id, kv / sqrt(kk) AS score, kv / kk AS amplitude FROM k)
SELECT stream, event_id, round(score, 6) AS score, round(amplitude, 5) AS amplitude FROM c WHERE score >= 1.5 AND NOT EXISTS (SELECT 1 FROM c o WHERE o.stream = c.stream AND o.us BETWEEN c.us - {HOUR} AND c.us + {HOUR} AND o.score > c.score)
""")
def matched_filter(spark, sf):
    from ..functions.shapes import Kernel

    ev = events(spark, sf, "event_id").withColumn("v", F.col("value") - 50).withColumn("s", 5 + F.lit(0.1) * F.col("value"))
    out = states.matched_peaks(ev, KEYS, "us", "v", "s", Kernel.build(1800.0), threshold=1.5, apart_us=HOUR, chunk_us=CHUNK)
    return out.select("stream", "event_id", F.round("score", 6).alias("score"), F.round("amplitude", 5).alias("amplitude"))


@query(f"""
WITH RECURSIVE v AS (SELECT stream, us // {2 * HOUR} * {2 * HOUR} AS us, avg(value) AS x FROM $E GROUP BY ALL),
g AS (SELECT *, sum(g) OVER (PARTITION BY stream ORDER BY us ROWS UNBOUNDED PRECEDING)::BIGINT AS seg FROM (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY stream ORDER BY us) > {2 * HOUR} THEN 1 ELSE 0 END AS g FROM v)),
h AS (SELECT *, x - first_value(x) OVER (PARTITION BY stream, seg ORDER BY us) AS y FROM g),
p AS (SELECT *, sum(y) OVER o AS s1, sum(y * y) OVER o AS s2 FROM h WINDOW o AS (PARTITION BY stream, seg ORDER BY us ROWS UNBOUNDED PRECEDING)),
l AS MATERIALIZED (SELECT stream, seg, count(*) AS n, list_prepend(0.0, list(s1 ORDER BY us)) AS s1, list_prepend(0.0, list(s2 ORDER BY us)) AS s2, list(us ORDER BY us) AS us, list(x ORDER BY us) AS x FROM p GROUP BY ALL),
r AS (SELECT stream, seg, 0 AS i, [-6.0::DOUBLE] AS f, CAST([] AS BIGINT[]) AS b FROM l
  UNION ALL SELECT stream, seg, i + 1, list_append(f, list_min(c)), list_append(b, list_position(c, list_min(c)))
  FROM (SELECT r.*, list_transform(range(1, i + 2), lambda j: f[j] + 6 + (s2[i + 2] - s2[j] - pow(s1[i + 2] - s1[j], 2) / (i + 2 - j)) / 225) AS c FROM r JOIN l USING (stream, seg) WHERE i < n)),
e AS (SELECT stream, seg, n AS hi, b[n] AS lo, b FROM r JOIN l USING (stream, seg) WHERE i = n UNION ALL SELECT stream, seg, lo - 1, b[lo - 1], b FROM e WHERE lo > 1)
SELECT stream, seg AS segment, us[lo] AS start_us, us[hi] AS end_us, round(list_avg(x[lo:hi]), 6) AS level, hi - lo + 1 AS n FROM e JOIN l USING (stream, seg)
""")
def change_points(spark, sf):
    """Two-hourly means, cut into parts of 100 samples."""
    from ..operators.changes import change_points as pieces

    bins = events(spark, sf).groupBy("stream", (F.floor(F.col("us") / F.lit(2 * HOUR)) * (2 * HOUR)).alias("us")).agg(F.avg("value").alias("value")).withColumn("s", F.lit(15.0))
    return r6(pieces(bins, KEYS, "us", "value", "s", penalty=6.0, max_gap_us=2 * HOUR, part_rows=100, chunk_us=CHUNK), "level")


def _nested_levels_sql(level: int, name: str, window: int) -> str:
    w = f"(PARTITION BY stream ORDER BY us RANGE BETWEEN {window // 2 - 1} PRECEDING AND {window // 2} FOLLOWING)"
    return f"SELECT stream, {level} AS level, us, value, quantile_cont(value, 0.05) OVER {w} AS b FROM $E"


@query(
    f"""
{_NOISE},{_events_sql("s", 12 * HOUR, 0.05, 1.0)},{_events_sql("l", 48 * HOUR, 0.05, 1.0)},
x AS (SELECT stream, 0 AS level, event_no, start_us AS lo, end_us AS hi FROM s_e UNION ALL SELECT stream, 1, event_no, start_us, end_us FROM l_e),
bb AS ({_nested_levels_sql(0, "s", 12 * HOUR)} UNION ALL {_nested_levels_sql(1, "l", 48 * HOUR)}),"""
    + "$A"
    + """, k AS (SELECT s.stream, s.event_no AS child_no, arg_min(l.event_no, row(l.end_us - l.start_us, l.event_no)) AS event_no FROM s_e s JOIN l_e l ON l.stream = s.stream AND s.start_us >= l.start_us AND s.end_us <= l.end_us GROUP BY s.stream, s.event_no),
z AS (SELECT x.stream, x.level, x.event_no, coalesce(area, 0) AS area FROM x LEFT JOIN g USING (stream, level, event_no)),
i AS (SELECT k.stream, k.event_no, sum(z.area) AS inner_area, count(*) AS n FROM k JOIN z ON z.stream = k.stream AND z.event_no = k.child_no AND z.level = 0 GROUP BY ALL)
SELECT z.stream, z.level, z.event_no, round(z.area, 4) AS area, round(z.area - CASE WHEN z.level = 1 THEN coalesce(inner_area, 0) ELSE 0 END, 4) AS net_area, CASE WHEN z.level = 1 THEN coalesce(i.n, 0) ELSE 0 END AS n_children FROM z LEFT JOIN i ON i.stream = z.stream AND i.event_no = z.event_no
"""
)
def net_areas(spark, sf):
    from ..operators.sweep import detection_sweep

    windows = [12 * HOUR, 48 * HOUR]
    level = F.when(F.col("window_us") == windows[0], 0).otherwise(1).alias("level")
    found = detection_sweep(events(spark, sf), KEYS, "us", "value", windows_us=windows, quantiles=[0.05], enter=[1.0], leave=0.3, noise_window_us=24 * HOUR, max_gap_us=HOUR, min_duration_us=60 * SECOND, chunk_us=CHUNK)
    found = Scratch(spark, "nested").write(found.withColumn("level", level), "events")
    base = baseline_sweep(events(spark, sf), KEYS, "us", "value", windows, [0.05], chunk_us=CHUNK).withColumn("level", level)
    own = areas.event_areas(base, found, ["stream", "level"], "us", "enhancement", max_gap_us=HOUR, chunk_us=CHUNK)
    out = areas.net_areas(own, detect.nested_links(found, KEYS, "level"), KEYS, "level")
    return out.select("stream", "level", "event_no", F.round("area", 4).alias("area"), F.round("net_area", 4).alias("net_area"), "n_children")


@query(_NOISE + "".join("," + _events_sql(*c) for c in _CELLS) + " UNION ALL ".join(f" SELECT stream, window_us, quantile, enter_sigma, start_us, peak_us, end_us, round(amplitude, 6) AS amplitude, n, event_no FROM {c[0]}_e" for c in _CELLS))
def detection_sweep(spark, sf):
    from ..operators.sweep import detection_sweep as sweep

    out = sweep(events(spark, sf), KEYS, "us", "value", windows_us=[12 * HOUR, 24 * HOUR], quantiles=[0.05, 0.1], enter=[1.0, 2.0], leave=0.3, noise_window_us=24 * HOUR, max_gap_us=HOUR, min_duration_us=60 * SECOND, chunk_us=CHUNK)
    return r6(out, "amplitude")


@query(_CATALOG.split("SELECT stream || ")[0].replace("1.6448536269514722 * sigma", "1.6448536269514722 * s").replace("1.4826 * median(d) OVER (PARTITION BY stream) / sqrt(2) AS sigma", "0.5 + 0.05 * value AS s, 0.5 + 0.05 * value AS sigma") + "SELECT stream, start_us, peak_us, end_us, round(amplitude, 6) AS amplitude, n FROM e")
def declared_detection(spark, sf):
    from ..operators.sweep import detection_sweep as sweep

    ev = events(spark, sf).withColumn("s", 0.5 + 0.05 * F.col("value"))
    out = sweep(ev, KEYS, "us", "value", windows_us=[12 * HOUR], quantiles=[0.05], enter=[1.0], leave=0.3, sigma="s", noise_window_us=24 * HOUR, max_gap_us=HOUR, min_duration_us=60 * SECOND, chunk_us=CHUNK)
    return r6(out, "amplitude").select("stream", "start_us", "peak_us", "end_us", "amplitude", "n")


def _butterworth_sql(source: str, ident: str, hours: float) -> str:
    """Fourth order: two sections, each forwards, then backwards, a sample a round of the recursion, all segments side by side."""
    step = """
SELECT stream, seg, j, x, g2 * u + q1 AS y, 2 * g1 * x - a1 * u + p2 AS p1, g1 * x - c1 * u AS p2, 2 * g2 * u - a2 * (g2 * u + q1) + q2 AS q1, g2 * u - c2 * (g2 * u + q1) AS q2
FROM (SELECT r.stream, r.seg, e.j, e.x, p1, p2, q1, q2, k.*EXCLUDE (stream), g1 * e.x + p1 AS u FROM {r} r JOIN {t} e ON e.stream = r.stream AND e.seg = r.seg AND e.j = r.j {way} 1 JOIN k ON k.stream = r.stream)"""
    return f"""
WITH RECURSIVE s AS ({source}), d AS (SELECT *, us - lag(us) OVER (PARTITION BY stream ORDER BY us) AS dt FROM s WHERE value IS NOT NULL),
per AS (SELECT stream, median(dt) AS p, tan(pi() / {hours * 3600} * median(dt) / 1e6) AS w FROM d GROUP BY stream),
w AS (SELECT *, 1 + 2 * sin(pi() / 8) * w + w * w AS d1, 1 + 2 * sin(3 * pi() / 8) * w + w * w AS d2 FROM per),
k AS (SELECT stream, p, w * w / d1 AS g1, w * w / d2 AS g2, 2 * (w * w - 1) / d1 AS a1, 2 * (w * w - 1) / d2 AS a2, (1 - 2 * sin(pi() / 8) * w + w * w) / d1 AS c1, (1 - 2 * sin(3 * pi() / 8) * w + w * w) / d2 AS c2, g1 AS b1, g2 AS b2 FROM w),
g AS (SELECT d.*, sum(CASE WHEN dt > 1.5 * p THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY us ROWS UNBOUNDED PRECEDING) AS seg FROM d JOIN per USING (stream)),
n AS (SELECT *, row_number() OVER o - 1 AS i, count(*) OVER (PARTITION BY stream, seg) AS n, first_value(value) OVER o AS x0, last_value(value) OVER (PARTITION BY stream, seg ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS xn FROM g WINDOW o AS (PARTITION BY stream, seg ORDER BY us)),
a AS (SELECT n.*, least(n - 1, 15 * greatest(1, floor(1e6 / p * {hours * 3600} / 6)))::BIGINT AS pad FROM n JOIN per USING (stream) WHERE n >= 3 AND 2 * p / 1e6 / {hours * 3600} < 1),
e AS MATERIALIZED (SELECT stream, seg, i + pad AS j, value AS x FROM a UNION ALL SELECT stream, seg, pad - i, 2 * x0 - value FROM a WHERE i BETWEEN 1 AND pad UNION ALL SELECT stream, seg, 2 * (n - 1) - i + pad, 2 * xn - value FROM a WHERE n - 1 - i BETWEEN 1 AND pad),
f AS ({_at_rest("e", "e.j = 0")} UNION ALL {step.format(r="f", t="e", way="+")}),
h AS MATERIALIZED (SELECT stream, seg, j, y AS x FROM f), top AS (SELECT stream, seg, max(j) AS j FROM h GROUP BY ALL),
b AS ({_at_rest("h", "(h.stream, h.seg, h.j) IN (SELECT (stream, seg, j) FROM top)")} UNION ALL {step.format(r="b", t="h", way="-")})
SELECT n.stream, n.{ident}, round(coalesce(b.y, n.value), 6) AS smooth FROM n LEFT JOIN a ON a.stream = n.stream AND a.seg = n.seg AND a.i = n.i LEFT JOIN b ON b.stream = n.stream AND b.seg = n.seg AND b.j = n.i + a.pad"""


def _at_rest(table: str, where: str) -> str:
    """First rows of the recursion: a constant signal x leaves z1 = x (1 - b) and z2 = x (b - c) in each section."""
    return f"SELECT {table}.stream, {table}.seg, {table}.j, x, x AS y, (2 * b1 - a1 + b1 - c1) * x AS p1, (b1 - c1) * x AS p2, (2 * b2 - a2 + b2 - c2) * x AS q1, (b2 - c2) * x AS q2 FROM {table} JOIN k ON k.stream = {table}.stream WHERE {where}"


@query(_butterworth_sql("SELECT * FROM $E", "event_id", 6.0))
def butterworth_smooth(spark, sf):
    from ..operators.smooth import butterworth

    return r6(butterworth(events(spark, sf, "event_id"), KEYS, "us", "value", 6 * 3600.0, chunk_us=CHUNK), "smooth").select("stream", "event_id", "smooth")


@query(_butterworth_sql(f"SELECT stream, us // {2 * HOUR} * {2 * HOUR} AS us, avg(value) AS value FROM $E GROUP BY ALL", "us", 12.0))
def butterworth_bins(spark, sf):
    """Two-hourly means: long segments without gaps, cut into parts of 50 rows."""
    from ..operators.smooth import butterworth

    bins = events(spark, sf).groupBy("stream", (F.floor(F.col("us") / F.lit(2 * HOUR)) * (2 * HOUR)).alias("us")).agg(F.avg("value").alias("value"))
    return r6(butterworth(bins, KEYS, "us", "value", 12 * 3600.0, chunk_us=CHUNK, part_rows=50), "smooth").select("stream", "us", "smooth")


_SORTED = f"SELECT stream, event_id, len(l) AS n, list_sort(l) AS l FROM (SELECT *, list(value) OVER {_W12} AS l FROM $E)"
_PLACE_OF = "SELECT *, (n - 1) * greatest(0, 0.05 - sqrt(0.05 * 0.95 / n)) AS a, (n - 1) * least(1, 0.05 + sqrt(0.05 * 0.95 / n)) AS b"
_AT = "(l[floor({p})::INT + 1] + (l[ceil({p})::INT + 1] - l[floor({p})::INT + 1]) * ({p} - floor({p})))"


@query(f"SELECT stream, event_id, CASE WHEN n >= 2 THEN round(({_AT.format(p='b')} - {_AT.format(p='a')}) / 2, 6) END AS baseline_sigma FROM ({_PLACE_OF} FROM ({_SORTED}))")
def baseline_sigma_order(spark, sf):
    out = baseline_sigma(events(spark, sf, "event_id"), KEYS, "us", "value", 12 * HOUR, 0.05, chunk_us=CHUNK)
    return r6(out, "baseline_sigma").select("stream", "event_id", "baseline_sigma")


def _bootstrap_sql(replicates: int, seed: int, block: int) -> str:
    """Weights by hash of replicate and block; each value is in its window as often as its weight says."""
    uniform = lambda text: f"(('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296.0)"
    cdf = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253]  # fixed values
    return f"""
WITH r AS (SELECT unnest(range({replicates})) AS r), o AS (SELECT r, floor({uniform(f"'{seed}:offset' || r")} * {block})::BIGINT AS shift FROM r),
u AS (SELECT e.*, r, {uniform(f"'{seed}:' || r || ':' || ((us + shift) // {block})")} AS u FROM $E e, o),
w AS (SELECT *, {" + ".join(f"(u >= {c!r})::INT" for c in cdf)} AS w FROM u),
l AS (SELECT stream, event_id, r, count(value) OVER v AS k, flatten(list(list_resize(CAST([] AS DOUBLE[]), w, value)) OVER v) AS l FROM w WINDOW v AS (PARTITION BY stream, r ORDER BY us RANGE BETWEEN {6 * HOUR - 1} PRECEDING AND {6 * HOUR} FOLLOWING)),
q AS (SELECT stream, event_id, k, list_aggregate(l, 'quantile_cont', 0.05) AS q FROM l)
SELECT stream, event_id, CASE WHEN any_value(k) >= 2 AND count(q) >= 2 THEN round(stddev_samp(q), 6) END AS baseline_sigma FROM q GROUP BY ALL"""


@query(_bootstrap_sql(8, 3, HOUR))
def baseline_sigma_bootstrap(spark, sf):
    out = baseline_sigma(events(spark, sf, "event_id"), KEYS, "us", "value", 12 * HOUR, 0.05, method="bootstrap", block_us=HOUR, replicates=8, seed=3, chunk_us=CHUNK)
    return r6(out, "baseline_sigma").select("stream", "event_id", "baseline_sigma")


_W3 = f"(PARTITION BY stream ORDER BY us RANGE BETWEEN {3 * HOUR // 2 - 1} PRECEDING AND {3 * HOUR // 2} FOLLOWING)"


@query(f"""
WITH l AS (SELECT stream, event_id, list(value) OVER {_W3} AS l FROM $E), d AS (SELECT stream, event_id, len(l) AS n, len(l) // 2 + 1 AS h, list_sort(flatten(list_transform(range(1, len(l) + 1), lambda i: list_transform(range(i + 1, len(l) + 1), lambda j: abs(l[i] - l[j]))))) AS d FROM l)
SELECT stream, event_id, round(2.2219 * d[h * (h - 1) // 2] * CASE WHEN n <= 9 THEN [0, 0.399, 0.994, 0.512, 0.844, 0.611, 0.857, 0.669, 0.872][n] WHEN n % 2 = 1 THEN n / (n + 1.4) ELSE n / (n + 3.8) END, 6) AS sigma FROM d
""")
def rolling_qn_noise(spark, sf):
    return r6(noise.rolling_qn(events(spark, sf, "event_id"), KEYS, "us", "value", 3 * HOUR, chunk_us=CHUNK), "sigma").select("stream", "event_id", "sigma")


def _rolling_york_sql(rounds: int = 40) -> str:
    """Windows joined with their members, then unrolled rounds of the fixed point."""
    w = "wx * wy / (wx + b * b * wy)"
    head = f"p AS (SELECT *, 0.5 * value + 0.3 * (user_id % 7) AS y, 1 / pow(0.5 + 0.02 * value, 2) AS wx, 1 / pow(0.4 + 0.01 * value, 2) AS wy FROM $E), j AS MATERIALIZED (SELECT c.stream, c.event_id, o.value AS x, o.y, o.wx, o.wy FROM p c JOIN p o ON o.stream = c.stream AND o.us > c.us - {6 * HOUR} AND o.us <= c.us + {6 * HOUR}), b0 AS MATERIALIZED (SELECT event_id, regr_slope(y, x) AS b FROM j GROUP BY event_id HAVING max(x) > min(x))"
    step = ", m{k} AS MATERIALIZED (SELECT event_id, b, sum({w} * x) / sum({w}) AS xm, sum({w} * y) / sum({w}) AS ym FROM j JOIN b{k} USING (event_id) GROUP BY event_id, b), b{n} AS MATERIALIZED (SELECT event_id, sum(v * t * (y - ym)) / sum(v * t * (x - xm)) AS b FROM (SELECT *, {w} AS v, {w} * ((x - xm) / wy + b * (y - ym) / wx) AS t FROM j JOIN m{k} USING (event_id)) GROUP BY event_id)"
    last = step.split(", b{n}")[0].format(k=rounds, w=w)
    return f"WITH {head}{''.join(step.format(k=k, n=k + 1, w=w) for k in range(rounds))}{last}, e AS (SELECT *, {w} AS v, {w} * ((x - xm) / wy + b * (y - ym) / wx) AS t FROM j JOIN m{rounds} USING (event_id)), f AS (SELECT event_id, any_value(b) AS slope, 1 / sqrt(sum(v * t * t) - sum(v * t) * sum(v * t) / sum(v)) AS sb FROM e GROUP BY event_id) SELECT stream, event_id, round(slope, 5) AS slope, round(sb, 5) AS sigma_slope, n FROM (SELECT stream, event_id, count(*) AS n FROM j GROUP BY ALL) LEFT JOIN f USING (event_id)"


@query(_rolling_york_sql())
def rolling_york(spark, sf):
    v = F.col("value")
    p = events(spark, sf, "event_id", "user_id").select("stream", "us", "event_id", v.alias("x"), (0.5 * v + 0.3 * (F.col("user_id") % 7)).alias("y"), (0.5 + 0.02 * v).alias("sx"), (0.4 + 0.01 * v).alias("sy"))
    out = regress.rolling_york(p, KEYS, "us", 12 * HOUR, chunk_us=CHUNK)
    return out.select("stream", "event_id", F.round("slope", 5).alias("slope"), F.round("sigma_slope", 5).alias("sigma_slope"), "n")


@query(_CATALOG.split("SELECT stream || ")[0].rstrip() + ", x AS (SELECT stream, row_number() OVER (PARTITION BY stream ORDER BY start_us) - 1 AS event_no, start_us AS lo, end_us AS hi FROM e)," + _AREA.format(more="", source="(SELECT stream, us, value, CASE WHEN n_valid >= 2 THEN b END AS b FROM b)", event="event_no", on="", gap=HOUR) + " SELECT stream, event_no, round(coalesce(area, 0), 4) AS area, round(coalesce(sigma_rand, 0), 5) AS sigma_rand, coalesce(covered_us, 0) AS covered_us FROM x LEFT JOIN g USING (stream, event_no)")
def event_areas(spark, sf):
    ev = events(spark, sf)
    b = baseline_sweep(ev, KEYS, "us", "value", [12 * HOUR], [0.05], chunk_us=CHUNK).withColumn("s", 0.5 + 0.02 * F.col("value"))
    out = areas.event_areas(b, _detected(spark, sf), KEYS, "us", "enhancement", sigma="s", max_gap_us=HOUR, chunk_us=CHUNK)
    return out.select("stream", "event_no", F.round("area", 4).alias("area"), F.round("sigma_rand", 5).alias("sigma_rand"), "covered_us")


_FOUND = _CATALOG.split("SELECT stream || ")[0]


def _truth(spark, sf) -> DataFrame:
    return events(spark, sf, "event_id").where("value > 100").select("stream", F.col("event_id").cast("string").alias("event_id"), (F.col("us") - HOUR).alias("start_us"), (F.col("us") + HOUR).alias("end_us"))


@query(_FOUND + f"SELECT t.event_id::VARCHAR AS event_id, count(e.start_us) > 0 AS hit, count(e.start_us) AS n_found, coalesce(sum(CASE WHEN e.start_us IS NOT NULL THEN least(e.end_us, t.us + {HOUR}) - greatest(e.start_us, t.us - {HOUR}) END), 0)::BIGINT AS overlap_us FROM $E t LEFT JOIN e ON e.stream = t.stream AND e.start_us <= t.us + {HOUR} AND t.us - {HOUR} <= e.end_us WHERE t.value > 100 GROUP BY t.event_id")
def detection_score(spark, sf):
    return detect.score(_detected(spark, sf), _truth(spark, sf), KEYS, bucket_us=24 * HOUR)


@query(_FOUND + f"SELECT e.stream, e.start_us, e.end_us, e.n FROM e WHERE NOT EXISTS (SELECT 1 FROM $E t WHERE t.value > 100 AND e.stream = t.stream AND e.start_us <= t.us + {HOUR} AND t.us - {HOUR} <= e.end_us)")
def false_alarms(spark, sf):
    out = detect.false_alarms(_detected(spark, sf), _truth(spark, sf), KEYS, bucket_us=24 * HOUR)
    return out.select("stream", "start_us", "end_us", "n")


_ROLL = f"(PARTITION BY stream ORDER BY us RANGE BETWEEN {12 * HOUR - 1} PRECEDING AND {12 * HOUR} FOLLOWING)"


@query(f"SELECT stream, event_id, round(regr_slope(value, user_id) OVER {_ROLL}, 6) AS slope, count(*) OVER {_ROLL} AS n FROM $E")
def rolling_ratio(spark, sf):
    out = regress.rolling_ols(events(spark, sf, "event_id", "user_id"), KEYS, "us", "user_id", "value", 24 * HOUR, chunk_us=CHUNK)
    return out.select("stream", "event_id", F.round("slope", 6).alias("slope"), "n")


@query(f"SELECT stream, round(min(CASE WHEN d > 0 THEN d END), 6) AS step FROM ({_STEPS}) GROUP BY stream")
def reporting_step(spark, sf):
    return r6(noise.resolution(events(spark, sf), KEYS, "us", "value", chunk_us=CHUNK), "step")


@query(f"""
WITH s AS (SELECT us, value AS y FROM $E WHERE stream = 'purchase'), f AS (SELECT us, value AS x FROM $E WHERE stream <> 'purchase')
SELECT s.us, round(median(x), 6) AS x, round(y, 6) AS y, count(x) AS n_native FROM s JOIN f ON f.us >= s.us - {10 * 60 * SECOND} AND f.us < s.us + {10 * 60 * SECOND} GROUP BY s.us, y
""")
def pair_by_median(spark, sf):
    ev = events(spark, sf)
    out = align.pair(ev.where("stream != 'purchase'").select("us", "value"), ev.where("stream = 'purchase'").select("us", F.col("value").alias("v")), [], "us", "value", "v", 20 * 60 * SECOND, statistic="median")
    return r6(out, "x", "y")


def _turned(x: str) -> str:
    """An angle in [0, 360): 360 added to a remainder just below 0 is rounded to a whole turn, which is none."""
    return f"CASE WHEN {x} < 0 THEN fmod(360 - fmod(-({x}), 360), 360) ELSE fmod({x}, 360) END"


_TURN = f"({_turned('v1 - v0 + 180')}) - 180"


@query(f"""
WITH t AS (SELECT event_id, us FROM $E WHERE stream = 'click'), s AS (SELECT us, min(value * 3) AS v FROM $E WHERE stream = 'view' AND value IS NOT NULL GROUP BY us),
a AS (SELECT t.event_id, t.us, s.us AS u0, s.v AS v0 FROM t ASOF LEFT JOIN s ON t.us >= s.us), b AS (SELECT t.event_id, s.us AS u1, s.v AS v1 FROM t ASOF LEFT JOIN s ON t.us <= s.us),
r AS (SELECT event_id, CASE WHEN u0 IS NULL THEN v1 WHEN u1 IS NULL OR u1 = u0 THEN v0 ELSE v0 + ({_TURN}) * ((us - u0) / (u1 - u0)) END AS x FROM a JOIN b USING (event_id))
SELECT event_id, round({_turned('x')}, 6) AS angle FROM r
""")
def angle_interp(spark, sf):
    ev = events(spark, sf, "event_id")
    s = ev.where("stream = 'view'").select("us", (F.col("value") * 3).alias("angle"))
    return r6(align.interpolate(ev.where("stream = 'click'").select("event_id", "us"), s, [], "us", ["angle"], angles=("angle",), chunk_us=CHUNK), "angle").select("event_id", "angle")


_FITS = "SELECT l_suppkey, count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS b, sqrt(greatest(0, regr_syy(l_extendedprice, l_quantity) - regr_slope(l_extendedprice, l_quantity) * regr_sxy(l_extendedprice, l_quantity)) / (count(*) - 2) / regr_sxx(l_extendedprice, l_quantity)) AS s FROM lineitem GROUP BY l_suppkey HAVING count(*) > 2"


def _fits(spark, sf) -> DataFrame:
    fits = regress.ols(spark.read.parquet(f"{sf}/lineitem.parquet"), ["l_suppkey"], "l_quantity", "l_extendedprice")
    return regress.ratios(fits.where("n > 2"), min_points=20, confidence=0.9, scale_x=0.03, scale_y=0.04)


@query(f"SELECT l_suppkey, n, n >= 20 AS enough, round(b, 4) AS ratio, round(sqrt(s * s + b * b * 0.0025), 4) AS sigma, round(b - 1.6448536269514722 * sqrt(s * s + b * b * 0.0025), 3) AS low, round(b + 1.6448536269514722 * sqrt(s * s + b * b * 0.0025), 3) AS high FROM (SELECT l_suppkey, n, CASE WHEN n >= 20 THEN b END AS b, s FROM ({_FITS}))")
def ratio_bounds(spark, sf):
    return _fits(spark, sf).select("l_suppkey", "n", "enough", F.round("ratio", 4).alias("ratio"), F.round("sigma", 4).alias("sigma"), F.round("low", 3).alias("low"), F.round("high", 3).alias("high"))


@query(f"WITH f AS (SELECT l_suppkey, CASE WHEN n >= 20 THEN b END AS b, CASE WHEN n >= 20 THEN s END AS s FROM ({_FITS})) SELECT l_suppkey, round(sqrt(s * s + b * b * 0.0025 + pow(m, 2)), 4) AS sigma_total FROM f CROSS JOIN (SELECT stddev_samp(b) AS m FROM f)")
def ratio_total_sigma(spark, sf):
    f = _fits(spark, sf).withColumn("_all", F.lit(1))
    both = f.join(regress.method_sigma(f, ["_all"]), "_all")
    return both.select("l_suppkey", F.round(regress.total_sigma(F.col("sigma_fit"), F.col("sigma_sys"), F.col("sigma_method")), 4).alias("sigma_total"))


@query(ORACLES["birge_ratio"].replace("SELECT g AS o_orderpriority", "SELECT o_orderpriority, round(birge, 6) AS birge, row_number() OVER (ORDER BY abs(birge - 1), o_orderpriority) AS closure_rank FROM (SELECT g AS o_orderpriority").replace("round(sqrt(sum(pow(b - mean, 2) / (e * e)) / nullif(count(*) - 1, 0)), 6)", "sqrt(sum(pow(b - mean, 2) / (e * e)) / nullif(count(*) - 1, 0))") + ") WHERE birge IS NOT NULL")
def closing_cells(spark, sf):
    l = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_quantity", "l_extendedprice")
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority", F.date_trunc("month", "o_orderdate").alias("m"))
    fits = regress.ols(l.join(o, "l_orderkey"), ["o_orderpriority", "m"], "l_quantity", "l_extendedprice")
    ranked = regress.closing_cells(regress.birge(fits, ["o_orderpriority"]), [])
    return ranked.select("o_orderpriority", F.round("birge", 6).alias("birge"), F.col("closure_rank").cast("long").alias("closure_rank"))


# the distance that ODR makes least is York's for a straight line without correlation
@query(_york_sql(30).replace("l_returnflag", "l_suppkey").split("SELECT g AS l_suppkey")[0] + "SELECT g AS l_suppkey, round(any_value(b), 5) AS slope, round(any_value(ym - b * xm), 4) AS intercept, count(*) AS n FROM e GROUP BY g")
def odr_ratio(spark, sf):
    l = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey", (F.col("l_quantity") + 20 * F.col("l_discount")).alias("x"), (0.5 * F.col("l_quantity") + 20 * F.col("l_tax")).alias("y"), (0.5 + 0.02 * F.col("l_quantity")).alias("sx"), (0.4 + 0.01 * F.col("l_quantity")).alias("sy"))
    f = regress.fit_events(l, ["l_suppkey"], regress.METHODS["odr"])
    return f.select("l_suppkey", F.round("slope", 5).alias("slope"), F.round("intercept", 4).alias("intercept"), "n")


@query("SELECT event_id, round(abs((value - 60) * 0.4), 6) AS sigma, CASE WHEN value > 60 THEN 'declared' WHEN value IS NOT NULL THEN 'reported' ELSE 'empirical' END AS source, value IS NULL OR isnan(value) AS missing FROM events")
def reported_sigma(spark, sf):
    v = F.col("value")
    df = spark.read.parquet(f"{sf}/events.parquet").withColumn("s", scalar.reported_sigma(v - 60, 0.4))
    return df.select("event_id", F.round("s", 6).alias("sigma"), scalar.source_label(F.when(v > 60, v), F.col("s")).alias("source"), scalar.missing(v).alias("missing"))


@query("SELECT event_id, epoch_us(date_trunc('second', ts)) AS us, round(epoch_us(ts) / 1e6, 6) AS s, epoch_us(date_trunc('second', ts)) - 19800000000 AS of_kolkata FROM events")
def time_parse(spark, sf):
    text = F.date_format("ts", "dd.MM.yyyy HH:mm:ss")
    df = spark.read.parquet(f"{sf}/events.parquet")
    return df.select("event_id", time.epoch_us(time.parse_time(text, "%d.%m.%Y %H:%M:%S")).alias("us"), F.round(time.epoch_s(F.col("ts")), 6).alias("s"), time.epoch_us(time.parse_time(text, "%d.%m.%Y %H:%M:%S", "Asia/Kolkata")).alias("of_kolkata"))


@query("SELECT event_id, round(CASE WHEN abs(value - 60) <= 80 THEN exp(-pow((value - 60) / 20, 2) / 2) ELSE 0 END, 9) AS shape, least(90, greatest(-90, value)) = value AS on_earth FROM events")
def plume_kernel(spark, sf):
    from ..functions.shapes import Kernel

    df = spark.read.parquet(f"{sf}/events.parquet")
    return df.select("event_id", F.round(Kernel.build(20.0).column(F.col("value") - 60), 9).alias("shape"), (geodesy.clamp_latitude(F.col("value")) == F.col("value")).alias("on_earth"))
