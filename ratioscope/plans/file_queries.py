"""Registered queries that read files back: the driver's events, written by Spark as instruments' files, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config.manifest import InstrumentConfig, VariableConfig
from ..functions.time import from_us
from ..operators import masks, ordered
from ..operators.baseline import baseline_sweep
from ..scratch import Scratch
from ..sources.bundle import Dataset, load_bundle
from ..sources.catalog import for_species
from ..sources.delimited import read_delimited
from ..sources.icartt import read_icartt
from ..sources.series import read_series
from . import queries as q
from .queries import CHUNK, HOUR, KEYS, events, query, r6

DAY_US = 24 * HOUR


def _written(spark: SparkSession, rows: DataFrame, heads: list, name: str) -> str:
    """Folder of text files, one a stream and day: ``heads`` (columns over stream and day), then the rows' ``value`` by time."""
    days = rows.select("stream", "day").distinct()
    above = days.select("stream", "day", F.posexplode(F.array(*heads)).alias("at", "value")).select("stream", "day", (F.col("at") - 1000).cast("long").alias("at"), "value")
    both = above.unionByName(rows.select("stream", "day", F.col("us").alias("at"), "value"))
    folder = f"{Scratch(spark, name).root}/files"
    # a file is a day of a stream, so a task's share is bounded by a day
    both.repartition("stream", "day").sortWithinPartitions("stream", "day", "at").select("stream", "day", "value").write.partitionBy("stream", "day").text(folder)
    return folder


def _days(spark, sf, *cols: str) -> DataFrame:
    return events(spark, sf, "event_id", *cols).withColumn("day", F.floor(F.col("us") / F.lit(DAY_US)))


@query("SELECT stream, event_id, us, CASE WHEN value < 5 THEN NULL ELSE value END AS value FROM $E")
def delimited_files(spark, sf):
    """Text files with rows above the header, comments and a missing mark; streams are told by the path."""
    cell = F.when(F.col("value") < 5, "-9999").otherwise(F.col("value").cast("string"))
    when = F.concat((F.floor(F.col("us") / 1_000_000)).cast("string"), F.lit("."), F.lpad((F.col("us") % 1_000_000).cast("string"), 6, "0"))
    rows = _days(spark, sf).withColumn("value", F.concat_ws(";", when, "event_id", cell))
    folder = _written(spark, rows, [F.lit("# made for reading"), F.lit("serial;17"), F.lit("t;no;x")], "delimited")
    inst = InstrumentConfig.read({"loader": {"format": "csv", "path_template": "stream={kind}/day=*/part-*.txt", "delimiter": ";", "header_row": 1, "comment": "#", "na_values": ["-9999"], "time": {"column": "t", "format": "unix"}}, "variables": {"x": {"column": "x", "units": ""}}})
    out = read_delimited(spark, folder, inst)
    return out.select(F.col("kind").alias("stream"), F.col("no").cast("long").alias("event_id"), "us", F.col("x").cast("double").alias("value"))


@query("SELECT stream, event_id, us, CASE WHEN value < 5 THEN NULL ELSE round(value * 0.5, 6) END AS value FROM $E")
def icartt_files(spark, sf):
    """Files of format 1001, a day of a stream each, with a scale and a missing mark."""
    cell = F.when(F.col("value") < 5, "-9999").otherwise(F.col("value").cast("string"))
    within = F.col("us") - F.col("day") * DAY_US
    when = F.concat(F.floor(within / 1_000_000).cast("string"), F.lit("."), F.lpad((within % 1_000_000).cast("string"), 6, "0"))
    rows = _days(spark, sf).withColumn("value", F.concat_ws(",", when, cell, "event_id"))
    date = F.date_format(F.timestamp_micros(F.col("day") * DAY_US), "yyyy, MM, dd")
    heads = [F.lit(x) for x in ("15, 1001", "who", "where", "what", "why", "1, 1")] + [F.concat(date, F.lit(", "), date)] + [F.lit(x) for x in ("1", "t, seconds", "2", "0.5, 1", "-9999, -1", "x, none", "no, none", "t,x,no")]
    folder = _written(spark, rows, heads, "icartt")
    inst = InstrumentConfig.read({"loader": {"format": "icartt", "path_template": "stream={kind}/day=*/part-*.txt", "revision_policy": "all"}, "variables": {"x": {"column": "x", "units": ""}, "no": {"column": "no", "units": ""}}})
    out = read_icartt(spark, folder, inst).where("problem is null")
    return r6(out.select(F.col("kind").alias("stream"), F.col("no").cast("long").alias("event_id"), "us", F.col("x").alias("value")), "value")


def _bundle(spark, sf) -> Dataset:
    """Streams with an answer key and the catalog of what is detected in them, saved and opened again."""
    ev = events(spark, sf, "event_id").withColumn("truth_x", F.col("value") * 2)
    found = q._detected(spark, sf)
    time = lambda c: from_us(F.col(c))
    cat = found.select(F.format_string("%s_%05d", "stream", "event_no").alias("event_id"), F.lit(None).cast("string").alias("parent_event_id"), F.lit("driver").alias("source_name"), F.col("stream").alias("species"), F.col("stream").alias("instrument"), F.col("stream").alias("reference_species"), time("start_us").alias("start_time"), time("peak_us").alias("peak_time"), time("end_us").alias("end_time"), F.col("amplitude").alias("true_amplitude"), F.lit(None).cast("double").alias("sampled_peak_amplitude"), F.lit(0.0).alias("true_baseline_at_peak"), F.lit(1.0).alias("true_ratio_to_reference"), F.lit(None).cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude"))
    folder = f"{Scratch(spark, 'bundle').root}/bundle"
    Dataset({s: ev.where(F.col("stream") == s).drop("stream") for s in q._STREAMS}, cat, attributes={"made": "of events"}).save(spark, folder)
    return load_bundle(spark, folder)


@query("SELECT stream, event_id, us, value FROM $E")
def bundle_streams(spark, sf):
    ds, out = _bundle(spark, sf), None
    for s in sorted(ds.streams):
        one = ds.observable(s).withColumn("stream", F.lit(s))
        out = one if out is None else out.unionByName(one)
    return out.select("stream", "event_id", "us", "value")


@query(q._CATALOG.split("SELECT stream || ")[0] + "SELECT stream || '_' || lpad((row_number() OVER (PARTITION BY stream ORDER BY start_us) - 1)::VARCHAR, 5, '0') AS event_id, make_timestamp(start_us) AS start_time, make_timestamp(end_us) AS end_time, round(amplitude, 6) AS true_amplitude FROM e WHERE stream = 'view'")
def bundle_catalog(spark, sf):
    return r6(for_species(_bundle(spark, sf).catalog, "view"), "true_amplitude").select("event_id", "start_time", "end_time", "true_amplitude")


@query("SELECT us, arg_min(value, event_id) AS value FROM (SELECT us // 60000000 * 60000000 AS us, value, event_id FROM $E) GROUP BY us")
def series_first_stamps(spark, sf):
    """A file of one clock with repeated stamps: the first of each stays."""
    rows = events(spark, sf, "event_id").select("event_id", from_us(F.floor(F.col("us") / F.lit(60_000_000)) * 60_000_000).alias("stamp"), "value")
    ordered_rows = Scratch(spark, "series").write(rows.repartitionByRange("event_id").sortWithinPartitions("event_id"), "series")
    return read_series(spark, ordered_rows._scratch_path).select("us", "value")


@query(q._CATALOG.split("SELECT stream || ")[0] + "SELECT e.stream, e.start_us, s.stream AS other, count(*) AS n, round(avg(s.value), 6) AS mean FROM e JOIN $E s ON s.us >= e.start_us AND s.us <= e.end_us GROUP BY ALL")
def event_slices(spark, sf):
    """Samples of all streams in the time of each event."""
    found = Scratch(spark, "slices").write(q._detected(spark, sf), "events")
    met = ordered.range_join(found.select("stream", "start_us", "end_us"), events(spark, sf).withColumnRenamed("stream", "other"), "start_us", "end_us", "us", HOUR, closed=True)
    return r6(met.groupBy("stream", "start_us", "other").agg(F.count("*").alias("n"), F.avg("value").alias("mean")), "mean")


@query(f"SELECT stream, event_id, round(CASE WHEN count(v) OVER w >= greatest(2, 0.8 * count(*) OVER w) THEN quantile_cont(v, 0.1) OVER w END, 6) AS baseline FROM (SELECT *, CASE WHEN value > 30 THEN value END AS v FROM $E) WINDOW w AS (PARTITION BY stream ORDER BY us RANGE BETWEEN {6 * HOUR - 1} PRECEDING AND {6 * HOUR} FOLLOWING)")
def baseline_valid_fraction(spark, sf):
    ev = events(spark, sf, "event_id").withColumn("v", masks.range_mask(F.col("value"), low=30.000001))
    return r6(baseline_sweep(ev, KEYS, "us", "v", [12 * HOUR], [0.1], min_valid_fraction=0.8, chunk_us=CHUNK), "baseline").select("stream", "event_id", "baseline")


@query(f"""
WITH c AS (SELECT stream, event_id, us, (props::JSON->>'k')::INT AS k, value * 2 + 1 AS v FROM $E),
f AS (SELECT * REPLACE (CASE WHEN v < 11 OR v > 301 OR coalesce(k, 0) IN (1, 2) THEN NULL ELSE v END AS v) FROM c),
l AS (SELECT *, list(v) FILTER (WHERE v IS NOT NULL) OVER (PARTITION BY stream ORDER BY us RANGE BETWEEN {6 * HOUR - 1} PRECEDING AND {6 * HOUR} FOLLOWING) AS l FROM f)
SELECT stream, event_id, round(CASE WHEN abs(v - list_median(l)) > 2.5 * 1.4826 * list_median(list_transform(l, lambda x: abs(x - list_median(l)))) THEN NULL ELSE v END, 6) AS value FROM l
""")
def qaqc_rules(spark, sf):
    """A raw text column through unit, range, flag and spike, in this order."""
    cfg = VariableConfig.read({"column": "raw", "units": "", "convert": {"from_unit": "raw", "to_unit": "x", "scale": 2.0, "offset": 1.0}, "qaqc": [{"kind": "range", "min": 11.0, "max": 301.0}, {"kind": "flag", "flag_column": "k", "bad_values": [1, 2]}, {"kind": "spike", "window": "12h", "n_mad": 2.5}]})
    raw = events(spark, sf, "event_id", "props").withColumn("k", F.get_json_object("props", "$.k")).withColumn("raw", F.col("value").cast("string")).drop("props")
    out = masks.ingest_variable(raw, KEYS, "us", "x", cfg, chunk_us=CHUNK)
    return r6(out.select("stream", "event_id", F.col("x").alias("value")), "value")
