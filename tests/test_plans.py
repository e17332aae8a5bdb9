import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from ratioscope.config import AnalysisConfig
from ratioscope.errors import ConfigError
from ratioscope.plans import queries as plans
from ratioscope.plans.analysis import analyse
from ratioscope.streaming import online

S = 1_000_000
SF = "/root/testdata/sf0.001"


def test_library_does_not_import_llm():
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, names in os.walk(f"{here}/ratioscope"):
        if not folder.startswith(f"{here}/ratioscope/llm"):
            for n in names:
                if n.endswith(".py"):
                    with open(f"{folder}/{n}", encoding="utf-8") as f:
                        assert "llm" not in f.read(), n
    assert set(plans.ORACLES) <= set(plans.QUERIES) <= set(entry_module.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["baseline_enhancement", "plume_catalog", "rolling_noise", "aux_interp", "pmf_matrix", "ols_ratio", "declared_detection", "nested_links", "space_time_clusters", "detection_score", "output_grid_sigma", "output_grid_circular", "angle_interp", "odr_ratio", "baseline_sigma_order", "rolling_york", "net_areas", "hmm_states", "delimited_files", "qaqc_rules"])
def test_queries_equal_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("events", "lineitem", "orders", "customer"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want, got = c.execute(plans.ORACLES[name]).df(), plans.QUERIES[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    flat = lambda d: sorted(tuple("" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in d[cols].itertuples(index=False))
    assert cols == sorted(got.columns) and flat(want) == flat(got)


def test_analysis_recovers_a_ratio(spark):
    n = 3000
    t = F.col("id")
    plume = F.exp(-F.pow(F.pmod(t, F.lit(300)) - 150, 2) / 200) * 100
    noise = lambda k: (F.pmod(F.xxhash64(t, F.lit(k)), F.lit(2001)) - 1000) / 1000.0
    base = spark.range(n)
    mk = lambda name, x: base.select(F.lit(name).alias("stream"), F.lit("i").alias("instrument"), (t * S).alias("us"), x.alias("value"), F.lit(0.6).alias("sigma_rand"), F.lit(0.0).alias("sigma_sys"), F.lit("declared").alias("source"))
    long = mk("ch4", 1900 + plume + noise(1)).unionByName(mk("c2h6", 2 + 0.05 * plume + 0.02 * noise(2)).withColumn("sigma_rand", F.lit(0.012)))
    cfg = AnalysisConfig.read({"output_grid": {"freq": "10s"}, "baseline": {"windows": ["200s", "600s"], "quantiles": [0.1]}, "detection": {"enter_sigma": [4.0]}, "regression": {"reference_species": "ch4", "methods": ["ols", "york", "odr"]}})
    a = analyse(long, cfg, {"ch4": S, "c2h6": S}, chunk_us=700 * S)
    assert a.events.where("window_us = 600000000").count() == n // 300
    r = a.ratios.where("ratio is not null").groupBy("method").agg(F.avg("ratio").alias("m"), F.count("*").alias("k")).collect()
    assert {x.method for x in r} == {"ols", "york", "odr"} and all(abs(x.m - 0.05) < 0.002 for x in r)
    assert a.closure.where("birge > 0").count() == 6 and a.pmf.count() == n // 10
    assert set(a.samples.select("source").distinct().toPandas().source) == {"declared"}
    assert a.links.where("child_level = 0").count() > 0
    cell = a.grid.where("stream = 'ch4'").first()
    assert abs(cell.sigma_rand - 0.6 / 10**0.5) < 1e-12 and cell.sigma_sys == 0 and "ch4_sigma_rand" in a.pmf.columns
    assert a.ratios.where("ratio is not null and sigma_total < sigma").count() == 0
    # a declared sigma decides what is an event: far above the plumes, there is none
    none = analyse(long.withColumn("sigma_rand", F.lit(60.0)), cfg, {"ch4": S, "c2h6": S}, chunk_us=700 * S)
    assert none.events.count() == 0
    with pytest.raises(ConfigError):
        analyse(long, cfg, {"ch4": S, "c2h6": 20 * S}, chunk_us=700 * S)


def test_streams_equal_batch(spark, tmp_path):
    from ratioscope.operators import detect

    d = [0, 4, 2, 0.5, 4, 2, 2, 0, 0, 0, 0, 0, 5, 4, 0, 0, 0, 0, 4, 4]
    rows = [(k, i * S, float(v), 1.0) for k in ("a", "b") for i, v in enumerate(d)]
    df = spark.createDataFrame(rows, "k string, us long, d double, s double").withColumn("ts", F.timestamp_micros("us"))
    for j, (lo, hi) in enumerate(((0, 7), (7, 14), (14, 99))):
        df.where((F.col("us") >= lo * S) & (F.col("us") < hi * S)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{j}")
    for j in range(3):
        for f in os.listdir(f"{tmp_path}/in{j}"):
            if f.endswith(".parquet"):
                os.makedirs(f"{tmp_path}/in", exist_ok=True)
                os.rename(f"{tmp_path}/in{j}/{f}", f"{tmp_path}/in/{j}-{f}")
                os.utime(f"{tmp_path}/in/{j}-{f}", (1000 + j, 1000 + j))
    live = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = online.events(live, "k", "us", "d", "s", enter=3, leave=1, max_gap_us=2 * S, min_duration_us=S).writeStream.format("memory").queryName("ev").option("checkpointLocation", f"{tmp_path}/c1").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, spark.sql("select k, start_us, peak_us, end_us, amplitude, n from ev").collect()))
    st = detect.in_event(df, ["k"], "us", F.col("d"), F.col("s"), 3, 1)
    batch = detect.events(st, ["k"], "us", "d", "state", max_gap_us=2 * S, min_duration_us=S).select("k", "start_us", "peak_us", "end_us", "amplitude", "n").collect()
    # the last event of a stream is still open
    assert got == sorted(tuple(r) for r in batch if r.end_us < 19 * S)
    seg = online.gap_segments(live.where("d > 0"), ["k"], "ts", "2 seconds", late="0 seconds")
    q = seg.writeStream.format("memory").queryName("seg").option("checkpointLocation", f"{tmp_path}/c2").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select * from seg where k = 'a'").count() >= 2


def test_every_smoothing_cutoff_is_swept(spark):
    base = spark.range(900)
    plume = F.exp(-F.pow(F.pmod(F.col("id"), F.lit(300)) - 150, 2) / 200) * 100
    noise = (F.pmod(F.xxhash64("id"), F.lit(2001)) - 1000) / 1000.0
    mk = lambda name, x: base.select(F.lit(name).alias("stream"), F.lit("i").alias("instrument"), (F.col("id") * S).alias("us"), x.alias("value"), F.lit(0.6).alias("sigma_rand"), F.lit(0.0).alias("sigma_sys"), F.lit("declared").alias("source"))
    cfg = AnalysisConfig.read({"output_grid": {"freq": "10s"}, "baseline": {"windows": ["200s"], "quantiles": [0.1]}, "detection": {"enter_sigma": [4.0]}, "smoothing": {"enabled": True, "cutoff_periods": ["4s", "20s"]}, "regression": {"reference_species": "ch4", "methods": ["ols"]}})
    a = analyse(mk("ch4", 1900 + plume + noise).unionByName(mk("c2h6", 2 + 0.05 * plume)), cfg, {"ch4": S, "c2h6": S})
    for df in (a.samples, a.events, a.ratios, a.closure, a.grid, a.pmf):
        assert {r[0] for r in df.select("smoothing_cutoff").distinct().collect()} == {"4s", "20s"}
    assert a.events.count() == a.events.select("event_id").distinct().count() and a.pmf.count() == 180
    assert {r.n_cells for r in a.closure.collect()} == {2}
