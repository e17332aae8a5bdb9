import math
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ratioscope.functions import geodesy, scalar, shapes, time
from ratioscope.operators import align, circular, cluster, detect, masks, noise, ordered, profile, propagate, regress, smooth
from ratioscope.operators.baseline import baseline_sweep

S = 1_000_000


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in ("a", "b"):
        us = np.cumsum(rng.integers(1, 40, 300)) * S
        rows += [(k, int(t), None if i % 17 == 3 else float(v)) for i, (t, v) in enumerate(zip(us, rng.normal(size=300)))]
    return pd.DataFrame(rows, columns=["stream", "us", "value"]), spark.createDataFrame(rows, "stream string, us long, value double").repartition(7)


@pytest.mark.parametrize("chunk", [50 * S, 977 * S, 10**12])
def test_ordered_operators_do_not_see_chunks(series, chunk):
    pdf, df = series
    want = pdf.sort_values(["stream", "us"])
    g = want.groupby("stream").value
    p = ordered.previous(df, ["stream"], "us", ["value"], "p", chunk_us=chunk).select("stream", "us", "value", F.col("p.value").alias("p"))
    p = ordered.running_sum(p, ["stream"], "us", F.col("value"), "total", chunk_us=chunk)
    p = ordered.last_known(p, ["stream"], "us", F.col("value"), "up", chunk_us=chunk)
    p = ordered.last_known(p, ["stream"], "us", F.col("value"), "down", chunk_us=chunk, down=True).toPandas().sort_values(["stream", "us"])
    for col, ref in (("p", g.shift()), ("total", g.transform(lambda s: s.fillna(0).cumsum())), ("up", g.ffill()), ("down", g.bfill())):
        assert np.allclose(p[col].to_numpy(float), ref.to_numpy(float), equal_nan=True), col
    isl = ordered.islands(df, ["stream"], "us", 30 * S, "seg", chunk_us=chunk).toPandas().sort_values(["stream", "us"])
    assert isl.seg.tolist() == want.groupby("stream").us.transform(lambda s: (s.diff() > 30 * S).cumsum()).tolist()


@pytest.mark.parametrize("chunk", [100 * S, 10**12])
def test_rolling_baseline_equals_pandas(series, chunk):
    pdf, df = series
    out = baseline_sweep(df, ["stream"], "us", "value", [200 * S], [0.1, 0.5], chunk_us=chunk).toPandas()
    for k, part in pdf.groupby("stream"):
        s = pd.Series(part.value.to_numpy(), index=pd.to_datetime(part.us.to_numpy(), unit="us"))
        for q in (0.1, 0.5):
            ref = s.rolling("200s", center=True, min_periods=2).quantile(q).to_numpy()
            got = out[(out.stream == k) & (out["quantile"] == q)].sort_values("us").baseline.to_numpy(float)
            assert np.allclose(got, ref, equal_nan=True)


def test_masks(spark):
    df = spark.createDataFrame([(1.0, "0"), (5.0, "1"), (9.0, None), (None, "0")], "x double, f string")
    out = df.select(masks.range_mask(F.col("x"), 2.0, 8.0).alias("r"), masks.flag_mask(F.col("x"), F.col("f"), good=(0,)).alias("g"), masks.flag_mask(F.col("x"), F.col("f"), bad=(1.0,)).alias("b")).collect()
    assert [tuple(r) for r in out] == [(None, 1.0, 1.0), (5.0, None, None), (None, None, 9.0), (None, None, None)]
    rows = [("a", i * S, 1.0 + 0.1 * (i % 3) + (50.0 if i == 20 else 0.0)) for i in range(40)]
    sp = masks.spike_mask(spark.createDataFrame(rows, "k string, us long, v double"), ["k"], "us", "v", 9 * S, 6.0, chunk_us=7 * S)
    assert [r.us // S for r in sp.where("v is null").collect()] == [20]


def test_noise_scales(spark):
    rng = np.random.default_rng(2)
    n = 20_000
    x = rng.normal(size=n) + 200 * np.exp(-(((np.arange(n) - n / 2) / (n / 10)) ** 2) / 2)
    df = spark.createDataFrame([("a", i * S, float(v)) for i, v in enumerate(x)], "k string, us long, v double")
    assert abs(noise.diff_mad(df, ["k"], "us", "v", chunk_us=3000 * S).first().sigma - 1) < 0.05
    assert noise.mad(df, ["k"], "us", "v").first().sigma > 10
    flat = spark.createDataFrame([("a", i * S, 0.01 * (i // 90)) for i in range(100)], "k string, us long, v double")
    assert noise.diff_mad(flat, ["k"], "us", "v").first().sigma == 0
    assert noise.diff_mad(flat, ["k"], "us", "v", step=0.01).first().sigma == pytest.approx(0.01 / math.sqrt(12))
    assert noise.resolution(flat, ["k"], "us", "v").first().step == pytest.approx(0.01)
    assert noise.diff_mad(flat.limit(1), ["k"], "us", "v").first().sigma is None


def test_hysteresis_and_events(spark):
    d = [0, 4, 2, 0.5, 4, 2, 2, 0, 0, 5, 0, 4, 2, None, 2, 0]
    df = spark.createDataFrame([("a", i * S, None if v is None else float(v), 1.0) for i, v in enumerate(d)], "k string, us long, d double, s double")
    for chunk in (2 * S, 10**12):
        st = detect.in_event(df, ["k"], "us", F.col("d"), F.col("s"), 3, 1, chunk_us=chunk)
        assert [r.state for r in st.orderBy("us").collect()] == [0, 1, 1, 0, 1, 1, 1, 0, 0, 1, 0, 1, 1, 1, 1, 0]
        ev = detect.events(st, ["k"], "us", "d", "state", max_gap_us=2 * S, min_duration_us=S, chunk_us=chunk).orderBy("start_us").collect()
        assert [(e.start_us // S, e.peak_us // S, e.end_us // S, e.amplitude, e.n) for e in ev] == [(1, 1, 6, 4.0, 5), (9, 9, 14, 5.0, 5)]


def test_links_and_scores(spark):
    ev = spark.createDataFrame([("a", 0, 0, 10, 20), ("a", 0, 1, 50, 60), ("a", 1, 0, 5, 30), ("a", 1, 1, 8, 25)], "k string, level int, event_no int, start_us long, end_us long")
    assert [(r.child_no, r.parent_no) for r in detect.nested_links(ev, ["k"], "level", bucket_us=7).collect()] == [(0, 1)]
    truth = spark.createDataFrame([("a", "x", 0, 12), ("a", "y", 100, 110), ("b", "z", 10, 20)], "k string, event_id string, start_us long, end_us long")
    found = spark.createDataFrame([("a", 10, 20), ("a", 11, 40), ("a", 300, 301)], "k string, start_us long, end_us long")
    assert {r.event_id: (r.hit, r.n_found, r.overlap_us) for r in detect.score(found, truth, ["k"], bucket_us=8).collect()} == {"x": (True, 2, 3), "y": (False, 0, 0), "z": (False, 0, 0)}
    assert [r.start_us for r in detect.false_alarms(found, truth, ["k"], bucket_us=8).collect()] == [300]


def test_interpolation(spark):
    src = spark.createDataFrame([(0, 40.0), (10 * S, 41.0), (60 * S, 46.0), (70 * S, None)], "us long, v double")
    at = [-5, 0, 5, 10, 35, 60, 99]
    tg = spark.createDataFrame([(t * S,) for t in at], "us long")
    for chunk in (8 * S, 10**12):
        got = [r.v for r in align.interpolate(tg, src, [], "us", ["v"], chunk_us=chunk).orderBy("us").collect()]
        assert got == pytest.approx(np.interp(at, [0, 10, 60], [40, 41, 46]))
        got = [r.v for r in align.interpolate(tg, src, [], "us", ["v"], max_gap_us=20 * S, clamp=False, chunk_us=chunk).orderBy("us").collect()]
        assert got == [None, 40.0, 40.5, 41.0, None, 46.0, None]


def test_pairing_and_grid(spark):
    fast = spark.createDataFrame([(t * S, float(t)) for t in range(10)] + [(3 * S, None)], "us long, v double")
    slow = spark.createDataFrame([(2 * S, 1.0), (6 * S, 2.0), (90 * S, 3.0), (8 * S, None)], "us long, w double")
    got = [(r.us // S, r.x, r.y, r.n_native) for r in align.pair(fast, slow, [], "us", "v", "w", 4 * S).orderBy("us").collect()]
    assert got == [(2, 1.5, 1.0, 4), (6, 5.5, 2.0, 4)]
    g = align.output_grid(fast.withColumn("k", F.lit("a")), ["k"], "us", "v", 4 * S, 0, 16 * S, statistic="median")
    assert [(r.v, r.n_native) for r in g.orderBy("cell_us").collect()] == [(1.5, 4), (5.5, 4), (8.5, 2), (None, 0)]
    m = align.pmf_matrix(g, "k", "v", ["a"]).orderBy("cell_us").first()
    assert (m.a_value, m.a_n_native) == (1.5, 4)


def test_propagation(spark):
    df = spark.createDataFrame([("c", i * S, 2.0, 0.5) for i in range(16)], "c string, us long, s double, y double")
    r = df.agg(propagate.random_of_mean(F.col("s")), propagate.random_of_weighted_mean(F.col("s")), propagate.systematic_of_mean(F.col("y")), propagate.effective_n(F.lit(16), F.lit(1.0), 1e-9), propagate.effective_n(F.lit(16), F.lit(1.0), 1e9)).first()
    assert list(r) == pytest.approx([0.5, 0.5, 0.5, 16.0, 1.0])
    assert propagate.exact_random_of_mean(df, ["c"], "us", "s", 1e-9).first().sigma_mean == pytest.approx(0.5)
    assert propagate.exact_random_of_mean(df, ["c"], "us", "s", 1e12).first().sigma_mean == pytest.approx(2.0)


#: York's weights on Pearson's points: published values.
PEARSON = [(0, 5.9, 1000, 1), (0.9, 5.4, 1000, 1.8), (1.8, 4.4, 500, 4), (2.6, 4.6, 800, 8), (3.3, 3.5, 200, 20), (4.4, 3.7, 80, 20), (5.2, 2.8, 60, 70), (6.1, 2.8, 20, 70), (6.5, 2.4, 1.8, 100), (7.4, 1.5, 1, 500)]


def test_york_and_odr_on_published_data(spark):
    x, y, wx, wy = np.array(PEARSON, float).T
    for line in (regress.york_line, regress.odr_line):
        f = line(x, y, wx**-0.5, wy**-0.5)
        assert (f.slope, f.intercept, f.sigma_slope, f.sigma_intercept, f.s) == pytest.approx((-0.480533, 5.479910, 0.057985, 0.294971, 11.86635), abs=1e-5)
    df = spark.createDataFrame([("g", *map(float, r)) for r in zip(x, y, wx**-0.5, wy**-0.5)] + [("one", 1.0, 1.0, 1.0, 1.0)], "g string, x double, y double, sx double, sy double")
    wide = {r.g: r for r in regress.york(df, ["g"], rounds=30).collect()}
    small = {r.g: r for r in regress.fit_events(df, ["g"], regress.york_line).collect()}
    assert wide["g"].slope == pytest.approx(small["g"].slope, abs=1e-9) and wide["g"].sigma_slope == pytest.approx(0.057985, abs=1e-6)
    assert small["one"].slope is None and "one" not in wide
    flagged = regress.ratios(regress.ols(df, ["g"]), min_points=3, scale_x=0.01).collect()
    assert {r.g: r.ratio is None for r in flagged} == {"g": False, "one": True}


def test_birge(spark):
    df = spark.createDataFrame([("a", 1.0, 0.1), ("a", 1.2, 0.1), ("b", 1.0, 0.1)], "k string, slope double, sigma_slope double")
    got = {r.k: r.birge for r in regress.birge(df, ["k"]).collect()}
    assert got["a"] == pytest.approx(math.sqrt(2)) and got["b"] is None


def test_scalars(spark):
    df = spark.createDataFrame([(2.5, 370.0, -180.5), (3.5, -10.0, 180.08), (float("nan"), 0.0, 360.0)], "x double, a double, lon double")
    r = df.select(scalar.quantize(F.col("x"), 1.0).alias("q"), scalar.wrap_angle(F.col("a")).alias("w"), geodesy.wrap_longitude(F.col("lon")).alias("l"), scalar.known(F.col("x")).alias("k")).collect()
    assert [v.q for v in r[:2]] == [2.0, 4.0] and [v.w for v in r] == [10.0, 350.0, 0.0] and r[2].k is None
    assert [v.l for v in r] == pytest.approx([179.5, -179.92, 0.0])
    angles = spark.createDataFrame([(350.0,), (10.0,)], "a double").agg(circular.circular_mean(F.col("a")).alias("m")).first().m
    assert min(angles, 360 - angles) == pytest.approx(0, abs=1e-9)


def test_times(spark):
    df = spark.createDataFrame([("1767225600", "2026-01-01 02:00:00", "2026-01-01T00:00:00Z", "bad")], "u string, l string, i string, b string")
    r = df.select(time.parse_time(F.col("u"), "unix").alias("u"), time.parse_time(F.col("l"), "%Y-%m-%d %H:%M:%S", "Etc/GMT-2").alias("l"), time.parse_time(F.col("i"), "iso8601").alias("i"), time.parse_time(F.col("b"), "%Y").alias("b"), time.epoch_us(time.parse_time(F.col("u"), "unix")).alias("us")).first()
    assert r.u == r.l == r.i == datetime(2026, 1, 1) and r.b is None and r.us == 1767225600 * S


def test_kernels():
    for k in (shapes.Kernel.build(20.0), shapes.Kernel.build(12.0, 25.0), shapes.Kernel.build(1.0, 500.0), shapes.Kernel.build(30.0, 0.5)):
        t = np.linspace(-k.before - 5, k.after + 5, 50_001)
        v = k.evaluate(t)
        assert 0.99999 < v.max() <= 1.0 and np.all(np.isfinite(v)) and v[0] == v[-1] == 0
    z = np.array([-25.1, -25.0, -24.9, 24.9, 25.0, 25.1])
    assert np.all(np.diff(shapes.log_erfcx(z)[:3], 2) < 0.1) and abs(np.diff(shapes.log_erfcx(z)[3:], 2)[0]) < 1e-4


def test_profile_and_blocks(spark):
    rng = np.random.default_rng(5)
    e, x = 0.0, []
    for i in range(3000):
        e = 0.8 * e + 0.6 * rng.normal()
        x.append(1900 + e)
    rows = [("s", i * S + (600 * S if i >= 1500 else 0), x[i]) for i in range(3000)]
    p = profile.profile(spark.createDataFrame(rows, "name string, us long, v double"), "name", "us", "v", block_length=128, chunk_us=700 * S)
    r = p.stats.first()
    assert r.sample_period_s == 1.0 and r.n_source_points == 3000 and abs(r.lag1_autocorr - 0.8) < 0.05
    assert r.decorrelation_timescale_s == pytest.approx(-1 / math.log(r.lag1_autocorr))
    b = p.blocks.collect()
    assert len(b) == 2 * (1500 // 128) and all(len(v["values"]) == 128 and abs(sum(v["values"])) < 1e-6 for v in b)
    assert "lag-1" in p.summary("s")
    from ratioscope.errors import ProfilingError

    profile.check_sorted(spark.createDataFrame([(0, 5), (1, 5), (2_000_000, 9)], "i long, us long"), "us", "i")
    with pytest.raises(ProfilingError):
        profile.check_sorted(spark.createDataFrame([(0, 5), (2_000_000, 4)], "i long, us long"), "us", "i")
    flat = spark.createDataFrame([("s", i * S, 42.0) for i in range(10)], "k string, us long, v double")
    assert profile.lag1(flat, ["k"], "us", "v").first().lag1_autocorr == 0.0


def test_clusters(spark):
    rows = [(1, 40.0, -111.0, 0), (2, 40.001, -111.0, 0), (3, 40.002, -111.0, 0), (4, 41.0, -111.0, 0), (5, 40.0, -111.0, 3600 * S), (6, 0.0, 179.9999, 0), (7, 0.0, -179.9999, 0)]
    df = spark.createDataFrame(rows, "id long, lat double, lon double, us long")
    got = {r.id: r.cluster for r in cluster.dbscan(df, "id", "lat", "lon", "us", eps_m=150, m_per_s=1.0, min_samples=2).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: None, 5: None, 6: 6, 7: 6}


def test_zero_phase_filter(spark):
    t = np.arange(600)
    slow, fast = np.sin(2 * np.pi * t / 200), np.sin(2 * np.pi * t / 4)
    y = smooth.zero_phase(slow + fast, 4, 1 / 40, 1.0)
    assert np.abs(y - slow)[50:-50].max() < 0.02
    assert smooth.zero_phase(np.full(50, 7.0), 3, 0.1, 1.0) == pytest.approx(np.full(50, 7.0))
