"""Windows of many samples: sums, order statistics and fits whose cost doesn't grow with a window's size."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratioscope.functions.shapes import Kernel
from ratioscope.operators import align, baseline, cluster, ordered, propagate, regress, states, windowed
from ratioscope.operators.windowed import qn, rolling_qn_of, sliding
from ratioscope.plans.queries import _turned
from ratioscope.sources.series import read_series


@pytest.mark.parametrize("kind", ["normal", "rounded", "few", "equal", "unknown"])
def test_rolling_qn_is_that_of_each_window(kind):
    rng = np.random.default_rng(1)
    n = 400
    make = {"normal": lambda: rng.normal(size=n), "rounded": lambda: np.round(rng.exponential(50, n), 2), "few": lambda: rng.integers(0, 4, n).astype(float), "equal": lambda: np.zeros(n), "unknown": lambda: np.where(rng.random(n) < 0.2, np.nan, rng.normal(size=n))}
    t, x, rows = np.sort(rng.integers(0, 50_000, n)), make[kind](), np.arange(n)
    want = [qn(np.array(w.values())) for w in sliding(t, x, 6_000, rows)]
    np.testing.assert_array_equal(rolling_qn_of(t, x, 6_000, rows), want)


def test_rolling_qn_of_large_windows_takes_no_pass_over_each():
    rng = np.random.default_rng(2)
    x = np.round(rng.exponential(50, 9_000), 2)
    began = time.process_time()
    rolling_qn_of(np.arange(9_000), x, 2_500, np.arange(2_500, 6_500))
    assert time.process_time() - began < 4  # window by window: about 30 s


def test_york_of_large_windows():
    rng = np.random.default_rng(3)
    n = 6_000
    x = rng.exponential(50, n)
    y, sx, sy = 0.5 * x + rng.integers(0, 7, n) * 0.3, 0.5 + 0.02 * x, 0.4 + 0.01 * x
    first = np.maximum(np.arange(0, n, 9) - 700, 0)
    last = np.minimum(np.arange(0, n, 9) + 700, n)
    want = regress.york_windows(x, y, sx, sy, np.zeros(n), first, last)
    np.testing.assert_allclose(regress.york_dense(x, y, sx, sy, first, last), want, rtol=1e-9)
    steep = regress.york_windows(x, -9 * y, sx, sy, np.zeros(n), first, last)
    np.testing.assert_allclose(regress.york_dense(x, -9 * y, sx, sy, first, last), steep, rtol=1e-8)
    same = regress.york_dense(np.ones(n), y, sx, sy, first, last)
    assert np.isnan(same[:, 0]).all() and (same[:, 5] == last - first).all()


def test_matched_scores_of_large_windows(monkeypatch):
    rng = np.random.default_rng(4)
    t = np.sort(rng.integers(0, 40_000_000_000, 5_000))
    kernel, v, w = Kernel.build(1800.0), rng.normal(size=5_000), rng.random(5_000) + 0.1
    first, last = np.searchsorted(t, t - 7_200_000_000), np.searchsorted(t, t + 7_200_000_000, side="right")
    kv, kk = states._kernel_sums(kernel, t, v * w, w, t, first, last)
    k = [kernel.evaluate((t[a:b] - c) / 1e6) for a, b, c in zip(first, last, t)]
    np.testing.assert_allclose(kv, [(p * v[a:b] * w[a:b]).sum() for p, a, b in zip(k, first, last)], atol=1e-10)
    np.testing.assert_allclose(kk, [(p * p * w[a:b]).sum() for p, a, b in zip(k, first, last)], rtol=1e-10)


def test_largest_of_windows():
    rng = np.random.default_rng(5)
    v = rng.normal(size=100)
    first = rng.integers(0, 90, 300)
    last = first + rng.integers(0, 11, 300)
    assert windowed.window_max(v, first, last).tolist() == [max(v[a:b], default=-np.inf) for a, b in zip(first, last)]


@pytest.mark.parametrize("statistic", ["mean", "median", "circular"])
def test_pairs_are_never_rows(spark, statistic):
    rng = random.Random(6)
    fast = [(rng.choice("ab"), rng.randint(0, 2_000), rng.choice([None, rng.uniform(0, 360)])) for _ in range(500)]
    slow = [(rng.choice("ab"), rng.randint(-50, 2_050), rng.choice([None, 1.0, 2.0])) for _ in range(150)]
    slow += slow[:5]
    f, s = spark.createDataFrame(fast, "k string, us long, v double"), spark.createDataFrame(slow, "k string, us long, v double")
    out = align.pair(f, s, ["k"], "us", "v", "v", 100, statistic=statistic)
    joined = s.where("v is not null").select("k", F.col("us").alias("t"), F.col("v").alias("y")).join(f.where("v is not null"), "k").where("us >= t - 50 and us < t + 50")
    want = joined.groupBy("k", "t", "y").agg(align.BIN_STATISTICS[statistic](F.col("v")).alias("x"), F.count("v").alias("n"))
    got = {(r.k, r.us, r.y): (pytest.approx(r.x, abs=1e-9), r.n_native) for r in out.collect()}
    assert got == {(r.k, r.t, r.y): (r.x, r.n) for r in want.collect()} and got
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_exact_sigma_is_one_pass(spark):
    n = 20_000
    df = spark.range(n).select(F.lit(1).alias("bin"), F.expr("(id * 7919) % 20000 * 1000").alias("us"), (F.col("id") % 5 + 1.0).alias("s"))
    got = propagate.exact_random_of_mean(df, ["bin"], "us", "s", 0.5).first().sigma_mean
    s = np.array([r.s for r in df.orderBy("us").select("s").collect()])
    decay, before, total = np.exp(-1000 / 0.5e6), 0.0, 0.0
    for v in s:
        before *= decay
        total += v * (v + 2 * before)
        before += v
    assert got == pytest.approx(np.sqrt(total) / n)


def test_files_follow_each_other_by_name(spark, tmp_path):
    when = "timestamp_ntz'2024-01-01 00:00:00'"
    for name, value, rows in (("a", 1.0, 1), ("b", 2.0, 50_000)):  # Spark reads the larger file first
        spark.range(rows).selectExpr(f"{when} as t", f"{value} as v", "uuid() as x").coalesce(1).write.parquet(str(tmp_path / name))
        next((tmp_path / name).glob("*.parquet")).rename(tmp_path / f"{name}.parquet")
    for f in ("a", "b"):
        for p in (tmp_path / f).iterdir():
            p.unlink()
        (tmp_path / f).rmdir()
    assert [r.v for r in read_series(spark, str(tmp_path), "parquet").collect()] == [1]


def test_neighbours_go_by_no_broadcast(spark):
    df = spark.range(100).selectExpr("id", "40 + id % 7 * 0.001 as lat", "-110 + id % 11 * 0.001 as lon", "id * 1000000 as us")
    assert "BroadcastHashJoin" not in cluster.neighbours(df, "id", "lat", "lon", "us", 500.0, 0.5)._jdf.queryExecution().executedPlan().toString()


def test_sql_turns_like_the_operator():
    duckdb = pytest.importorskip("duckdb")
    got = duckdb.sql(f"SELECT {_turned('x')} FROM (VALUES (-2.842170943040401e-14), (-1.0), (0.0), (359.5), (360.0), (725.0)) v(x)").fetchall()
    assert [r[0] for r in got] == [0, 359, 0, 359.5, 0, 5]


def test_bootstrap_draws_values_as_often_as_weights_say(spark):
    rng = random.Random(7)
    df = spark.createDataFrame([("a", i * 10 + rng.randint(0, 3), rng.choice([None, rng.gauss(0, 1)])) for i in range(300)], "k string, us long, v double")
    rows = df.withColumn("w", baseline.block_weights(F.col("us"), 50, 4, 1)).orderBy("us").collect()
    t, x, w = np.array([r.us for r in rows]), np.array([np.nan if r.v is None else r.v for r in rows]), np.array([r.w for r in rows])
    q = np.array([[s.quantile(0.3) for s in sliding(t, x, 200, np.arange(len(t)), w[:, r])] for r in range(4)])
    got = baseline.baseline_sigma(df, ["k"], "us", "v", 400, 0.3, method="bootstrap", block_us=50, replicates=4, seed=1, chunk_us=700).orderBy("us").collect()
    np.testing.assert_allclose([r.baseline_sigma for r in got], q.std(axis=0, ddof=1), atol=1e-12)


def test_chunks_travel_as_arrow_and_keep_their_columns(spark):
    df = spark.sql("select 'a' s, id * 10 us, if(id % 3 = 0, null, double('NaN')) v, if(id % 2 = 0, null, id) i, map('k', id) m from range(20)")
    out = ordered.over_chunks(df, ["s"], "us", 20, {"n": "bigint"}, lambda t, c, own: {"n": np.full(len(own), len(t))}, chunk_us=50, only=F.col("us") < 100)
    rows = {r.us: r for r in out.collect()}
    assert sorted(rows) == list(range(0, 100, 10)) and rows[30].i == 3 and rows[20].i is None and rows[30].m == {"k": 3}
    assert rows[0].v is None and rows[10].v != rows[10].v
    far = df.unionByName(df.withColumn("us", F.col("us") + 3 * ordered.DAY))
    assert ordered.over_chunks(far, ["s"], "us", 20, {"n": "bigint"}, lambda t, c, own: {"n": np.full(len(own), t[-1] - t[0])}, chunk_us=10 * ordered.DAY).agg(F.max("n")).first()[0] == 190
