import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratioscope.operators.baseline import baseline_sigma, baseline_sweep
from ratioscope.operators.regress import rolling_york, york_line
from ratioscope.operators.sweep import detection_sweep

S = 1_000_000


@pytest.mark.parametrize("with_r", [False, True])
def test_rolling_york_equals_single_windows(spark, with_r):
    rng = random.Random(2)
    rows = []
    for s in "ab":
        for t in sorted(rng.sample(range(2000), 120)):
            x = rng.gauss(10, 3)
            rows.append((s, t, rng.choice([None, x, x, x, 5.0]), 2 * x + rng.gauss(0, 0.5), 0.2 + 0.1 * rng.random(), 0.4, rng.uniform(-0.5, 0.5)))
    rows.append(("c", 5, 1.0, 1.0, 0.1, 0.1, 0.0))
    df = spark.createDataFrame(rows, "k string, us long, x double, y double, sx double, sy double, r double").repartition(3)
    runs = [{(r.k, r.us): r for r in rolling_york(df, ["k"], "us", 200, r="r" if with_r else None, chunk_us=c).collect()} for c in (200, 100_000)]
    known = [r for r in rows if r[2] is not None]
    assert len(runs[0]) == len(known) == len(runs[1])
    for s, t, *_ in known:
        w = np.array([r[2:] for r in known if r[0] == s and t - 100 < r[1] <= t + 100]).T
        want = york_line(*w[:4], w[4] if with_r else 0.0)
        for run in runs:
            got = run[s, t]
            assert got.n == want.n
            if np.isnan(want.slope):
                assert got.slope is None
            else:
                assert (got.slope, got.intercept, got.sigma_slope, got.sigma_intercept, got.s) == pytest.approx((want.slope, want.intercept, want.sigma_slope, want.sigma_intercept, want.s), rel=1e-6, abs=1e-9)
    assert rolling_york(df.limit(0), ["k"], "us", 200).count() == 0


def test_baseline_sigma_is_the_quantile_s_scatter(spark):
    """Over many draws of white noise both ways give the scatter that the quantile shows; chunks change nothing."""
    rng = np.random.default_rng(1)
    rows = [(k, int(i) * S, float(v)) for k in range(40) for i, v in enumerate(rng.normal(size=60))]
    df = spark.createDataFrame(rows, "k int, us long, v double")
    true = np.std([np.quantile([v for k, _, v in rows if k == j], 0.1) for j in range(40)])
    for method, rel in (("order", 0.25), ("bootstrap", 0.35)):
        runs = [sorted((r.k, r.us, r.sig) for r in baseline_sigma(df, ["k"], "us", "v", 2000 * S, 0.1, method=method, block_us=S, name="sig", chunk_us=c).collect()) for c in (10 * S, 10_000 * S)]
        assert runs[0] == [(k, t, pytest.approx(v, abs=1e-12)) for k, t, v in runs[1]]
        assert np.mean([v for *_, v in runs[0]]) == pytest.approx(true, rel=rel)
    odd = spark.createDataFrame([(1, 0, 1.0), (2, 0, None), (3, 0, 1.0), (3, S, None), (3, 2 * S, 3.0)], "k int, us long, v double")
    for method in ("order", "bootstrap"):
        got = {(r.k, r.us): r.baseline_sigma for r in baseline_sigma(odd, ["k"], "us", "v", 100 * S, 0.5, method=method, block_us=S).collect()}
        assert got[1, 0] is None and got[2, 0] is None and got[3, S] > 0
        assert baseline_sigma(odd.limit(0), ["k"], "us", "v", S, 0.5, method=method).count() == 0
    with pytest.raises(ValueError):
        baseline_sigma(odd, ["k"], "us", "v", S, 0.5, method="guess")


def test_blocks_widen_correlated_baselines(spark):
    """In noise that wanders, blocks longer than its memory give a larger sigma than single samples do."""
    rng = np.random.default_rng(3)
    x = np.convolve(rng.normal(size=700), np.ones(40) / 40**0.5, "valid")[:600]
    df = spark.createDataFrame([(0, i * S, float(v)) for i, v in enumerate(x)], "k int, us long, v double")
    mean = lambda b: baseline_sigma(df, ["k"], "us", "v", 400 * S, 0.1, method="bootstrap", block_us=b * S, replicates=40).agg(F.avg("baseline_sigma")).first()[0]
    assert mean(60) > 2 * mean(1)


def test_sigma_is_carried_into_thresholds(spark):
    rng = np.random.default_rng(5)
    bump = np.exp(-(((np.arange(400) % 100) - 50) ** 2) / 30) * 8
    df = spark.createDataFrame([("a", i * S, float(v), 0.5) for i, v in enumerate(rng.normal(0, 0.5, 400) + bump)], "s string, us long, v double, e double")
    run = lambda m: detection_sweep(df, ["s"], "us", "v", windows_us=[80 * S], quantiles=[0.05, 0.2], enter=[4.0], leave=1.0, sigma="e", noise_window_us=80 * S, max_gap_us=5 * S, min_duration_us=S, baseline_sigma=m, chunk_us=90 * S)
    plain, wide = run(None).collect(), run("order").collect()
    assert len(plain) >= len(wide) >= 8
    assert all(r.amplitude_sigma > 0.5 for r in wide) and "amplitude_sigma" not in plain[0]
    both = baseline_sweep(df, ["s"], "us", "v", [80 * S], [0.05, 0.2], sigma="order", chunk_us=90 * S)
    one = baseline_sigma(df, ["s"], "us", "v", 80 * S, 0.2, chunk_us=700 * S)
    pair = both.where("quantile = 0.2").join(one.select("us", F.col("baseline_sigma").alias("b")), "us")
    assert pair.count() == 400 and pair.where("abs(baseline_sigma - b) > 1e-12").count() == 0
