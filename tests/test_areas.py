import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratioscope.operators.areas import area_ratios, event_areas, net_areas

S = 1_000_000


def brute(samples, lo, hi, gap):
    """Area by fine steps of weights: the integral of hat functions over [lo, hi], step by step."""
    w, covered = [0.0] * len(samples), 0
    for i in range(len(samples) - 1):
        (t0, *_), (t1, *_) = samples[i], samples[i + 1]
        a, b = max(t0, lo), min(t1, hi)
        if 0 < t1 - t0 <= gap and a < b:
            late = ((b - t0) ** 2 - (a - t0) ** 2) / 2 / (t1 - t0)
            w[i] += (b - a - late) / 1e6
            w[i + 1] += late / 1e6
            covered += b - a
    use = [(x, s) for x, s in zip(w, samples) if x]
    return sum(x * s[1] for x, s in use), sum((x * s[2]) ** 2 for x, s in use) ** 0.5, sum(x * s[3] for x, s in use), covered


@pytest.mark.parametrize("chunk", [7 * S, 10_000 * S])
def test_areas_equal_brute_force(spark, chunk):
    rng = random.Random(1)
    rows, ev = [], []
    for k in "ab":
        ts = sorted(rng.sample(range(0, 400 * S, S // 4), 200))
        rows += [(k, t, rng.choice([None, rng.gauss(5, 2), rng.gauss(5, 2)]), rng.random(), 0.1) for t in ts]
        ev += [(k, i, t, t + rng.randint(0, 60 * S)) for i, t in enumerate(rng.sample(range(-20 * S, 420 * S), 25))]
    ev.append(("none", 0, 5, 9))
    df = spark.createDataFrame(rows, "k string, us long, v double, s double, c double").repartition(3)
    events = spark.createDataFrame(ev, "k string, event_no int, start_us long, end_us long")
    got = {(r.k, r.event_no): r for r in event_areas(df, events, ["k"], "us", "v", sigma="s", common="c", max_gap_us=6 * S, chunk_us=chunk).collect()}
    assert len(got) == len(ev)
    for k, i, lo, hi in ev:
        r = got[k, i]
        assert (r.area, r.sigma_rand, r.sigma_base, r.covered_us) == pytest.approx(brute([(t, v, s, c) for x, t, v, s, c in rows if x == k and v is not None], lo, hi, 6 * S), abs=1e-9)
    assert event_areas(df.limit(0), events, ["k"], "us", "v", max_gap_us=S).where("area != 0 or n != 0").count() == 0
    assert event_areas(df, events.limit(0), ["k"], "us", "v", max_gap_us=S).count() == 0
    half = event_areas(df.withColumn("s", F.when(F.col("us") % 3 == 0, F.col("s"))), events, ["k"], "us", "v", sigma="s", max_gap_us=6 * S)
    assert half.where("sigma_rand is null").count() > 0 and half.where("area is null").count() == 0


def test_nets_of_a_tree_sum_up_to_the_root(spark):
    areas = spark.createDataFrame([("a", 0, 0, 2.0, 0.3), ("a", 0, 1, 3.0, 0.4), ("a", 1, 0, 7.0, 0.6), ("a", 2, 5, 20.0, 1.0), ("a", 0, 9, 1.0, 0.1)], "k string, level int, event_no int, area double, sigma_rand double")
    links = spark.createDataFrame([("a", 0, 0, 0), ("a", 0, 1, 0), ("a", 1, 0, 5)], "k string, child_level int, child_no int, parent_no int")
    got = {(r.level, r.event_no): (r.net_area, r.n_children, r.net_sigma_rand) for r in net_areas(areas, links, ["k"], "level").collect()}
    assert got == {(0, 0): (2.0, 0, 0.3), (0, 1): (3.0, 0, 0.4), (0, 9): (1.0, 0, 0.1), (1, 0): (2.0, 2, pytest.approx((0.36 - 0.25) ** 0.5)), (2, 5): (13.0, 1, pytest.approx(0.8))}
    assert sum(got[k][0] for k in got if k != (0, 9)) == 20.0


def test_area_ratio_recovers_a_ratio_without_pairing(spark):
    rng = np.random.default_rng(2)
    peak = lambda t: 50 * np.exp(-(((t % 100) - 50) ** 2) / 50)
    tx, ty = np.arange(0, 2000, 1.0), np.arange(0.3, 2000, 2.5)
    x = [("x", int(t * S), float(peak(t) + rng.normal(0, 0.5)), 0.5) for t in tx]
    y = [("y", int(t * S), float(0.2 * peak(t) + rng.normal(0, 0.1)), 0.1) for t in ty]
    ev = [(i, int((100 * i + 30) * S), int((100 * i + 70) * S)) for i in range(20)]
    df = spark.createDataFrame(x + y, "k string, us long, v double, s double")
    both = [event_areas(df.where(F.col("k") == k), spark.createDataFrame([(k, *e) for e in ev], "k string, event_no int, start_us long, end_us long"), ["k"], "us", "v", sigma="s", max_gap_us=5 * S) for k in "xy"]
    got = area_ratios(*both, ["event_no"]).collect()
    assert len(got) == 20 and all(abs(r.area_ratio - 0.2) < 5 * r.sigma_area_ratio + 0.004 and r.sigma_area_ratio < 0.01 for r in got)
    late = area_ratios(both[0], both[1].withColumn("covered_us", F.lit(1)), ["event_no"])
    assert late.where("area_ratio is not null").count() == 0
