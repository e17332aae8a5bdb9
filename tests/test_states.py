import math
import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratioscope.functions.shapes import Kernel
from ratioscope.operators.states import DETECTORS, Chain, hmm_states, matched_peaks, matched_scores
from ratioscope.operators.sweep import detection_sweep

S = 1_000_000


def test_chain_finds_the_best_of_all_sequences():
    rng = random.Random(0)
    for _ in range(60):
        e = np.array([rng.gauss(0, 2) for _ in range(rng.randint(1, 9))])
        enter, leave = rng.uniform(0.01, 0.4), rng.uniform(0.01, 0.4)
        step = {(0, 0): 1 - enter, (0, 1): enter, (1, 0): leave, (1, 1): 1 - leave}
        best = max(product((0, 1), repeat=len(e)), key=lambda p: sum(math.log(step[a, b]) + b * x for a, b, x in zip((0, *p), p, e)))
        assert tuple(Chain(enter, leave).decode(e)) == best
    for bad in ((0.0, 0.5), (0.6, 0.5), (0.1, 1.0)):
        with pytest.raises(ValueError):
            Chain(*bad)


def test_chunks_change_no_state(spark):
    rng = random.Random(1)
    rows = [(k, t * S, rng.choice([None, rng.gauss(0, 1), rng.gauss(5, 2) if t % 50 > 35 else rng.gauss(0, 1)]), 1.0, t) for k in "ab" for t in range(300)] + [("c", 0, 9.0, 1.0, 0), ("d", 0, None, None, 0)]
    df = spark.createDataFrame(rows, "k string, us long, d double, s double, i int").repartition(3)
    runs = [{(r.k, r.i): r.state for r in hmm_states(df, ["k"], "us", F.col("d"), F.col("s"), chunk_us=c).collect()} for c in (S, 7 * S, 10_000 * S)]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == len(rows) and 20 < sum(runs[0].values()) < 250
    assert runs[0]["c", 0] in (0, 1) and runs[0]["d", 0] == 0
    assert hmm_states(df.limit(0), ["k"], "us", F.col("d"), F.col("s")).count() == 0


def test_detector_by_name_finds_plumes(spark):
    rng = np.random.default_rng(4)
    bump = np.exp(-(((np.arange(900) % 150) - 75) ** 2) / 60) * 6
    df = spark.createDataFrame([("a", i * S, float(v), 0.5) for i, v in enumerate(rng.normal(0, 0.5, 900) + bump)], "s string, us long, v double, e double")
    run = lambda d, e, leave: detection_sweep(df, ["s"], "us", "v", windows_us=[140 * S], quantiles=[0.1], enter=e, leave=leave, sigma="e", noise_window_us=140 * S, max_gap_us=5 * S, min_duration_us=2 * S, detector=d, chunk_us=200 * S).collect()
    for d, e, leave in (("hysteresis", [4.0], 1.0), ("hmm", [0.01, 0.05], 0.1)):
        got = run(d, e, leave)
        for x in e:
            assert [round(r.peak_us / S / 150 - 0.5) for r in got if r.enter_sigma == x] == list(range(6))
    assert set(DETECTORS) == {"hysteresis", "hmm"}


@pytest.mark.parametrize("tau", [0.0, 8.0])
def test_matched_filter_equals_brute_force(spark, tau):
    rng = random.Random(2)
    kernel = Kernel.build(3.0, tau)
    rows = [(k, t, rng.choice([None, 4 * float(kernel.evaluate(np.array([(t - c) / S]))[0]) + rng.gauss(0, 0.3)]), rng.choice([0.2, 0.4, None])) for k, c in (("a", 60 * S), ("b", 111 * S)) for t in sorted(rng.sample(range(0, 200 * S, S // 2), 180))] + [("c", 5, 1.0, 0.5), ("d", 5, None, 0.5)]
    df = spark.createDataFrame(rows, "k string, us long, v double, s double").repartition(3)
    runs = [{(r.k, r.us): (r.score, r.amplitude) for r in matched_scores(df, ["k"], "us", "v", "s", kernel, chunk_us=c).collect()} for c in (10 * S, 10_000 * S)]
    want = {}
    for k, t, *_ in rows:
        own = [(float(kernel.evaluate(np.array([(u - t) / S]))[0]), v, 1 / s**2) for j, u, v, s in rows if j == k and v is not None and s]
        kv, kk = sum(a * v * w for a, v, w in own), sum(a * a * w for a, v, w in own)
        want[k, t] = (kv / kk**0.5, kv / kk) if kk else (None, None)
    for run in runs:
        assert run.keys() == want.keys() and all(run[k] == (pytest.approx(w, abs=1e-9) if w[0] is not None else w) for k, w in want.items())
    peaks = {(r.k, r.us): r.amplitude for r in matched_peaks(df, ["k"], "us", "v", "s", kernel, threshold=8.0, apart_us=30 * S, chunk_us=25 * S).collect()}
    top = {(k, t) for (k, t), (x, _) in want.items() if x is not None and x >= 8 and not any(j == k and abs(u - t) <= 30 * S and y is not None and (y > x or y == x and u < t) for (j, u), (y, _) in want.items())}
    assert set(peaks) == top and {k for k, _ in top} == {"a", "b"} and all(abs(a - 4) < 1 for a in peaks.values())
    assert matched_peaks(df.limit(0), ["k"], "us", "v", "s", kernel, threshold=1.0, apart_us=S).count() == 0
