import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratioscope.operators import noise
from ratioscope.operators.windowed import QN_SCALE, QN_SMALL, SortedWindow, kth_difference, qn, sliding


@pytest.mark.parametrize("load", [1, 3, 256])
def test_sorted_window_keeps_order_statistics(load):
    rng = random.Random(load)
    w, plain = SortedWindow(load), []
    assert np.isnan(w.mad()[1]) and np.isnan(w.quantile(0.5))
    for _ in range(1500):
        if plain and rng.random() < 0.45:
            x = plain.pop(rng.randrange(len(plain)))
            w.remove(x)
        else:
            x = rng.choice([rng.gauss(0, 1), float(rng.randint(-3, 3))])
            plain.append(x)
            w.add(x)
        s = sorted(plain)
        assert w.values() == s and len(w) == len(s)
        if s:
            i, p = rng.randrange(len(s)), rng.random()
            assert w.at(i) == s[i] and w.below(s[i]) == s.index(s[i])
            assert w.quantile(p) == pytest.approx(np.quantile(s, p))
            m = np.median(s)
            assert w.mad() == (pytest.approx(m), pytest.approx(np.median(np.abs(np.array(s) - m))))


def test_kth_difference_and_qn():
    rng = np.random.default_rng(0)
    for n in [2, 3, 5, 9, 10, 40, 121]:
        for x in (rng.normal(size=n), rng.integers(0, 4, n).astype(float), np.zeros(n)):
            x.sort()
            pairs = sorted(b - a for a, b in combinations(x, 2))
            for k in {1, len(pairs), (len(pairs) + 1) // 2, (len(pairs) + 3) // 4}:
                assert kth_difference(x, k) == pairs[k - 1]
            h = n // 2 + 1
            factor = QN_SMALL.get(n, n / (n + (1.4 if n % 2 else 3.8)))
            assert qn(x) == pytest.approx(QN_SCALE * factor * pairs[h * (h - 1) // 2 - 1])
    assert np.isnan(qn(np.array([1.0])))
    assert qn(np.sort(rng.normal(3, 2, 4000))) == pytest.approx(2, rel=0.05)


def test_sliding_skips_unknown_values_and_gaps():
    t = np.array([0, 1, 2, 3, 50, 51, 51, 200])
    x = np.array([1.0, np.nan, 3.0, 2.0, 5.0, np.nan, 4.0, np.nan])
    got = [w.values() for w in sliding(t, x, 2, np.arange(len(t)))]
    want = [sorted(v for s, v in zip(t, x) if c - 2 < s <= c + 2 and v == v) for c in t]
    assert got == want
    twice = [w.values() for w in sliding(t, x, 2, np.arange(3), np.array([2, 1, 0, 1, 1, 1, 1, 1]))]
    assert twice == [[1.0, 1.0], [1.0, 1.0, 2.0], [2.0]]


@pytest.mark.parametrize("name", ["mad", "qn", "diff_qn", "diff_mad"])
def test_chunks_change_nothing(spark, name):
    rng = random.Random(4)
    rows = [(s, rng.randint(0, 500), rng.choice([None, rng.gauss(0, 1), float(rng.randint(0, 2))]), i) for s in "ab" for i in range(150)]
    rows = list({(s, t): (s, t, v, i) for s, t, v, i in rows}.values()) + [("c", 5, 1.0, 0), ("d", 5, None, 1)]
    df = spark.createDataFrame(rows, "s string, us long, v double, i long")
    runs = [{(r.s, r.us): r.sigma for r in noise.ROLLING[name](df, ["s"], "us", "v", 60, chunk_us=c).collect()} for c in (60, 10_000)]
    assert runs[0].keys() == runs[1].keys()
    assert all((a is None) == (runs[1][k] is None) and (a is None or a == pytest.approx(runs[1][k], abs=1e-12)) for k, a in runs[0].items())
    assert runs[0]["c", 5] is None or name == "mad"
    assert noise.ROLLING[name](df.limit(0), ["s"], "us", "v", 60).count() == 0
    one = noise.ROLLING[name](df.where(F.col("s") == "a"), ["s"], "us", "v", 60, step=1.2).agg(F.min("sigma")).first()[0]
    assert one >= 1.2 / 12**0.5
