import random

import numpy as np
import pytest

from ratioscope.operators.changes import Candidates, change_points

S = 1_000_000


def brute(x, w, penalty):
    """Begin of each sample's piece by the full table of costs, without pruning."""
    best, begin = [-penalty], []
    for i in range(len(x)):
        own = []
        for j in range(i + 1):
            v, u = x[j : i + 1], w[j : i + 1]
            own.append(best[j] + penalty + float(u @ (v - (u @ v) / u.sum()) ** 2))
        k = int(np.argmin(own))
        best.append(own[k])
        begin.append(k)
    out, end = [], len(x) - 1
    while end >= 0:
        out.append((begin[end], end))
        end = begin[end] - 1
    return out[::-1]


def test_pruned_candidates_find_the_cheapest():
    rng = np.random.default_rng(0)
    for _ in range(30):
        x = np.concatenate([rng.normal(rng.choice([0, 3, 8]), 1, rng.integers(1, 15)) for _ in range(5)])
        w, c = rng.uniform(0.5, 2, len(x)), Candidates(6.0)
        begin = [c.add(i, a, b) for i, (a, b) in enumerate(zip(x, w))]
        got, end = [], len(x) - 1
        while end >= 0:
            got.append((begin[end], end))
            end = begin[end] - 1
        assert got[::-1] == brute(x, w, 6.0)
    flat = Candidates(6.0)
    for i in range(3000):
        flat.add(i, float(i // 500 * 10 + rng.normal()), 1.0)
    assert len(flat.at) < 600  # of those since the last change at most


def test_parts_change_nothing(spark):
    rng = random.Random(3)
    rows, truth = [], {}
    for k in "ab":
        us, level = 0, 0.0
        for i in range(260):
            us += 30 * S if i in (90, 91) else S
            level = rng.choice([0.0, 4.0, 9.0]) if i % 37 == 0 else level
            rows.append((k, us, rng.choice([None, *[1000 + level + rng.gauss(0, 1)] * 5]), rng.choice([1.0, 1.0, 0.7]), i))
    rows += [("c", 5, 2.0, 1.0, 0), ("d", 5, None, 1.0, 0), ("e", 5, 1.0, 0.0, 0)]
    df = spark.createDataFrame(rows, "k string, us long, v double, s double, i int").repartition(3)
    runs = [sorted(tuple(r) for r in change_points(df, ["k"], "us", "v", "s", penalty=8.0, max_gap_us=5 * S, part_rows=p, chunk_us=c).collect()) for p, c in ((1 << 17, 10_000 * S), (7, 11 * S), (60, 50 * S))]
    assert [r[:4] + r[5:] for r in runs[0]] == [r[:4] + r[5:] for r in runs[1]] == [r[:4] + r[5:] for r in runs[2]]
    assert [r[4] for r in runs[0]] == pytest.approx([r[4] for r in runs[1]])
    for k in "ab":
        known = [(u, v, s) for j, u, v, s, _ in rows if j == k and v is not None and s > 0]
        cuts = [0, *(i for i in range(1, len(known)) if known[i][0] - known[i - 1][0] > 5 * S), len(known)]
        for no, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            own = known[lo:hi]
            x, w = np.array([v for _, v, _ in own]), np.array([1 / s**2 for *_, s in own])
            truth[k, no] = [(own[a][0], own[b][0], b - a + 1) for a, b in brute(x - x[0], w, 8.0)]
    got = {}
    for k, seg, lo, hi, _, n in runs[0]:
        got.setdefault((k, seg), []).append((lo, hi, n))
    assert got.pop(("c", 0)) == [(5, 5, 1)] and got == truth
    assert change_points(df.limit(0), ["k"], "us", "v", "s", penalty=8.0, max_gap_us=S).count() == 0
