import numpy as np
import pytest

from ratioscope.operators.smooth import System, butterworth, sections, zero_phase


def plain(x, order, cutoff, rate):
    """Sample by sample, section by section."""
    pad = min(len(x) - 1, 3 * (order + 1) * max(1, int(rate / cutoff / 6)))
    y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    for _ in range(2):
        for b, a in sections(order, cutoff, rate):
            z1, z2, out = y[0] * (1 - b[0]), y[0] * (b[2] - a[1]), []
            for v in y:
                u = b[0] * v + z1
                z1, z2 = b[1] * v - a[0] * u + z2, b[2] * v - a[1] * u
                out.append(u)
            y = np.array(out)
        y = y[::-1]
    return y[pad : pad + len(x)]


@pytest.mark.parametrize("order,cutoff", [(2, 0.1), (4, 0.02), (5, 0.2), (4, 0.001)])
def test_blocks_equal_single_steps(order, cutoff):
    x = np.random.default_rng(order).normal(size=700).cumsum()
    for n in (3, 4, 127, 128, 129, 700):
        assert zero_phase(x[:n], order, cutoff, 1.0) == pytest.approx(plain(x[:n], order, cutoff, 1.0), abs=1e-8)
    s = System(order, cutoff, 1.0)
    z = s.rest * x[0]
    one, _ = s.run(x, z)
    a, mid = s.run(x[:333], z)
    b, _ = s.run(x[333:], mid)
    assert np.concatenate([a, b]) == pytest.approx(one, abs=1e-9)


def test_parts_and_chunks_change_nothing(spark):
    rng = np.random.default_rng(1)
    rows = []
    for s, gaps in (("long", []), ("gaps", [100, 101, 250]), ("tiny", [1, 2, 3, 5])):
        us = 0
        for i in range(400 if s != "tiny" else 8):
            us += 10_000_000 if i in gaps else 1_000_000
            rows.append((s, us, float(rng.normal()) if i % 97 else None, i))
    rows += [("one", 5, 1.0, 0), ("none", 5, None, 0)]
    df = spark.createDataFrame(rows, "s string, us long, v double, k int").repartition(3)
    runs = [{(r.s, r.k): r.smooth for r in butterworth(df, ["s"], "us", "v", 20.0, chunk_us=c, part_rows=p).collect()} for c, p in ((86_400_000_000, 1 << 16), (7_000_000, 9), (50_000_000, 64))]
    assert set(runs[0]) == {(s, k) for s, _, v, k in rows if v is not None}
    for other in runs[1:]:
        assert other == {k: pytest.approx(v, abs=1e-9) for k, v in runs[0].items()}
    # a gap-free run of the long stream, by hand
    x = np.array([v for s, _, v, k in rows if s == "long" and 97 < k < 194])
    assert [runs[1]["long", k] for k in range(98, 194)] == pytest.approx(plain(x, 4, 1 / 20, 1.0).tolist(), abs=1e-8)
    assert butterworth(df.limit(0), ["s"], "us", "v", 20.0).count() == 0
