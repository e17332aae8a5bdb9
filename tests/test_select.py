import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratioscope.operators import noise, select
from ratioscope.scratch import Scratch


def of(rows, p):
    x = sorted(v for v in rows if v is not None and v == v)
    return float(np.quantile(x, p)) if x else None


@pytest.mark.parametrize("most", [10, 50_000])
def test_quantiles_equal_numpy(spark, most):
    rng = random.Random(most)
    draw = {"a": lambda: rng.gauss(0, 1), "ties": lambda: rng.choice([1.0, 1.0, 2.0]), "wide": lambda: rng.choice([1e300, -1e300, 1.0]) * rng.random(), "one": lambda: 7.5, "none": lambda: None, "gaps": lambda: rng.choice([None, float("nan"), rng.random()])}
    rows = [(k, f()) for k, f in draw.items() for _ in range(300)] + [("two", 1.0), ("two", 2.0), ("single", 3.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    ps = [0.0, 0.05, 0.5, 0.75, 1.0]
    got = {r.k: r for r in select.quantiles(df, ["k"], {"q": (F.col("v"), ps), "m": (F.col("v") * 2, [0.5])}, most=most, bins=16).collect()}
    assert set(got) == {k for k, _ in rows}
    for k in got:
        own = [v for c, v in rows if c == k]
        want = [of(own, p) for p in ps]
        assert (got[k].q is None) == (want[0] is None)
        if want[0] is not None:
            assert got[k].q == pytest.approx(want, rel=1e-12) and got[k].m == [pytest.approx(2 * of(own, 0.5), rel=1e-12)]
    assert select.quantiles(df.limit(0), ["k"], {"q": (F.col("v"), ps)}, most=most).count() == 0


def test_infinite_values_are_unknown(spark):
    x = [float("-inf")] * 5 + [1.0, 2.0, 3.0] + [float("inf")] * 9
    df = spark.createDataFrame([(v,) for v in x], "v double").withColumn("k", F.lit(1))
    assert [select.quantiles(df, ["k"], {"q": (F.col("v"), [0.0, 0.5, 1.0])}, most=m, bins=8).first().q for m in (2, 99)] == [[1.0, 2.0, 3.0]] * 2


def test_rows_of_one_group_stay_bounded(spark):
    """Ten times the rows: what is handed to the last, sorting step is no more than the bound."""
    for n in (20_000, 200_000):
        df = spark.range(n).select(F.lit(1).alias("k"), F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double").alias("v"))
        scratch = Scratch(spark, "bounded")
        rows = df.select("k", F.col("v").alias("_v"))
        ranks = spark.createDataFrame([(1, n // 2)], "k int, _rank long")
        got = select._ranked(rows, ["k"], ranks, scratch, 1000, 64).first()._value
        assert got == sorted(r.v for r in df.collect())[n // 2]
        last = spark.read.parquet(f"{scratch.root}/*-rows*")
        assert last.groupBy("_cell").count().where("_cell like '%.%'").agg(F.min("count")).first()[0] <= 1000


def test_noise_is_the_same_by_search(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(s, i * 1_000_000, rng.choice([None, rng.gauss(3, 1)])) for s in "ab" for i in range(500)] + [("c", 0, 1.0), ("d", 0, None)]
    df = spark.createDataFrame(rows, "s string, us long, v double")
    plain = {n: sorted(map(tuple, f(df, ["s"], "us", "v").collect())) for n, f in noise.ESTIMATORS.items() if n in ("diff_mad", "mad")}
    monkeypatch.setattr(select, "MOST", 20)
    monkeypatch.setattr(select.quantiles, "__kwdefaults__", select.quantiles.__kwdefaults__ | {"most": 20})
    for n, want in plain.items():
        got = sorted(map(tuple, noise.ESTIMATORS[n](df, ["s"], "us", "v").collect()))
        assert [r[0] for r in got] == [r[0] for r in want] and [r[2] for r in got] == [r[2] for r in want]
        assert [r[1] for r in got] == [w if w is None else pytest.approx(w, rel=1e-12) for w in (r[1] for r in want)]
