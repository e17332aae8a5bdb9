import json

import pytest
from pyspark.sql import functions as F

from ratioscope.config import SyntheticConfig
from ratioscope.config.manifest import InstrumentConfig
from ratioscope.errors import BundleError, IngestError, SyntheticError
from ratioscope.operators.profile import Profile
from ratioscope.sources import paths
from ratioscope.sources.bundle import CATALOG, load_bundle, save_bundle
from ratioscope.sources.delimited import read_delimited
from ratioscope.sources.icartt import parse_file, read_icartt
from ratioscope.sources.synthetic import ar1, build_times, generate, schedule
from tests.test_config import SYNTHETIC, changed

ICARTT = """15, 1001
PI
Org
Inst
Mission
1, 1
2026, 01, 02, 2026, 02, 01
1
Time_Start, seconds
2
1, 10
-9999, -999.9
CH4, ppb
C2H6, ppt
Time_Start,CH4,C2H6
0,1900.5,2.0
1,-9999,3.0
2,oops,1
3,1901,-999.9
"""


def test_paths():
    assert paths.template_glob("{site}/%Y/%m/*.ict") == "*/*/*/*.ict"
    import re

    m = re.match(paths.template_regex("{site}/%Y/{site}_%m?.csv"), "slc/2026/slc_01x.csv")
    assert m["site"] == "slc" and not re.match(paths.template_regex("{a}/%Y"), "b/26")
    files = ["d/VOC_SLC_20260101_R0.ict", "d/VOC_SLC_20260101_R10.ict", "d/VOC_SLC_20260101_R9.ict", "d/VOC_SLC_20260101.ict", "d/VOC_SLC_20260101_RA.ict", "d/VOC_SLC_20260102_RA.ict", "d/odd.ict"]
    assert paths.latest_revisions(files) == ["d/VOC_SLC_20260101_R10.ict", "d/VOC_SLC_20260102_RA.ict", "d/odd.ict"]


def test_delimited(spark, tmp_path):
    (tmp_path / "a" / "2026").mkdir(parents=True)
    (tmp_path / "b" / "2026").mkdir(parents=True)
    (tmp_path / "a" / "2026" / "x1.csv").write_text("t,CH4,flag\n1767225600,2.0,0\n1767225601,-9999,1\nbad,3,0\n")
    (tmp_path / "b" / "2026" / "x2.csv").write_text("t,CH4,flag\n1767225602.5,oops,0\n")
    inst = InstrumentConfig.read({"loader": {"format": "csv", "path_template": "{site}/%Y/x*.csv", "na_values": ["-9999"], "time": {"column": "t", "format": "unix"}}, "variables": {"ch4": {"column": "CH4", "units": "ppm"}}})
    rows = read_delimited(spark, f"file://{tmp_path}", inst).orderBy("us").collect()
    assert [(r.site, r.us - 1767225600_000000, r.CH4) for r in rows] == [("a", 0, "2.0"), ("a", 1_000_000, None), ("b", 2_500_000, "oops")]
    one = InstrumentConfig.read({"loader": {"format": "csv", "path_template": "h.csv", "header_row": 1, "comment": "#", "time": {"column": "t", "format": "%Y-%m-%d %H:%M:%S"}}, "variables": {"v": {"column": "v", "units": ""}}})
    (tmp_path / "h.csv").write_text("# c\ntitle\nt,v\n2026-01-01 00:00:01,5\n")
    assert [r.v for r in read_delimited(spark, f"file://{tmp_path}", one).collect()] == ["5"]
    with pytest.raises(IngestError):
        read_delimited(spark, f"file://{tmp_path}/none", inst)


def test_icartt(spark, tmp_path):
    df = parse_file(ICARTT)
    assert df.us.tolist() == [1767312000_000000 + i * 1_000_000 for i in range(4)]  # a bad cell costs only itself
    assert df.CH4.fillna(-1).tolist() == [1900.5, -1, -1, 1901] and df.C2H6.fillna(-1).tolist() == [20, 30, 10, -1]
    odd = parse_file(ICARTT + "4,1\nlate,1,2\n 5 , 7 ,\n")
    assert odd.us.tolist()[4:] == [1767312005_000000] and odd.CH4.tolist()[4] == 7 and odd.C2H6.isna().tolist()[4]
    assert parse_file(ICARTT.split("0,1900.5")[0]).empty
    (tmp_path / "V_S_20260102_R0.ict").write_text(ICARTT)
    (tmp_path / "V_S_20260102_R1.ict").write_text(ICARTT)
    (tmp_path / "V_S_20260103_R0.ict").write_text("36, 2110\n")
    inst = InstrumentConfig.read({"loader": {"format": "icartt", "path_template": "{kind}_S_*.ict"}, "variables": {"ch4": {"column": "CH4", "units": "ppb"}, "x": {"column": "gone", "units": ""}}})
    rows = read_icartt(spark, f"file://{tmp_path}", inst).orderBy("us").collect()
    assert {r.kind for r in rows} == {"V"}
    assert len(rows) == 5 and rows[0].problem and rows[0].us is None and {r.file[-6:-4] for r in rows[1:]} == {"R1"} and rows[1].CH4 == 1900.5


def test_bundle_checks(spark, tmp_path):
    with pytest.raises(BundleError):
        load_bundle(spark, f"file://{tmp_path}/none")
    (tmp_path / "b").mkdir()
    with pytest.raises(BundleError, match="missing"):
        load_bundle(spark, f"file://{tmp_path}/b")
    (tmp_path / "b" / "bundle.json").write_text(json.dumps({"format_version": 9, "streams": []}))
    with pytest.raises(BundleError, match="format"):
        load_bundle(spark, f"file://{tmp_path}/b")


def test_generated_data_keep_the_invariants(spark, tmp_path):
    cfg = SyntheticConfig.read(changed(changed(SYNTHETIC, ["duration"], "20min"), ["sources", "pad", "rate_per_hour"], 60))
    ds = generate(spark, cfg)
    a = ds.streams["a"]
    r = a.agg(F.max(F.abs(F.col("ch4") - F.col("truth_background_ch4") - F.col("truth_enhancement_ch4"))), F.max(F.abs(F.col("truth_enhancement_c2h6") - 0.031 * F.col("truth_enhancement_ch4"))), F.count("*"), F.max("truth_enhancement_ch4")).first()
    assert r[0] < 1e-9 and r[1] < 1e-9 and r[2] == 1200 and r[3] > 10
    assert ds.observable("a").columns == ["time", "us", "ch4", "c2h6", "latitude", "longitude"]
    cat = ds.catalog
    assert cat.schema == CATALOG or [f.name for f in cat.schema] == [f.name for f in CATALOG]
    assert cat.where("sampled_peak_amplitude > true_amplitude").count() == 0 and cat.where("abs(true_baseline_at_peak - 1755) > 1e-9 and species = 'ch4'").count() == 0
    assert cat.count() == 2 * len(schedule(cfg)) > 4
    save_bundle(spark, ds, f"file://{tmp_path}/out")
    back = load_bundle(spark, f"file://{tmp_path}/out")
    assert back.config == cfg and back.streams["a"].count() == 1200 and sorted(back.catalog.toPandas().event_id) == sorted(cat.toPandas().event_id)
    with pytest.raises(KeyError):
        back.observable("none")


def test_clock_outages_noise_and_blocks(spark):
    d = changed(changed(SYNTHETIC, ["sources"], {}), ["duration"], "2h")
    d = changed(d, ["instruments", "a", "dropouts"], {"rate_per_day": 100.0, "duration": "60s"})
    d = changed(d, ["instruments", "a", "timestamp_jitter"], "200ms")
    d = changed(d, ["instruments", "a", "species", "ch4", "background"], {"kind": "bootstrap", "profile": "p"})
    cfg = SyntheticConfig.read(d)
    t = build_times(spark, cfg, "a", cfg.instruments["a"]).toPandas().sort_values("i")
    assert 0 < len(t) < 7200 and (t.us.diff().dropna() > 0).all()
    with pytest.raises(SyntheticError, match="p"):
        generate(spark, cfg)
    stats = spark.createDataFrame([("p", 1900.0, 1.0)], "name string, background_median double, sample_period_s double")
    blocks = spark.createDataFrame([("p", b, [b + 1.0, -b - 1.0]) for b in range(3)], "name string, block_id int, values array<double>")
    out = generate(spark, cfg, {"p": Profile(stats, blocks)}).streams["a"].toPandas()
    assert set((out.ch4 - 1900).abs()) == {1.0, 2.0, 3.0}
    clock = spark.range(4000).select(F.col("id").alias("i"), (F.col("id") * 1_000_000).alias("us"))
    one = ar1(clock, 5, "n", 10.0, 700 * 1_000_000, "e").toPandas().sort_values("i").e.to_numpy()
    two = ar1(clock.repartition(9), 5, "n", 10.0, 10**12, "e").toPandas().sort_values("i").e.to_numpy()
    assert abs(one - two).max() < 1e-12 and abs(one.std() - 1) < 0.25
    assert abs((one[1:] * one[:-1]).mean() / (one * one).mean() - 0.905) < 0.05


def test_rows_above_a_header_are_told_by_place(spark, tmp_path):
    def inst(glob, **more):
        return InstrumentConfig.read({"loader": {"format": "csv", "path_template": glob, "time": {"column": "t", "format": "unix"}, **more}, "variables": {"v": {"column": "v", "units": ""}}})

    read = lambda i: sorted((r.us // 1_000_000, r.v, r.w) for r in read_delimited(spark, f"file://{tmp_path}", i).collect())
    (tmp_path / "p1.csv").write_text("1700000002,instrument serial\nt,v,w\n1700000001,1,a\n1700000002,2,b\n1700000003,3,c\n")
    (tmp_path / "p2.csv").write_text("1700000003,other serial\nt,v,w\n1700000004,4,d\n1700000001,5,t\n")
    want = [(1700000001, "1", "a"), (1700000001, "5", "t"), (1700000002, "2", "b"), (1700000003, "3", "c"), (1700000004, "4", "d")]
    assert read(inst("p*.csv", header_row=1)) == want
    # comments and blank lines count nowhere, be they many; the same where a task reads several files or a file is many blocks
    for k in (1, 2):
        text = (tmp_path / f"p{k}.csv").read_text().split("\n")
        (tmp_path / f"q{k}.csv").write_text("﻿"[: k - 1] + "".join(f"# note {i}\n" for i in range(200)) + "\n\n".join(text[:1]) + "\n# more\n\n" + "\n#x\n".join(text[1:]))
    assert read(inst("q*.csv", header_row=1, comment="#")) == want
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        (tmp_path / "long.csv").write_text("title\nt,v,w\n" + "".join(f"{1700000000 + i},{i},title\n" for i in range(5000)))
        assert read(inst("long.csv", header_row=1)) == [(1700000000 + i, str(i), "title") for i in range(5000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "p3.csv").write_text("serial\nt,w,v\n1700000009,9,x\n")
    with pytest.raises(Exception, match="its header"):
        read(inst("p*.csv", header_row=1))
    (tmp_path / "r1.csv").write_text('t,v,w\n1700000001,"1,5",a\n1700000002\n')
    (tmp_path / "r2.csv").write_text("t,w,v\n1700000003,1,a\n")
    assert read(inst("r1.csv")) == [(1700000001, "1,5", "a"), (1700000002, None, None)]
    with pytest.raises(Exception, match="its header"):
        read(inst("r*.csv"))
    (tmp_path / "twice.csv").write_text("t,v,v\n1,2,3\n")
    with pytest.raises(IngestError):
        read(inst("twice.csv"))
    (tmp_path / "head.csv").write_text("t,v,w\n")
    assert read(inst("head.csv")) == []


def test_catalog_order_and_counts(spark):
    from ratioscope.sources import catalog

    cfg = SyntheticConfig.read(SYNTHETIC)
    ds = generate(spark, cfg)
    rows = catalog.in_order(ds.catalog, cfg)
    got = [(r.instrument, r.species, r.peak_time) for r in rows.collect()]
    places = [(i, s) for i, spec in cfg.instruments.items() for s in spec.species]
    assert got == sorted(got, key=lambda r: (places.index(r[:2]), r[2])) and len(got) == ds.catalog.count()
    ids = [r.event_id for r in catalog.event_ids(rows).collect()]
    assert ids == list(dict.fromkeys(r.event_id for r in rows.collect()))
    n = catalog.counts(ds.catalog).first()
    assert n.n_rows == len(got) and n.n_events == len(ids) and n.n_children == len({r.event_id for r in rows.collect() if r.parent_event_id})
    some = got[0][1]
    assert {r.species for r in catalog.for_species(ds.catalog, some).collect()} == {some}
    assert catalog.counts(ds.catalog.limit(0)).first().n_rows == 0 and catalog.event_ids(catalog.in_order(ds.catalog.limit(0), cfg)).count() == 0


@pytest.mark.parametrize("form", ["csv", "parquet"])
def test_series_of_real_shape(spark, tmp_path, form):
    from ratioscope.operators.profile import profile
    from ratioscope.sources.series import read_series

    lines = [("2026-01-01 00:00:%02d" % (i % 60) if i < 60 else "2026-01-01 00:01:%02d" % (i - 60), 1900 + (i * 37 % 11) / 10) for i in range(100)]
    lines += [lines[7][:1] + (5.0,), lines[3][:1] + (6.0,)]  # repeated stamps, out of order
    if form == "csv":
        (tmp_path / "s.csv").write_text("no,stamp,CH4 dry,note\n" + "".join(f"{k},{t},{v},x\n" for k, (t, v) in enumerate(lines)) + "102,,1.0,x\n")
    else:
        spark.createDataFrame([(k, t, v) for k, (t, v) in enumerate(lines)], "no int, t string, `CH4 dry` double").coalesce(1).select("no", F.col("t").cast("timestamp_ntz").alias("stamp"), "CH4 dry").write.parquet(f"{tmp_path}/s.parquet")
    got = read_series(spark, f"file://{tmp_path}/s.{form}")
    rows = got.orderBy("us").collect()
    assert len(rows) == 100 and [r["CH4 dry"] for r in rows] == [v for _, v in lines[:100]] and rows[1].us - rows[0].us == 1_000_000
    p = profile(got.withColumn("name", F.lit("a")), "name", "us", "CH4 dry", window_us=20_000_000, block_length=10)
    assert p.stats.first().n_source_points == 100 and p.stats.first().sample_period_s == 1.0
    with pytest.raises(IngestError):
        spark.createDataFrame([(1,)], "a int").write.parquet(f"{tmp_path}/none.parquet")
        read_series(spark, f"file://{tmp_path}/none.parquet")
