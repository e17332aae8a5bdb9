import logging
import math

from ratioscope.config import RunConfig
from ratioscope.logs import setup_logging
from ratioscope.plans.analysis import run


def test_run_places_clusters_and_averages_angles(spark, tmp_path):
    (tmp_path / "north").mkdir()
    plume = lambda i: 80 * math.exp(-(((i % 200) - 100) ** 2) / 120)
    wiggle = lambda i, k: ((i * 7919 + k * 104729) % 1009 - 504) / 504
    rows = [f"{1700000000 + i},{1800 + plume(i) + wiggle(i, 1)},{3 + 0.04 * plume(i) + 0.02 * wiggle(i, 2)},{359 if i % 2 else 1}" for i in range(1200)]
    (tmp_path / "north" / "gas.csv").write_text("t,CH4,C2H6,WD\n" + "\n".join(rows) + "\n")
    sure = {"random": {"mode": "declared", "absolute": 0.6}, "systematic": {"mode": "declared", "relative": 0.03}}
    gas = {"column": "CH4", "units": "ppb", "uncertainty": sure}
    manifest = {
        "name": "hill",
        "base_path": str(tmp_path),
        "platform": {"kind": "stationary", "latitude": 12.5, "longitude": 77.1},
        "instruments": {"box": {"loader": {"format": "csv", "path_template": "{site}/gas.csv", "time": {"column": "t", "format": "unix"}}, "variables": {"ch4": gas, "c2h6": {"column": "C2H6", "units": "ppb", "uncertainty": {"random": {"mode": "declared", "absolute": 0.012}}}, "wd": {"column": "WD", "units": "deg", "role": "met", "circular": True}}}},
    }
    analysis = {"output_grid": {"freq": "10s"}, "baseline": {"windows": ["150s", "400s"], "quantiles": [0.1]}, "detection": {"enter_sigma": [5.0]}, "regression": {"reference_species": "ch4"}, "clustering": {"enabled": True, "eps_m": 1000.0, "min_samples": 2}}
    a = run(spark, RunConfig.read({"manifest": manifest, "analysis": analysis}))
    assert {r.site for r in a.streams["box"].select("site").distinct().collect()} == {"north"}
    assert a.clusters.count() == a.events.count() > 0 and a.clusters.where("abs(latitude - 12.5) > 1e-9").count() == 0
    assert a.met.where("n_native = 10 and least(value, 360 - value) > 1e-6").count() == 0 and a.met.where("n_native = 10").count() > 100
    r = a.ratios.where("ratio is not null").first()
    assert abs(r.sigma_sys - 0.03 * abs(r.ratio)) < 1e-12 and r.sigma_total >= r.sigma and abs(r.ratio - 0.04) < 0.01


def _campaign(tmp_path, seconds=900, declared=1e-6):
    """Gas at 1 s reported in steps of 0.5 ppb; wind at 2 s, with an hour's gap, on another instrument."""
    plume = lambda i: 60 * math.exp(-(((i % 150) - 75) ** 2) / 100)
    wiggle = lambda i, k: ((i * 7919 + k * 104729) % 1009 - 504) / 2000
    gas = [f"{1700000000 + i},{round(2 * (1900 + plume(i) + 4 * wiggle(i, 1))) / 2},{2 + 0.05 * plume(i) + 0.01 * wiggle(i, 2)}" for i in range(seconds)]
    wind = [f"{1700000000 + i},{350 + (i * 20 / seconds)},{i % 7}" for i in range(0, seconds, 2) if not 300 < i < 400]
    (tmp_path / "gas.csv").write_text("t,CH4,C2H6\n" + "\n".join(gas) + "\n")
    (tmp_path / "wind.csv").write_text("t,WD,X\n" + "\n".join(f"{t},{float(d) % 360},{x}" for t, d, x in (w.split(",") for w in wind)) + "\n")
    loader = lambda f: {"format": "csv", "path_template": f, "time": {"column": "t", "format": "unix"}}
    tiny = {"random": {"mode": "declared", "absolute": declared}}
    manifest = {
        "name": "steps", "base_path": str(tmp_path), "platform": {"kind": "stationary", "latitude": 1.0, "longitude": 2.0},
        "instruments": {
            "box": {"loader": loader("gas.csv"), "variables": {"ch4": {"column": "CH4", "units": "ppb", "uncertainty": tiny}, "c2h6": {"column": "C2H6", "units": "ppb", "uncertainty": {"random": {"mode": "declared", "absolute": 0.01}}}}},
            "mast": {"loader": loader("wind.csv"), "variables": {"wd": {"column": "WD", "units": "deg", "role": "met", "circular": True}, "x": {"column": "X", "units": "1", "role": "aux"}}},
        },
    }
    analysis = {"output_grid": {"freq": "10s"}, "alignment": {"max_interp_gap": "10s"}, "baseline": {"windows": ["120s", "400s"], "quantiles": [0.1]}, "detection": {"enter_sigma": [20.0], "exit_sigma": 5.0}, "regression": {"reference_species": "ch4", "methods": ["ols", "york"]}}
    return RunConfig.read({"manifest": manifest, "analysis": analysis})


def test_run_aligns_floors_and_picks(spark, tmp_path):
    log = setup_logging("INFO", tmp_path / "logs" / "run.log")
    a = run(spark, _campaign(tmp_path), baseline_sigma="order", chunk_us=200_000_000)
    said = (tmp_path / "logs" / "run.log").read_text()
    assert f"steps: {a.events.count()} events, {a.links.count()} of them nested" in said and "INFO" in said
    assert len(setup_logging("ERROR").handlers) == 1 and log.level == logging.ERROR
    box = {(r.us - 1700000000_000000) // 1_000_000: r for r in a.streams["box"].collect()}
    assert len(box) == 900
    for i, r in box.items():
        near = i <= 300 or 400 <= i <= 898
        assert (r.wd is not None) == near and (r.x is not None) == near
        if near:
            assert abs((r.wd - (350 + i * 20 / 900) + 180) % 360 - 180) < 1e-6
    # ch4 says 1e-6 but is reported in steps of 0.5
    assert {round(r[0], 9) for r in a.samples.where("stream = 'ch4'").select("sigma_rand").distinct().collect()} == {round(0.5 / 12**0.5, 9)}
    assert a.samples.where("stream = 'c2h6' and abs(sigma_rand - 0.01) > 1e-3").count() == 0
    assert a.closure.count() == 4 and {(r.species, r.method) for r in a.primary.collect()} == {("c2h6", "ols"), ("c2h6", "york")}
    best = {(r.species, r.method): abs(r.birge - 1) for r in a.primary.collect()}
    assert all(abs(r.birge - 1) >= best[r.species, r.method] for r in a.closure.collect())
    areas = a.areas.collect()
    assert len(areas) == a.events.count() > 8 and all(r.area > 0 and r.sigma_base >= 0 and r.net_area <= r.area + 1e-9 for r in areas) and any(r.sigma_base > 0 for r in areas)
    assert a.events.where("amplitude_sigma > 0.14").count() == a.events.count()


def test_run_by_another_detector(spark, tmp_path):
    cfg = _campaign(tmp_path, 450, 0.7)
    cfg = RunConfig.read(cfg.plain() | {"analysis": cfg.analysis.plain() | {"detection": {"enter_sigma": [0.02], "exit_sigma": 0.01, "noise_estimator": "qn"}}})
    a = run(spark, cfg, detector="hmm")
    assert a.events.where("window_us = 400000000").count() >= 3
