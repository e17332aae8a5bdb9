"""From native-rate streams to ratios, over all combinations of the parameters."""

from __future__ import annotations

import logging
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config.analysis import AnalysisConfig, RunConfig
from ..config.manifest import CSVLoader, DeclaredUncertainty, MobilePlatform, ReportedUncertainty
from ..config.spec import micros, seconds
from ..functions.scalar import declared_sigma, floor_sigma, reported_sigma, source_label
from ..functions.time import from_us
from ..operators.align import check_grid, interpolate, output_grid, pmf_matrix
from ..logs import NAME
from ..operators.areas import event_areas, net_areas
from ..operators.baseline import baseline_sweep
from ..operators.cluster import dbscan
from ..operators.detect import nested_links
from ..operators.masks import ingest_variable
from ..operators.noise import ROLLING, resolution
from ..operators.ordered import DAY, range_join
from ..operators.regress import METHODS, birge, closing_cells, fit_events, method_sigma, ols, ratios, total_sigma
from ..operators.select import quantiles
from ..operators.smooth import butterworth
from ..operators.sweep import detection_sweep
from ..scratch import Scratch
from ..sources.delimited import read_delimited
from ..sources.icartt import read_icartt


def ingest(spark: SparkSession, cfg: RunConfig, *, chunk_us: int = DAY) -> dict[str, DataFrame]:
    """Native-rate streams by instrument: us, variables, for each ``sigma_rand_*``, ``sigma_sys_*``, ``source_*``, and path fields."""
    out = {}
    for name, inst in cfg.manifest.instruments.items():
        read = read_delimited if isinstance(inst.loader, CSVLoader) else read_icartt
        df = read(spark, str(cfg.manifest.base_path), inst).where("us is not null").withColumn("stream", F.lit(name))
        cols = []
        for v, c in inst.variables.items():
            df = ingest_variable(df, ["stream"], "us", v, c, chunk_us=chunk_us)
            sig = {}
            for part in ("random", "systematic"):
                u = getattr(c.uncertainty, part) if c.uncertainty else None
                declared = declared_sigma(F.col(v), u.absolute, u.relative) if isinstance(u, DeclaredUncertainty) else F.lit(None).cast("double")
                reported = reported_sigma(F.col(u.column).try_cast("double"), c.convert.scale if c.convert else 1.0) if isinstance(u, ReportedUncertainty) else F.lit(None).cast("double")
                sig[part] = (declared, reported)
            df = df.withColumn(f"sigma_rand_{v}", F.coalesce(*sig["random"])).withColumn(f"sigma_sys_{v}", F.coalesce(*sig["systematic"], F.lit(0.0))).withColumn(f"source_{v}", source_label(*sig["random"]))
            cols += [v, f"sigma_rand_{v}", f"sigma_sys_{v}", f"source_{v}"]
        out[name] = df.select("stream", "us", "time", *cols, *(f for f in inst.loader.template_fields if f not in {"stream", "us", "time", *cols}))
    return out


def place(streams: dict[str, DataFrame], cfg: RunConfig, *, chunk_us: int = DAY) -> dict[str, DataFrame]:
    """Streams with latitude and longitude: the site's, or the track's, lerped where its gaps allow."""
    p = cfg.manifest.platform
    if not isinstance(p, MobilePlatform):
        return {k: d.withColumn("latitude", F.lit(p.latitude)).withColumn("longitude", F.lit(p.longitude)) for k, d in streams.items()}
    gps = streams[p.gps_instrument].select("us", F.col(p.lat_variable).alias("latitude"), F.col(p.lon_variable).alias("longitude"))
    gap = micros(cfg.analysis.alignment.max_interp_gap)
    return {k: d if k == p.gps_instrument else interpolate(d, gps, [], "us", ["latitude", "longitude"], max_gap_us=gap, clamp=False, chunk_us=chunk_us) for k, d in streams.items()}


def long_form(streams: dict[str, DataFrame], species: dict[str, list[str]]) -> DataFrame:
    """stream (species), instrument, us, value, sigma_rand, sigma_sys, source of the given species by instrument."""
    out = None
    for inst, names in species.items():
        for s in names:
            one = streams[inst].select(F.lit(s).alias("stream"), F.lit(inst).alias("instrument"), "us", F.col(s).alias("value"), F.col(f"sigma_rand_{s}").alias("sigma_rand"), F.col(f"sigma_sys_{s}").alias("sigma_sys"), F.col(f"source_{s}").alias("source"))
            out = one if out is None else out.unionByName(one)
    return out


def with_noise(long: DataFrame, cfg: AnalysisConfig, *, step: float | str | None = None, chunk_us: int = DAY) -> DataFrame:
    """Known samples, whose random sigma is declared or reported, else the empirical one, labelled so.

    A reporting step's floor holds for all three; with "detect" each stream's step is found in its values.
    """
    d = cfg.detection
    if step == "detect":
        found = Scratch(long.sparkSession, "steps").write(resolution(long, ["stream"], "us", "value", chunk_us=chunk_us).withColumnRenamed("step", "_step"), "steps")
        return with_noise(long, cfg, chunk_us=chunk_us).join(found, "stream", "left").withColumn("sigma_rand", floor_sigma(F.col("sigma_rand"), F.coalesce("_step", F.lit(0.0)))).select(*long.columns)
    est = ROLLING[d.noise_estimator](long.where("value is not null"), ["stream"], "us", "value", micros(d.noise_window), name="_emp", step=step, chunk_us=chunk_us)
    return est.withColumn("sigma_rand", floor_sigma(F.coalesce("sigma_rand", "_emp"), step)).drop("_emp")


def event_pairs(events: DataFrame, long: DataFrame, reference: str, periods_us: dict[str, int]) -> DataFrame:
    """Pairs of each event: the reference's enhancement-free values against every other species, on the slower clock.

    ``events`` are the reference's, with event_id, start_us, end_us; x is the reference, y the species; sigmas go along.
    """
    ref = long.where(F.col("stream") == reference).select("us", F.col("value").alias("v"), "sigma_rand", "sigma_sys")
    out = None
    for s in sorted(periods_us):
        if s == reference:
            continue
        other = long.where(F.col("stream") == s).select("us", F.col("value").alias("v"), "sigma_rand", "sigma_sys")
        slow_is_other = periods_us[s] >= periods_us[reference]
        slow, fast = (other, ref) if slow_is_other else (ref, other)
        w = max(periods_us[s], periods_us[reference])
        cells = slow.where("v is not null").select(F.col("us").alias("t"), (F.col("us") - w // 2).alias("_lo"), (F.col("us") - w // 2 + w).alias("_hi"), F.col("v").alias("vs"), F.col("sigma_rand").alias("rs"))
        met = range_join(cells, fast.where("v is not null").select(F.col("us").alias("_t"), F.col("v").alias("vf"), F.col("sigma_rand").alias("rf")), "_lo", "_hi", "_t", w)
        pairs = met.groupBy("t", "vs", "rs").agg(F.avg("vf").alias("vf"), (F.sqrt(F.sum(F.col("rf") * F.col("rf"))) / F.count("rf")).alias("rf"), F.count("vf").alias("n_native"))
        a, b = (("vf", "rf"), ("vs", "rs")) if slow_is_other else (("vs", "rs"), ("vf", "rf"))
        pairs = pairs.select("t", F.col(a[0]).alias("x"), F.col(a[1]).alias("sx"), F.col(b[0]).alias("y"), F.col(b[1]).alias("sy"), "n_native")
        one = range_join(events, pairs, "start_us", "end_us", "t", max(w, 60_000_000), closed=True).withColumn("species", F.lit(s))
        out = one if out is None else out.unionByName(one)
    return out


@dataclass
class Analysis:
    streams: dict[str, DataFrame]
    samples: DataFrame
    events: DataFrame
    ratios: DataFrame
    closure: DataFrame
    grid: DataFrame | None = None
    pmf: DataFrame | None = None
    links: DataFrame | None = None
    clusters: DataFrame | None = None
    met: DataFrame | None = None
    primary: DataFrame | None = None
    areas: DataFrame | None = None


def analyse(long: DataFrame, cfg: AnalysisConfig, periods_us: dict[str, int], *, step: float | str | None = None, baseline_sigma: str | None = None, detector: str = "hysteresis", chunk_us: int = DAY, scale_sigma: dict[str, float] | None = None, scratch: Scratch | None = None, streams: dict[str, DataFrame] | None = None) -> Analysis:
    """Noise, baselines, events of the reference species, pairs, fits and their spread over the sweep; grid and matrix.

    Every smoothing cutoff is a cell of the sweep: ``smoothing_cutoff`` ("none" without smoothing) is a key of samples, events,
    ratios, closure, grid and matrix.  Detection measures in each sample's own sigma, declared or reported before empirical.
    ``links`` joins an event to the tightest event of the next longer baseline window that holds it.  Ratios have
    sigma_method (spread over the sweep) and sigma_total.  ``periods_us``: each species' sampling period.  ``scale_sigma``: relative scale errors by species.
    ``primary`` is the sweep cell of each species and method whose error budget closes best (Birge ratio nearest to 1).
    ``areas`` are the areas of the reference's events, net of nested ones, with their baselines' uncertainty where ``baseline_sigma``
    names a way to estimate it; thresholds count that in too.  ``detector``: a name of ``states.DETECTORS``.
    """
    check_grid(micros(cfg.output_grid.freq), periods_us)
    scratch = scratch or Scratch(long.sparkSession, "analysis")
    scale = scale_sigma or {}
    ref, d, b = cfg.regression.reference_species, cfg.detection, cfg.baseline
    samples = scratch.write(with_noise(long, cfg, step=step, chunk_us=chunk_us), "samples")
    cutoffs = list({micros(c): c for c in cfg.smoothing.cutoff_periods}.values()) if cfg.smoothing.enabled else ["none"]
    found = []
    for c in cutoffs:
        own, tag = samples, ""
        if cfg.smoothing.enabled:
            smooth = butterworth(samples, ["stream"], "us", "value", seconds(c), order=cfg.smoothing.order, chunk_us=chunk_us)
            # what was measured from the raw values is measured again from the smooth ones
            smooth = smooth.withColumn("value", F.col("smooth")).drop("smooth").withColumn("sigma_rand", F.when(F.col("source") != "empirical", F.col("sigma_rand")))
            own, tag = scratch.write(with_noise(smooth, cfg, step=step, chunk_us=chunk_us), "smoothed"), f"_c{c}"
        ev = detection_sweep(own.where(F.col("stream") == ref).select("stream", "us", "value", "sigma_rand"), ["stream"], "us", "value", windows_us=[micros(w) for w in b.windows], quantiles=list(b.quantiles), enter=list(d.enter_sigma), leave=d.exit_sigma, noise=d.noise_estimator, noise_window_us=micros(d.noise_window), max_gap_us=micros(d.max_internal_gap), min_duration_us=micros(d.min_duration), min_valid_fraction=b.min_valid_fraction, sigma="sigma_rand", baseline_sigma=baseline_sigma, detector=detector, chunk_us=chunk_us, scratch=scratch)
        ev = ev.withColumn("smoothing_cutoff", F.lit(c)).withColumn("event_id", F.format_string("%s_w%d_q%s_s%s%s_%05d", "stream", F.col("window_us"), F.col("quantile").cast("string"), F.col("enter_sigma").cast("string"), F.lit(tag), F.col("event_no")))
        ev = scratch.write(ev, "events")
        pairs = scratch.write(event_pairs(ev.select("event_id", "smoothing_cutoff", "window_us", "quantile", "enter_sigma", "start_us", "end_us"), own, ref, periods_us), "pairs")
        found.append((own.withColumn("smoothing_cutoff", F.lit(c)), ev, pairs))
    samples, ev, pairs = (reduce(DataFrame.unionByName, x) for x in zip(*found))
    keys = ["species", "smoothing_cutoff", "window_us", "quantile", "enter_sigma", "event_id"]
    fits = None
    for m in cfg.regression.methods:
        one = ols(pairs, keys).select(*keys, "slope", "sigma_slope", "n") if m == "ols" else fit_events(pairs, keys, METHODS[m]).select(*keys, "slope", "sigma_slope", "n")
        one = one.withColumn("method", F.lit(m))
        fits = one if fits is None else fits.unionByName(one)
    out = None
    for s in [k for k in sorted(periods_us) if k != ref]:
        r = ratios(fits.where(F.col("species") == s), min_points=cfg.regression.min_points, confidence=cfg.regression.confidence_level, scale_x=scale.get(ref, 0.0), scale_y=scale.get(s, 0.0))
        out = r if out is None else out.unionByName(r)
    out = scratch.write(out, "ratios")
    cell = ["species", "method", "smoothing_cutoff", "window_us", "quantile", "enter_sigma"]
    spread = method_sigma(out.groupBy(*cell).agg(F.avg("ratio").alias("ratio")), ["species", "method"])
    closure = birge(out, cell, "ratio", "sigma_fit").join(spread, ["species", "method"])
    out = out.join(spread.drop("n_cells"), ["species", "method"], "left").withColumn("sigma_total", total_sigma(F.col("sigma_fit"), F.col("sigma_sys"), F.col("sigma_method")))
    windows = F.array(*(F.lit(micros(w)).cast("long") for w in b.windows))
    links = nested_links(ev.withColumn("level", F.array_position(windows, F.col("window_us")) - 1), ["stream", "smoothing_cutoff", "quantile", "enter_sigma"], "level")
    g = cfg.output_grid
    grid = pmf = None
    lo, hi = samples.agg(F.min("us"), F.max("us")).first()
    if lo is not None:
        step_us = micros(g.freq)
        start = _us(g.start) if g.start else lo - lo % step_us
        end = _us(g.end) if g.end else hi + 1
        grid = output_grid(samples, ["smoothing_cutoff", "stream"], "us", "value", step_us, start, end, statistic=g.bin_statistic, sigma_rand="sigma_rand", sigma_sys="sigma_sys")
        pmf = reduce(DataFrame.unionByName, [pmf_matrix(grid.where(F.col("smoothing_cutoff") == c), "stream", "value", sorted(periods_us), {k: F.first(k) for k in ("sigma_rand", "sigma_sys")}).withColumn("smoothing_cutoff", F.lit(c)) for c in cutoffs]).withColumn("time", from_us(F.col("cell_us")))
    primary = closing_cells(closure, ["species", "method"], ("smoothing_cutoff", "window_us", "quantile", "enter_sigma")).where("closure_rank = 1").drop("closure_rank")
    areas = _areas(samples.where(F.col("stream") == ref), ev, links, cfg, baseline_sigma, chunk_us)
    return Analysis(streams or {}, samples, ev, out, closure, grid, pmf, links, primary=primary, areas=areas)


def _areas(samples: DataFrame, ev: DataFrame, links: DataFrame, cfg: AnalysisConfig, baseline_sigma: str | None, chunk_us: int) -> DataFrame:
    """Areas of the events of every sweep cell, in that cell's own enhancement; gaps longer than events bridge hold none."""
    b, windows = cfg.baseline, [micros(w) for w in cfg.baseline.windows]
    level = F.array_position(F.array(*(F.lit(w).cast("long") for w in windows)), F.col("window_us")) - 1
    base = baseline_sweep(samples, ["smoothing_cutoff", "stream"], "us", "value", windows, list(b.quantiles), min_valid_fraction=b.min_valid_fraction, sigma=baseline_sigma, chunk_us=chunk_us)
    base = base.withColumn("enter_sigma", F.explode(F.array(*(F.lit(float(e)) for e in cfg.detection.enter_sigma)))).withColumn("level", level)
    keys = ["stream", "smoothing_cutoff", "quantile", "enter_sigma"]
    own = event_areas(base, ev.withColumn("level", level), [*keys, "level"], "us", "enhancement", sigma="sigma_rand", common="baseline_sigma" if baseline_sigma else None, max_gap_us=micros(cfg.detection.max_internal_gap), chunk_us=chunk_us)
    return net_areas(own, links, keys, "level").withColumn("window_us", F.element_at(F.array(*(F.lit(w).cast("long") for w in windows)), (F.col("level") + 1).cast("int")))


def _us(t) -> int:
    import pandas as pd

    return int(pd.Timestamp(t).value // 1000)


def align_aux(streams: dict[str, DataFrame], cfg: RunConfig, *, chunk_us: int = DAY) -> dict[str, DataFrame]:
    """Streams of gases with the met and aux variables of all other instruments on their own clock.

    Each variable is lerped by itself, angles along the shorter arc, and is null outside its span and across steps longer than
    ``max_interp_gap``.
    """
    gap, out = micros(cfg.analysis.alignment.max_interp_gap), dict(streams)
    roles = {i: {v: c for v, c in inst.variables.items() if c.role in ("met", "aux")} for i, inst in cfg.manifest.instruments.items()}
    for i, inst in cfg.manifest.instruments.items():
        if any(c.role == "gas" for c in inst.variables.values()):
            for other, variables in roles.items():
                for v, c in variables.items() if other != i else ():
                    if v not in out[i].columns:
                        out[i] = interpolate(out[i], streams[other].select("us", F.col(v).cast("double").alias(v)), [], "us", [v], max_gap_us=gap, clamp=False, angles=(v,) if c.circular else (), chunk_us=chunk_us)
    return out


def run(spark: SparkSession, cfg: RunConfig, *, baseline_sigma: str | None = None, detector: str = "hysteresis", chunk_us: int = DAY) -> Analysis:
    """Files to ratios, as a manifest and an analysis say.

    Streams of gases carry the met and aux variables, aligned to their clock.  Sigmas are at least the spread of rounding to the
    step that a stream reports in, which is found in its values.

    Declared relative systematic errors are the axes' scale errors.  With clustering on, ``clusters`` places the reference's
    events.  ``met`` is the output grid of met variables, circular ones averaged as vectors.
    """
    scratch = Scratch(spark, "run")
    streams = {k: scratch.write(d, k) for k, d in place(ingest(spark, cfg, chunk_us=chunk_us), cfg, chunk_us=chunk_us).items()}
    aligned = align_aux(streams, cfg, chunk_us=chunk_us)
    streams = {k: d if d is streams[k] else scratch.write(d, f"{k}-aligned") for k, d in aligned.items()}
    species = {i: [v for v, c in inst.variables.items() if c.role == "gas"] for i, inst in cfg.manifest.instruments.items()}
    species = {i: s for i, s in species.items() if s}
    periods = {}
    from ..operators.ordered import previous

    for i, names in species.items():
        steps = previous(streams[i].select("us"), [], "us", ["us"], "_p", chunk_us=chunk_us).select(F.lit(i).alias("i"), (F.col("us") - F.col("_p.us")).alias("d"))
        p = quantiles(steps, ["i"], {"p": (F.col("d"), [0.5])}).first()
        periods |= dict.fromkeys(names, int(p.p[0]) if p and p.p and p.p[0] else 1)
    scale = {}
    for i, names in species.items():
        for v in names:
            u = cfg.manifest.instruments[i].variables[v].uncertainty
            if u and isinstance(u.systematic, DeclaredUncertainty):
                scale[v] = u.systematic.relative
    out = analyse(long_form(streams, species), cfg.analysis, periods, step="detect", baseline_sigma=baseline_sigma, detector=detector, chunk_us=chunk_us, scale_sigma=scale, scratch=scratch, streams=streams)
    home = next((i for i, names in species.items() if cfg.analysis.regression.reference_species in names), None)
    if cfg.analysis.clustering.enabled and home:
        out.clusters = cluster_events(out.events, streams[home].select("us", "latitude", "longitude"), cfg.analysis, chunk_us=chunk_us)
    out.met = _met_grid(streams, cfg, out.samples)
    n, inner = out.events.count(), out.links.count()
    logging.getLogger(NAME).info("%s: %d events, %d of them nested, %d instruments, %d species", cfg.manifest.name, n, inner, len(streams), len(periods))
    return out


def _met_grid(streams: dict[str, DataFrame], cfg: RunConfig, samples: DataFrame) -> DataFrame | None:
    """Met variables of all instruments on the output grid: stream, cell_us, value, n_native."""
    met = [(i, v, c.circular) for i, inst in cfg.manifest.instruments.items() for v, c in inst.variables.items() if c.role == "met"]
    lo, hi = samples.agg(F.min("us"), F.max("us")).first()
    if not met or lo is None:
        return None
    g = cfg.analysis.output_grid
    step = micros(g.freq)
    start, end = _us(g.start) if g.start else lo - lo % step, _us(g.end) if g.end else hi + 1
    grids = []
    for circular in (False, True):
        long = [streams[i].select(F.lit(v).alias("stream"), "us", F.col(v).alias("value")) for i, v, c in met if c == circular]
        if long:
            grids.append(output_grid(reduce(DataFrame.unionByName, long), ["stream"], "us", "value", step, start, end, statistic="circular" if circular else g.bin_statistic))
    return reduce(DataFrame.unionByName, grids)


def cluster_events(events: DataFrame, track: DataFrame, cfg: AnalysisConfig, *, chunk_us: int = DAY) -> DataFrame:
    """Events with the cluster of places that they belong to; ``track``: us, latitude, longitude."""
    at = interpolate(events.select("event_id", F.col("peak_us").alias("us")), track, [], "us", ["latitude", "longitude"], chunk_us=chunk_us)
    ids = at.withColumn("no", F.xxhash64("event_id"))
    c = cfg.clustering
    found = dbscan(ids, "no", "latitude", "longitude", "us", eps_m=c.eps_m, m_per_s=c.space_time_scale, min_samples=c.min_samples)
    return ids.join(found, "no").select("event_id", "latitude", "longitude", "cluster", "core")


__all__ = ["Analysis", "align_aux", "analyse", "cluster_events", "event_pairs", "ingest", "long_form", "place", "run", "with_noise"]
