"""Synthetic campaigns with ground truth.

Events are drawn once, before any instrument, and are shared by all: a small driver-side table.  Samples are rows of
``spark.range`` and all their draws are functions of (seed, purpose, sample), so a stream is the same under any
partitioning, and adding an instrument changes no other.  Bit-for-bit equality with a sequential generator isn't sought;
laws and invariants are: observable = background + enhancement (+ errors, rounding, wrapping), sampled peak <= true peak.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config.spec import micros, seconds
from ..config.synthetic import EMGShape, InstrumentSpec, LognormalAmplitude, MobileTrack, ParametricBackground, SpeciesSpec, SyntheticConfig, TrueComponent
from ..errors import SyntheticError
from ..functions.geodesy import clamp_latitude, offset_position, wrap_longitude
from ..functions.rng import driver_rng, normal, uniform
from ..functions.scalar import declared_sigma, quantize, wrap_angle
from ..functions.shapes import Kernel
from ..functions.time import from_us
from ..operators.align import interpolate
from ..operators.ordered import DAY, chunked, range_join, running_sum
from ..scratch import Scratch
from .bundle import Dataset, conform_catalog, empty_catalog

ROWS_A_CHUNK = 200_000


@dataclass(frozen=True)
class Event:
    """One physical release.  Times in microseconds; lags and amplitudes by species."""

    event_id: str
    parent: str | None
    source: str
    reference: str
    center_us: int
    kernel: Kernel
    amplitudes: dict[str, float]
    ratios: dict[str, float]
    lags: dict[str, int]

    def span(self, species: str) -> tuple[int, int, int]:
        """Start, peak and end."""
        c = self.center_us + self.lags.get(species, 0)
        return c - round(self.kernel.before * 1e6), c + round(self.kernel.peak * 1e6), c + round(self.kernel.after * 1e6)


def kernel_of(shape) -> Kernel:
    return Kernel.build(seconds(shape.sigma), seconds(shape.tau) if isinstance(shape, EMGShape) else 0.0)


def _ratio(rng: np.random.Generator, spec) -> float:
    if spec.relative_spread == 0:
        return spec.mean
    mu, sd = spec.log_parameters()
    return float(math.exp(rng.normal(mu, sd)))


def schedule(cfg: SyntheticConfig) -> list[Event]:
    """All events by centre time: a Poisson number a source, centres uniform over the record, children inside parents."""
    start, span = _start_us(cfg), micros(cfg.duration)
    out: list[Event] = []
    for name, src in cfg.sources.items():
        rng = driver_rng(cfg.seed, f"events/{name}")
        kernel = kernel_of(src.shape)
        child_kernel = kernel_of(src.nested.shape) if src.nested else None
        n = rng.poisson(src.rate_per_hour * span / 3.6e9)
        lags = {s: micros(v) for s, v in src.inter_species_lag.items()}
        for i, at in enumerate(np.sort(rng.uniform(0, span, n))):
            a = src.amplitude
            peak = a.median * math.exp(a.sigma_log * rng.standard_normal()) if isinstance(a, LognormalAmplitude) else rng.uniform(a.low, a.high)
            ratios = {src.reference_species: 1.0} | {s: _ratio(rng, r) for s, r in src.ratios.items()}
            parent = Event(f"{name}_{i:05d}", None, name, src.reference_species, start + int(at), kernel, {s: peak * r for s, r in ratios.items()}, ratios, lags)
            out.append(parent)
            if src.nested and rng.uniform() < src.nested.probability:
                own = ratios | {s: _ratio(rng, r) for s, r in (src.nested.ratios or {}).items()}
                p = peak * src.nested.amplitude_factor
                c = parent.center_us + int(rng.uniform(-1, 1) * kernel.sigma * 1e6)
                out.append(Event(f"{parent.event_id}_child", parent.event_id, name, src.reference_species, c, child_kernel, {s: p * r for s, r in own.items()}, own, lags))
    return sorted(out, key=lambda e: (e.center_us, e.event_id))


def _start_us(cfg: SyntheticConfig) -> int:
    return int(pd.Timestamp(cfg.start).value // 1000)


def build_times(spark: SparkSession, cfg: SyntheticConfig, name: str, inst: InstrumentSpec) -> DataFrame:
    """i (sample number) and us of an instrument's clock: regular, jittered, less its outages."""
    step, n = micros(inst.native_rate), -(-micros(cfg.duration) // micros(inst.native_rate))
    us = F.lit(_start_us(cfg)) + F.col("i") * step
    if inst.timestamp_jitter:
        us = us + ((2 * uniform(cfg.seed, f"jitter/{name}", F.col("i")) - 1) * micros(inst.timestamp_jitter)).cast("long")
    t = spark.range(n).select(F.col("id").alias("i")).select("i", us.alias("us"))
    if inst.dropouts:
        rng = driver_rng(cfg.seed, f"dropouts/{name}")
        mean, span = micros(inst.dropouts.duration), micros(cfg.duration)
        k = rng.poisson(inst.dropouts.rate_per_day * span / 8.64e10)
        on = rng.uniform(-mean, span, k).astype("int64") + _start_us(cfg)
        length = rng.exponential(mean, k).astype("int64")
        if k:
            gone = spark.createDataFrame(pd.DataFrame({"lo": on, "hi": on + length}))
            t = range_join(gone, t, "lo", "hi", "us", max(mean, step), how="left_anti")
            if not t.head(1):
                raise SyntheticError(f"outages remove every sample of {name!r}")
    return t


def _chunk_us(inst: InstrumentSpec) -> int:
    return micros(inst.native_rate) * ROWS_A_CHUNK


def parametric(df: DataFrame, bg: ParametricBackground, seed: int, purpose: str, start_us: int, chunk_us: int, out: str) -> DataFrame:
    """offset + diurnal (epoch-phased) + drift + random walk whose spread after a day is ``random_walk_std``."""
    s = F.col("us") / 1e6
    x = F.lit(bg.offset)
    if bg.diurnal_amplitude:
        x = x - F.lit(bg.diurnal_amplitude) * F.cos(F.lit(2 * math.pi) * (s - bg.diurnal_phase_hours * 3600) / seconds(bg.diurnal_period))
    if bg.drift_per_day:
        x = x + F.lit(bg.drift_per_day) * (F.col("us") - start_us) / float(DAY)
    if not bg.random_walk_std:
        return df.withColumn(out, x)
    from ..operators.ordered import previous

    p = previous(df, [], "us", ["us"], "_p", chunk_us=chunk_us)
    dt = F.greatest(F.lit(0), F.col("us") - F.coalesce(F.col("_p.us"), F.col("us"))) / float(DAY)
    p = p.withColumn("_step", F.sqrt(dt) * bg.random_walk_std * normal(seed, purpose, F.col("i"))).drop("_p")
    return running_sum(p, [], "us", F.col("_step"), "_walk", chunk_us=chunk_us).withColumn(out, x + F.col("_walk")).drop("_step", "_walk")


def bootstrap(df: DataFrame, sp: SpeciesSpec, profiles: dict, seed: int, purpose: str, start_us: int, chunk_us: int, out: str) -> DataFrame:
    """A base, or the profile's median, plus blocks of the profile drawn with replacement and laid end to end."""
    bg = sp.background
    if bg.profile not in profiles:
        raise SyntheticError(f"no profile {bg.profile!r}; there are {sorted(profiles)}")
    prof = profiles[bg.profile]
    stats = prof.stats.where(F.col("name") == bg.profile).first()
    blocks = prof.blocks.where(F.col("name") == bg.profile).select(F.col("block_id").cast("long").alias("block_id"), "values")
    n, length = blocks.count(), blocks.select(F.max(F.size("values"))).first()[0]
    if not n or stats is None:
        raise SyntheticError(f"profile {bg.profile!r} has no blocks")
    df = parametric(df, bg.base, seed, purpose + "/base", start_us, chunk_us, out) if bg.base else df.withColumn(out, F.lit(stats["background_median"]))
    slot = F.floor(F.col("i") / length)
    drawn = df.withColumn("block_id", F.floor(uniform(seed, purpose + "/block", slot) * n).cast("long"))
    at = F.element_at("values", (F.col("i") % length + 1).cast("int"))
    return drawn.join(blocks, "block_id").withColumn(out, F.col(out) + F.lit(bg.scale) * at).drop("block_id", "values")


def ar1(df: DataFrame, seed: int, purpose: str, tau_s: float, chunk_us: int, out: str) -> DataFrame:
    """Stationary unit noise with correlation exp(-dt / tau): e_i = rho_i e_(i-1) + sqrt(1 - rho_i^2) w_i.

    The recursion is linear: each chunk is run from rest, and the value it starts from is carried by a table of chunks.
    """
    from ..operators.ordered import previous

    p = previous(df.withColumn("_w", normal(seed, purpose, F.col("i"))), [], "us", ["us"], "_p", chunk_us=chunk_us)
    p = p.withColumn("_rho", F.coalesce(F.exp(-(F.col("us") - F.col("_p.us")) / F.lit(tau_s * 1e6)), F.lit(0.0))).drop("_p")
    p = chunked(p, "us", chunk_us)
    cols = df.columns

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("us", kind="stable")
        rho, w = pdf["_rho"].to_numpy(), pdf["_w"].to_numpy()
        shock = np.sqrt(1 - rho * rho) * w
        e, last = np.empty(len(w)), 0.0
        for i in range(len(w)):
            last = rho[i] * last + shock[i]
            e[i] = last
        o = pdf[[*cols, "_chunk"]].copy()
        o["_e"], o["_gain"] = e, np.cumprod(rho)
        return o

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", _chunk bigint, _e double, _gain double"
    own = p.groupBy("_chunk").applyInPandas(run, schema)
    ends = own.groupBy("_chunk").agg(F.max_by(F.struct("_e", "_gain"), "us").alias("_z"))

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_chunk")
        start, last = [], 0.0
        for e, g in zip(pdf["e"], pdf["g"]):
            start.append(last)
            last = e + g * last
        return pd.DataFrame({"_chunk": pdf["_chunk"], "_start": start})

    # one row a chunk
    starts = ends.select("_chunk", F.col("_z._e").alias("e"), F.col("_z._gain").alias("g")).groupBy().applyInPandas(carry, "_chunk bigint, _start double")
    return own.join(starts, "_chunk").withColumn(out, F.col("_e") + F.col("_gain") * F.col("_start")).drop("_chunk", "_e", "_gain", "_start")


def systematic(x: Column, c: TrueComponent, seed: int, purpose: str) -> tuple[Column, float, float]:
    """Error common to a run: one draw for the absolute part, one for the relative; and the draws."""
    rng = driver_rng(seed, purpose)
    ga, gr = float(rng.standard_normal()), float(rng.standard_normal())
    return F.lit(c.absolute * ga) + x * F.lit(c.relative * gr), ga, gr


def inject(spark: SparkSession, df: DataFrame, events: list[Event], species: str, out: str) -> tuple[DataFrame, DataFrame | None]:
    """Samples with the sum of the plumes over them, and the largest contribution sampled of each event."""
    own = [e for e in events if species in e.amplitudes]
    if not own:
        return df.withColumn(out, F.lit(0.0)), None
    kernels = list(dict.fromkeys(e.kernel for e in own))
    rows = [(e.event_id, e.center_us + e.lags.get(species, 0), *e.span(species)[::2], e.amplitudes[species], kernels.index(e.kernel)) for e in own]
    ev = spark.createDataFrame(rows, "event_id string, c long, lo long, hi long, amp double, k int")
    widest = max(hi - lo for _, _, lo, hi, _, _ in rows)
    met = range_join(ev, df.select("i", "us"), "lo", "hi", "us", max(widest, 1), closed=True)
    t = (F.col("us") - F.col("c")) / 1e6
    value = F.lit(0.0)
    for n, k in enumerate(kernels):
        part = met.where(F.col("k") == n).withColumn("v", F.col("amp") * k.column(t)).select("i", "event_id", "v")
        value = part if n == 0 else value.unionByName(part)
    total = value.groupBy("i").agg(F.sum("v").alias(out))
    peaks = value.groupBy("event_id").agg(F.max("v").alias("sampled"))
    return df.join(total, "i", "left").withColumn(out, F.coalesce(out, F.lit(0.0))), peaks


def track(spark: SparkSession, cfg: SyntheticConfig) -> DataFrame:
    """GPS stream of a mobile platform: i, us, latitude, longitude, about its start's flat earth."""
    p = cfg.platform
    inst = InstrumentSpec(native_rate=p.gps_rate, species={"position": {"background": {"kind": "parametric", "offset": 0.0}}})
    t = build_times(spark, cfg, p.gps_instrument, inst)
    s = (F.col("us") - _start_us(cfg)) / 1e6
    if p.pattern == "circuit":
        theta = s * (p.speed_m_s / p.radius_m)
        lat, lon = offset_position(p.start_latitude, p.start_longitude, p.radius_m * F.sin(theta), p.radius_m * (F.cos(theta) - 1))
        return t.withColumn("latitude", lat).withColumn("longitude", lon)
    chunk, dt = _chunk_us(inst), micros(p.gps_rate) / 1e6
    first = F.when(F.col("i") == 0, uniform(cfg.seed, "heading0", F.lit(0)) * (2 * math.pi)).otherwise(normal(cfg.seed, "heading", F.col("i")) * (p.heading_volatility * math.sqrt(dt)))
    h = running_sum(t.withColumn("_d", first), [], "us", F.col("_d"), "_h", chunk_us=chunk)
    move = F.when(F.col("i") > 0, p.speed_m_s * dt).otherwise(0.0)
    h = running_sum(h, [], "us", move * F.sin("_h"), "_e", chunk_us=chunk)
    h = running_sum(h, [], "us", move * F.cos("_h"), "_n", chunk_us=chunk)
    lat, lon = offset_position(p.start_latitude, p.start_longitude, F.col("_e"), F.col("_n"))
    return h.select("i", "us", lat.alias("latitude"), lon.alias("longitude"))


def generate(spark: SparkSession, cfg: SyntheticConfig, profiles: dict | None = None) -> Dataset:
    """All streams and the catalog.  Clocks, tracks and finished species are written to the shared folder, which keeps plans short."""
    events = schedule(cfg)
    scratch = Scratch(spark, "synthetic")
    start, mobile = _start_us(cfg), isinstance(cfg.platform, MobileTrack)
    gps = scratch.write(track(spark, cfg), "track") if mobile else None
    streams: dict[str, DataFrame] = {}
    attrs: dict = {"seed": cfg.seed, "name": cfg.name, "stage": "synthetic", "variables": {}}
    parts: list[DataFrame] = []
    if mobile:
        streams[cfg.platform.gps_instrument] = gps.select(from_us(F.col("us")).alias("time"), "us", "latitude", "longitude")
    for iname, inst in cfg.instruments.items():
        df, chunk = scratch.write(build_times(spark, cfg, iname, inst), f"clock-{iname}"), _chunk_us(inst)
        cols: list[str] = []
        truths: list[tuple[str, DataFrame]] = []
        for sp, spec in inst.species.items():
            bg, enh = f"truth_background_{sp}", f"truth_enhancement_{sp}"
            if isinstance(spec.background, ParametricBackground):
                df = parametric(df, spec.background, cfg.seed, f"walk/{sp}", start, chunk, bg)
            else:
                df = bootstrap(df, spec, profiles or {}, cfg.seed, f"boot/{sp}", start, chunk, bg)
            df = scratch.write(df, f"background-{sp}")
            df, peaks = inject(spark, df, events if spec.role == "gas" else [], sp, enh)
            clean = F.col(bg) + F.col(enh)
            value, extra = clean, []
            about = {"instrument": iname, "role": spec.role, "units": spec.units, "circular": int(spec.circular), "quantization": spec.quantization}
            u = spec.uncertainty
            if u and u.random:
                sig = declared_sigma(clean, u.random.absolute, u.random.relative)
                if u.decorrelation_timescale:
                    df = ar1(df, cfg.seed, f"noise/{sp}", seconds(u.decorrelation_timescale), chunk, f"_z_{sp}")
                else:
                    df = df.withColumn(f"_z_{sp}", normal(cfg.seed, f"noise/{sp}", F.col("i")))
                value = value + sig * F.col(f"_z_{sp}")
                df = df.withColumn(f"truth_sigma_rand_{sp}", sig)
                extra.append(f"truth_sigma_rand_{sp}")
                if u.random.report_as:
                    df = df.withColumn(u.random.report_as, sig * u.random.report_bias)
                    extra.append(u.random.report_as)
            if u and u.systematic:
                err, ga, gr = systematic(clean, u.systematic, cfg.seed, f"systematic/{sp}")
                value = value + err
                sig = declared_sigma(clean, u.systematic.absolute, u.systematic.relative)
                df = df.withColumn(f"truth_sigma_sys_{sp}", sig)
                extra.append(f"truth_sigma_sys_{sp}")
                about |= {"true_sys_abs_draw": ga, "true_sys_rel_draw": gr}
                if u.systematic.report_as:
                    df = df.withColumn(u.systematic.report_as, sig * u.systematic.report_bias)
                    extra.append(u.systematic.report_as)
            if spec.quantization:
                value = quantize(value, spec.quantization)
            df = df.withColumn(sp, wrap_angle(value) if spec.circular else value)
            cols += [sp, bg, enh, *extra]
            df = scratch.write(df.drop(f"_z_{sp}"), sp)
            attrs["variables"][sp] = about
            if peaks is not None:
                truths.append((sp, scratch.write(peaks, f"peaks-{sp}")))
        if mobile:
            df = interpolate(df, gps.select("us", "latitude", "longitude"), [], "us", ["latitude", "longitude"], chunk_us=chunk)
            df = df.withColumn("latitude", clamp_latitude(F.col("latitude"))).withColumn("longitude", wrap_longitude(F.col("longitude")))
            df, place = scratch.write(df, f"placed-{iname}"), ["latitude", "longitude"]
        else:
            p = cfg.platform
            df = df.withColumn("latitude", F.lit(p.latitude)).withColumn("longitude", F.lit(p.longitude))
            place = ["latitude", "longitude"]
            if p.altitude_m is not None:
                df, place = df.withColumn("altitude", F.lit(p.altitude_m)), [*place, "altitude"]
        streams[iname] = df.select(from_us(F.col("us")).alias("time"), "us", *cols, *place)
        for order, (sp, peaks) in enumerate(truths):
            parts.append(scratch.write(_truth(spark, cfg, events, sp, iname, df, peaks, gps, chunk), f"truth-{sp}"))
    cat = empty_catalog(spark)
    for p in parts:
        cat = cat.unionByName(p)
    return Dataset(streams, conform_catalog(cat), cfg, attrs)


def _truth(spark: SparkSession, cfg: SyntheticConfig, events: list[Event], sp: str, inst: str, df: DataFrame, peaks: DataFrame, gps: DataFrame | None, chunk: int) -> DataFrame:
    """Catalog rows of a species: the background and, when mobile, the place are those at the peak."""
    rows = []
    for e in events:
        if sp in e.amplitudes:
            lo, peak, hi = e.span(sp)
            rows.append((e.event_id, e.parent, e.source, sp, inst, e.reference, lo, peak, hi, e.amplitudes[sp], e.ratios[sp]))
    t = spark.createDataFrame(rows, "event_id string, parent_event_id string, source_name string, species string, instrument string, reference_species string, lo long, us long, hi long, true_amplitude double, true_ratio_to_reference double")
    t = interpolate(t, df.select("us", F.col(f"truth_background_{sp}").alias("true_baseline_at_peak")), [], "us", ["true_baseline_at_peak"], chunk_us=chunk)
    if gps is not None:
        t = interpolate(t, gps.select("us", "latitude", "longitude"), [], "us", ["latitude", "longitude"], chunk_us=chunk)
    else:
        t = t.withColumn("latitude", F.lit(cfg.platform.latitude)).withColumn("longitude", F.lit(cfg.platform.longitude))
    t = t.join(peaks.withColumnRenamed("sampled", "sampled_peak_amplitude"), "event_id", "left")
    return conform_catalog(t.withColumn("start_time", from_us(F.col("lo"))).withColumn("peak_time", from_us(F.col("us"))).withColumn("end_time", from_us(F.col("hi"))))


__all__ = ["Event", "ar1", "build_times", "generate", "inject", "kernel_of", "schedule", "track"]
