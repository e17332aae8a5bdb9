"""Two more detectors, beside hysteresis: a two-state chain and a matched filter (our choices of model; none is prescribed).

``hmm_states`` finds the most likely sequence of background and plume.  What a sample does to the difference of the two states' best
scores is a clamp, x -> min(max(x + c, l), h), and clamps compose to clamps: a chunk is three numbers each way, a table of one
row a chunk carries the differences over chunks' edges, and within a chunk the clamps are composed by doubling.

``matched_peaks`` correlates the signal with a plume's kernel about every sample and keeps the highest of neighbouring scores.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shapes import Kernel
from ..scratch import Scratch
from .detect import in_event
from .ordered import CHUNK, DAY, chunked, over_chunks
from .windowed import members, window_max


def _after(first: tuple, then: tuple) -> tuple:
    """The clamp that does ``first``, then ``then``."""
    (c1, l1, h1), (c2, l2, h2) = first, then
    return c1 + c2, np.minimum(np.maximum(l1 + c2, l2), h2), np.minimum(np.maximum(h1 + c2, l2), h2)


def _running(c: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple:
    """Composition of the clamps up to and with each place."""
    c, low, high = c.copy(), low.copy(), high.copy()
    step = 1
    while step < len(c):
        new = _after((c[:-step], low[:-step], high[:-step]), (c[step:], low[step:], high[step:]))
        c[step:], low[step:], high[step:] = new
        step *= 2
    return c, low, high


def _clamp(x: float, m: tuple) -> np.ndarray:
    return np.minimum(np.maximum(x + m[0], m[1]), m[2])


class Chain:
    """Logarithms of a chain's steps; ``enter`` and ``leave`` are probabilities a sample."""

    def __init__(self, enter: float, leave: float):
        if not (0 < enter < 1 and 0 < leave < 1 and enter + leave < 1):
            raise ValueError("enter and leave must be above 0, and less than 1 together")
        self.a00, self.a01, self.a10, self.a11 = (math.log(p) for p in (1 - enter, enter, leave, 1 - leave))

    def forwards(self, e: np.ndarray) -> tuple:
        """Clamps of the difference of best scores up to each sample; ``e`` is how much likelier its value is in a plume."""
        return self.a11 - self.a00 + e, self.a01 - self.a00 + e, self.a11 - self.a10 + e

    def backwards(self, e: np.ndarray) -> tuple:
        """The same of what is to come, from each sample to the one before it."""
        return self.a11 - self.a00 + e, np.full(len(e), self.a10 - self.a00), np.full(len(e), self.a11 - self.a01)

    def decode(self, e: np.ndarray, start: float = -np.inf, end: float = 0.0) -> np.ndarray:
        """States of samples in order; ``start`` is the difference before the first, ``end`` that of what comes after the last."""
        d = _clamp(start, _running(*self.forwards(e)))
        back = _clamp(end, _running(*(x[::-1] for x in self.backwards(e))))[::-1]  # what it is before each sample
        return (d + np.append(back[1:], end) > 0).astype(np.int32)


def hmm_states(df: DataFrame, keys: list[str], us: str, delta: Column, sigma: Column, name: str = "state", *, enter: float = 0.01, leave: float = 0.1, mean: float = 4.0, spread: float = 3.0, chunk_us: int = DAY, scratch: Scratch | None = None) -> DataFrame:
    """``df`` with 1 where the most likely sequence of states is in a plume, else 0; equal likelihoods count for background.

    In multiples of ``sigma``, ``delta`` is a standard normal in background and a normal of ``mean`` and ``spread`` in a plume.
    Before its first sample a stream is in background.  Unknown values speak for neither state.  Rows of one time follow each
    other by their likelihood, so nothing depends on partitions.
    """
    chain = Chain(enter, leave)
    scratch = scratch or Scratch(df.sparkSession, "states")
    z = delta / sigma
    likelier = F.pow(z, 2) / 2 - F.pow((z - mean) / spread, 2) / 2 - math.log(spread)
    rows = scratch.write(chunked(df.withColumn("_e", F.coalesce(F.nanvl(F.when(sigma > 0, likelier), F.lit(None)), F.lit(0.0))), us, chunk_us), "likelihoods")
    types = "".join(f"`{k}` {t}, " for k, t in rows.select(*keys, CHUNK).dtypes)

    def in_order(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.sort_values([us, "_e"], kind="stable")

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        e = in_order(pdf)["_e"].to_numpy()
        f, b = _running(*chain.forwards(e)), _running(*(x[::-1] for x in chain.backwards(e)))
        return pdf[[*keys, CHUNK]].iloc[:1].assign(_f=[[float(x[-1]) for x in f]], _b=[[float(x[-1]) for x in b]])

    def edges(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(CHUNK)
        d, starts = -np.inf, []
        for m in pdf["_f"]:
            starts.append(d)
            d = float(_clamp(d, tuple(m)))
        b, ends = 0.0, []
        for m in pdf["_b"][::-1]:
            ends.append(b)
            b = float(_clamp(b, tuple(m)))
        return pdf[[*keys, CHUNK]].assign(_start=starts, _end=ends[::-1])

    def decode(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = in_order(pdf)
        out = pdf[columns].copy()
        out[name] = chain.decode(pdf["_e"].to_numpy(), pdf["_start"].iloc[0], pdf["_end"].iloc[0])
        return out

    columns = list(df.columns)
    known = rows.select(*keys, us, CHUNK, "_e").groupBy(*keys, CHUNK).applyInPandas(sums, types + "_f array<double>, _b array<double>")
    at = known.groupBy(*keys).applyInPandas(edges, types + "_start double, _end double")  # a row a chunk
    schema = "".join(f"`{c}` {t}, " for c, t in df.dtypes) + f"`{name}` int"
    return rows.join(at, [*keys, CHUNK]).groupBy(*keys, CHUNK).applyInPandas(decode, schema)


#: Detectors by name: all give a state, 1 in events, to a frame of samples.  ``enter`` and ``leave`` are what a detector takes them for:
#: multiples of sigma, or the chain's probabilities.
DETECTORS = {"hysteresis": in_event, "hmm": lambda df, keys, us, delta, sigma, enter, leave, name="state", *, chunk_us=DAY: hmm_states(df, keys, us, delta, sigma, name, enter=enter, leave=leave, chunk_us=chunk_us)}


def _kernel_sums(kernel: Kernel, t: np.ndarray, vw: np.ndarray, w: np.ndarray, centre: np.ndarray, first: np.ndarray, last: np.ndarray, nodes: int = 14) -> tuple[np.ndarray, np.ndarray]:
    """Sums of k vw and of k k w over the runs [first, last) about each centre, for a Gaussian kernel, at a cost that doesn't grow with
    the runs' sizes.

    Times are cut into boxes of half the kernel's width.  In a box the kernel about any centre is a polynomial through its values at
    Chebyshev nodes, to a double's digits; what samples give to the nodes is summed up once, so any run of them is a difference.
    """
    kv, kk = np.zeros(len(centre)), np.zeros(len(centre))
    width = kernel.sigma * 0.5e6
    box = np.floor((t - t[0]) / width)
    edges = np.flatnonzero(np.diff(box, prepend=-1, append=np.inf))
    u = np.cos(np.pi * (np.arange(nodes) + 0.5) / nodes)
    inner = np.cos(np.outer(np.arange(nodes), np.arccos(u))) * (2 / nodes)
    inner[0] /= 2
    for lo, hi in zip(edges[:-1], edges[1:]):
        middle = (box[lo] + 0.5) * width
        near = slice(np.searchsorted(last, lo, side="right"), np.searchsorted(first, hi, side="left"))
        share = np.cos(np.outer(np.arccos(np.clip((t[lo:hi] - t[0] - middle) / (width / 2), -1, 1)), np.arange(nodes))) @ inner
        a, b = np.maximum(first[near], lo) - lo, np.minimum(last[near], hi) - lo
        k = np.exp(kernel.log_shape(((middle + u * width / 2)[None, :] - (centre[near] - t[0])[:, None]) / 1e6))
        for out, c, f in ((kv, vw, k), (kk, w, k * k)):
            run = np.concatenate([np.zeros((1, nodes)), np.cumsum(share * c[lo:hi, None], axis=0)])
            out[near] += (f * (run[b] - run[a])).sum(axis=1)
    return kv, kk


def matched_scores(df: DataFrame, keys: list[str], us: str, value: str, sigma: str, kernel: Kernel, *, chunk_us: int = DAY) -> DataFrame:
    """``df`` with score, amplitude: of the plume of the kernel's shape that peaks at a sample's time, the amplitude that fits the samples
    under it best and how many of its own sigmas that is; null where no known sample lies under the kernel."""
    before, after = round(kernel.before * 1e6), round(kernel.after * 1e6)

    def go(t: np.ndarray, c: dict[str, np.ndarray], own: np.ndarray) -> dict:
        first, last = np.searchsorted(t, t[own] - before, side="left"), np.searchsorted(t, t[own] + after, side="right")
        out = np.full((2, len(own)), np.nan)
        v, s = c[value].astype(float), c[sigma].astype(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            w = np.where(np.isnan(v) | ~(s > 0), 0.0, 1 / (s * s))
        v = np.where(w > 0, v, 0.0)
        if not kernel.tau and len(own) and (last - first).mean() > 300:
            kv, kk = _kernel_sums(kernel, t, v * w, w, t[own], first, last)
            some = kk > 0
            out[0, some], out[1, some] = kv[some] / np.sqrt(kk[some]), kv[some] / kk[some]
            return {"score": out[0], "amplitude": out[1]}
        for lo, hi, at, of, starts in members(first, last):
            k = kernel.evaluate((t[at] - t[own[lo:hi]][of]) / 1e6)
            kv, kk = np.add.reduceat(k * v[at] * w[at], starts), np.add.reduceat(k * k * w[at], starts)
            some = kk > 0
            out[0, lo:hi][some], out[1, lo:hi][some] = kv[some] / np.sqrt(kk[some]), kv[some] / kk[some]
        return {"score": out[0], "amplitude": out[1]}

    out = over_chunks(df, keys, us, 2 * max(before, after), {"score": "double", "amplitude": "double"}, go, chunk_us=max(chunk_us, 2 * max(before, after)))
    return out.withColumns({k: F.nanvl(F.col(k), F.lit(None)) for k in ("score", "amplitude")})


def matched_peaks(df: DataFrame, keys: list[str], us: str, value: str, sigma: str, kernel: Kernel, *, threshold: float, apart_us: int, chunk_us: int = DAY) -> DataFrame:
    """Samples whose score reaches ``threshold`` and is the highest within ``apart_us`` either side (of equal ones the first):
    ``df``'s columns, score, amplitude."""
    scored = matched_scores(df, keys, us, value, sigma, kernel, chunk_us=chunk_us).where(F.col("score").isNotNull())

    def go(t: np.ndarray, c: dict[str, np.ndarray], own: np.ndarray) -> dict:
        s = c["score"]
        first, last = np.searchsorted(t, t[own] - apart_us, side="left"), np.searchsorted(t, t[own] + apart_us, side="right")
        top = (window_max(s, first, last) <= s[own]) & (window_max(s, first, own) < s[own])
        return {"_top": top & (s[own] >= threshold)}

    # halos of both times, so that a window's ends are whole
    return over_chunks(scored, keys, us, 2 * apart_us + 2, {"_top": "boolean"}, go, chunk_us=max(chunk_us, 2 * apart_us + 2)).where("_top").drop("_top")
