"""Quality rules: base rules, then a calibrated logistic regression over hashed word and character n-grams.

A feature is the share of a text's word 1- and 2-grams, or of its character 2-, 3- and 4-grams, that fall into a hash
cell, so a text's score is a mean of weights and long texts need no stored vectors.  The model is fitted in one task,
on at most ``max_rows`` labelled texts (those of smallest id hash, as many of either class), with balanced classes; a
fifth of these is held out and calibrates the score by Platt scaling.  Scoring and base rules run in Arrow batches over
whole texts, in one pass and without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import U64, hash_words, mix, ngrams, pieces, split_run, window_mask

BITS = 16
WORD_N, CHAR_N = (1, 2), (2, 3, 4)
SYMBOLS = b"#*$%&|<>"
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"


def _codes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a run of texts, one after another, and the texts' offsets."""
    data = [(t or "").encode("utf-32-le", "surrogatepass") for t in texts]
    ends = np.concatenate([[0], np.cumsum([len(d) // 4 for d in data], dtype=np.int64)])
    return np.frombuffer(b"".join(data), "<u4"), ends


def _cells(texts: list, words: np.ndarray, word_ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """For each kind of n-gram: cell of every position, offsets of the texts, n, and the first cell of the kind."""
    base = 0
    for n in WORD_N:
        g = ngrams(words, n) >> U64(64 - BITS)
        yield g.astype(np.int64), word_ends, n, base
        base += 1 << BITS
    codes, ends = _codes(texts)
    for n in CHAR_N:
        m = len(codes) - n + 1
        g = np.zeros(max(m, 0), np.uint32)
        with np.errstate(over="ignore"):
            for j in range(n if m > 0 else 0):
                g = g * np.uint32(0x9E3779B1) + codes[j : j + m]
            g ^= g >> np.uint32(15)
            g *= np.uint32(0x85EBCA6B)
        yield (g >> np.uint32(32 - BITS)).astype(np.int64), ends, n, base
        base += 1 << BITS


N_CELLS = (len(WORD_N) + len(CHAR_N)) << BITS


def features(texts: list) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Sparse shares of each text: cells and values."""
    flat, ends = split_run(texts)
    idx: list[list] = [[] for _ in texts]
    val: list[list] = [[] for _ in texts]
    for g, at, n, base in _cells(texts, hash_words(flat), ends):
        for i in range(len(texts)):
            own = g[at[i] : max(at[i + 1] - n + 1, at[i])]
            if len(own):
                c, k = np.unique(own, return_counts=True)
                idx[i].append(c + base)
                val[i].append(k / len(own))
    none_i, none_v = np.empty(0, np.int64), np.empty(0)
    return [np.concatenate(x) if x else none_i for x in idx], [np.concatenate(x) if x else none_v for x in val]


@dataclass
class QualityModel:
    """Weights by cell; probability = sigmoid(slope * (bias + score) + shift).  Without weights every text passes."""

    weights: np.ndarray | None
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def scores(self, texts: list, words: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for g, at, n, base in _cells(texts, words, ends):
            k = np.maximum(np.diff(at) - n + 1, 0)
            total = np.concatenate([[0.0], np.cumsum(self.weights[base + g])])
            s = np.minimum(at[:-1], len(g))
            out += np.where(k > 0, (total[np.minimum(s + k, len(g))] - total[s]) / np.maximum(k, 1), 0.0)
        return out

    def probability(self, score: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * score + self.shift, -500, 500)))


def _minimize(fun, x: np.ndarray, rounds: int, memory: int = 10) -> np.ndarray:
    """L-BFGS with backtracking."""
    f, g = fun(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, alpha = g.copy(), []
        for s, y in reversed(past):
            alpha.append(s @ d / (y @ s))
            d -= alpha[-1] * y
        if past:
            s, y = past[-1]
            d *= (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(alpha)):
            d += s * (a - y @ d / (y @ s))
        step, slope = 1.0 if past else 1.0 / max(np.linalg.norm(g), 1e-12), g @ d
        for _ in range(30):
            fn, gn = fun(x - step * d)
            if fn <= f - 1e-4 * step * slope:
                break
            step /= 2
        else:
            return x
        s, y = -step * d, gn - g
        if y @ s > 1e-12:
            past = [*past[1 - memory :], (s, y)]
        x, done, f, g = x + s, f - fn < 1e-9 * max(1.0, abs(f)), fn, gn
        if done:
            break
    return x


def train(idx: list[np.ndarray], val: list[np.ndarray], label: np.ndarray, *, l2: float = 1e-4, rounds: int = 100) -> QualityModel:
    """Balanced logistic regression; every fifth row is held out for Platt scaling.  One class only: no weights."""
    if len(set(label.tolist())) < 2:
        return QualityModel(None)
    held = np.arange(len(label)) % 5 == 4
    if len(set(label[held].tolist())) < 2 or len(set(label[~held].tolist())) < 2:
        held[:] = False
    row = np.repeat(np.arange(len(idx), dtype=np.int32), [len(i) for i in idx])
    col, v = np.concatenate(idx), np.concatenate(val)
    idx = val = None
    y = label.astype(float)
    fit = ~held
    share = np.where(y > 0, 0.5 / max(y[fit].sum(), 1), 0.5 / max((1 - y[fit]).sum(), 1)) * fit
    on = fit[row]
    fr, fc, fv = row[on], col[on], v[on]
    scale = 30.0  # shares are small numbers; this makes the penalty act on comparable weights

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        z = x[-1] + np.bincount(fr, fv * x[fc], len(y)) * scale
        m = np.where(y > 0, z, -z)
        err = share * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        grad = np.append(np.bincount(fc, fv * err[fr], N_CELLS) * scale + 2 * l2 * x[:-1], err.sum())
        return float(share @ np.logaddexp(0, -m) + l2 * x[:-1] @ x[:-1]), grad

    x = _minimize(loss, np.zeros(N_CELLS + 1), rounds)
    model = QualityModel(x[:-1] * scale, float(x[-1]))
    rows = held if held.any() else fit
    score = (x[-1] + np.bincount(row, v * x[col], len(y)) * scale)[rows]
    pos, neg = y[rows].sum(), (1 - y[rows]).sum()
    goal = np.where(y[rows] > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    weight = np.where(y[rows] > 0, 0.5 / pos, 0.5 / neg)

    def platt(p: np.ndarray) -> tuple[float, np.ndarray]:
        z = p[0] * score + p[1]
        err = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - goal)
        return float(weight @ (np.logaddexp(0, z) - goal * z)), np.array([err @ score, err.sum()])

    model.slope, model.shift = map(float, _minimize(platt, np.array([1.0, 0.0]), 100))
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, *, max_rows: int = 1_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Fit on at most ``max_rows`` labelled rows, half of either class if both have as many.

    Null ids, labels and texts are left out; an id with both labels counts as low quality; of rows that repeat an id the
    text of least hash is taken.  No labelled row, or one class only, gives a model that lets every text pass.  The broadcast
    side is bounded by ``max_rows``, and so is the task that fits; the driver gets the weights.
    """
    lab = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    lab = lab.groupBy("doc_id").agg(F.min("y").alias("y"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    some = [lab.where(F.col("y") == c).orderBy(*order).limit(max_rows // 2) for c in (0, 1)]
    rows = texts.join(F.broadcast(some[0].unionByName(some[1])), "doc_id")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = b.column(1).to_pylist()
            for s, e in pieces(t):
                i, v = features(t[s:e])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, e - s), b.column(2).slice(s, e - s), b.column(3).slice(s, e - s), pa.array([x.astype("<i4").tobytes() for x in i], pa.binary()), pa.array([x.astype("<f4").tobytes() for x in v], pa.binary())], names=["doc_id", "y", "h", "i", "v"])

    def fit(t: pa.Table) -> pa.Table:
        t = t.take(np.argsort(mix(t["doc_id"].to_numpy().astype(U64)), kind="stable"))
        idx, val = ([np.frombuffer(x.as_py(), kind) for x in t[c]] for c, kind in (("i", "<i4"), ("v", "<f4")))
        m = train(idx, val, t["y"].to_numpy())
        return pa.table({"weights": pa.array([None if m.weights is None else m.weights.astype("<f4").tobytes()], pa.binary()), "bias": [m.bias], "slope": [m.slope], "shift": [m.shift]})

    got = rows.select("doc_id", "text", "y", F.xxhash64("text").alias("h")).mapInArrow(go, "doc_id long, y int, h long, i binary, v binary")
    one = got.groupBy("doc_id").agg(F.min(F.struct("h", "y", "i", "v")).alias("x")).select("doc_id", "x.y", "x.i", "x.v")
    model = one.groupBy(F.lit(0).alias("all")).applyInArrow(fit, "weights binary, bias double, slope double, shift double").first()
    if model is None or model.weights is None:
        return QualityModel(None)
    return QualityModel(np.frombuffer(model.weights, "<f4"), model.bias, model.slope, model.shift)


def measure(texts: list, model: QualityModel | None, *, window: int = 8, min_words: int = 20, max_repeat_percent: int = 30, threshold: float = 0.5) -> dict[str, np.ndarray]:
    """Counts and verdicts of a run of texts."""
    flat, ends = split_run(texts)
    h = hash_words(flat)
    n = np.diff(ends)
    doc = np.repeat(np.arange(len(texts)), n)
    codes, at = _codes(texts)
    space = (codes == 32) | ((codes >= 9) & (codes <= 13))
    count = lambda flag: np.diff(np.concatenate([[0], np.cumsum(flag)])[at])
    dup = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        lines = [x for x in t.encode("utf-8", "surrogatepass").split(b"\n") if x.strip()] if t else []
        dup[i] = len(lines) - len(set(lines))
    ok = window_mask(ends, window)
    pos = np.flatnonzero(ok)
    rep = np.zeros(len(texts), np.int64)
    if len(pos):
        key = ngrams(h, window)[pos] ^ mix(doc[pos].astype(U64) + U64(1))
        twice = pos[pd.Series(key).duplicated(keep=False).to_numpy()]
        cover = np.zeros(len(h) + 1, np.int64)
        np.add.at(cover, twice, 1)
        np.add.at(cover, twice + window, -1)
        rep = np.bincount(doc[np.cumsum(cover)[:-1] > 0], minlength=len(texts))
    failed = (n < min_words) | (100 * rep > max_repeat_percent * n)
    p = model.probability(model.scores(texts, h, ends)) if model and model.weights is not None else np.ones(len(texts))
    return {"n_words": n, "word_chars": count(~space), "n_symbols": count(np.isin(codes, np.frombuffer(SYMBOLS, np.uint8).astype("<u4"))), "n_dup_lines": dup, "n_repeat_words": rep, "base_failed": failed, "probability": p, "kept": ~failed & (p >= threshold)}


def apply_quality(docs: DataFrame, model: QualityModel, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Counts, calibrated probability and verdict of every row.

    Null and empty texts have no words and fail the base rules; ids may be null or repeated and are carried along; other
    columns are not read; an empty table gives no rows.  Texts are never cut.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = b.column(1).to_pylist()
            for s, e in pieces(t):
                m = measure(t[s:e], shared.value, threshold=threshold)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, e - s), *(pa.array(m[c]) for c in list(m))], names=["doc_id", *m])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(go, SCHEMA)


def keep_quality(docs: DataFrame, model: QualityModel, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the rules and the model keep, with all their columns, whatever their names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = b.column(at).to_pylist()
            for s, e in pieces(t):
                kept = measure(t[s:e], shared.value, threshold=threshold)["kept"]
                yield b.slice(s, e - s).filter(pa.array(kept))

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # mapInArrow can't resolve names with dots
    return plain.mapInArrow(go, plain.schema).toDF(*docs.columns)
