"""Approximate nearest neighbours by cosine: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample (``sample_rows``) and every row is put into a leaf.  A query walks the tree with a
priority queue over its nodes, nearest centroid first, and so ranks the leaves; how many of them it visits is widened on
the sample until calibrated recall reaches ``target_recall``.  Queries meet a leaf's rows in blocks of bounded size on both
sides (a leaf may hold a third of all rows), each block gives its best k, and the best k of these are the result.

Of rows with equal vectors only those of the k + 1 smallest ids can be among the k nearest of any query (one of them may be
the query itself), and of rows that repeat an id only k, so the others are dropped exactly, before any shuffle by leaf.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


@dataclass
class KMeansTree:
    """Flat arrays: ``centroid`` by node, ``children`` (empty: a leaf), ``leaf`` number or -1."""

    centroid: np.ndarray
    children: list[list[int]]
    leaf: list[int]

    @classmethod
    def fit(cls, x: np.ndarray, branching: int, leaf_rows: int, seed: int = 7, rounds: int = 12) -> KMeansTree:
        """Spherical k-means, split until a node holds at most ``leaf_rows`` rows or all its rows are equal."""
        rng, x = np.random.default_rng(seed), _unit(x)
        centroid, children, leaf, todo = [x.mean(0)], [[]], [-1], [(0, np.arange(len(x)))]
        leaves = 0
        while todo:
            node, rows = todo.pop(0)
            parts = [rows]
            if len(rows) > leaf_rows:
                own = x[rows]
                c = own[rng.choice(len(rows), min(branching, len(rows)), replace=False)]
                for _ in range(rounds):
                    near = np.argmax(own @ c.T, 1)
                    sums = np.zeros_like(c)
                    np.add.at(sums, near, own)
                    c = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, _unit(sums), c)
                near = np.argmax(own @ c.T, 1)
                parts = [rows[near == j] for j in range(len(c)) if (near == j).any()]
                kept = [c[j] for j in range(len(c)) if (near == j).any()]
            if len(parts) == 1:
                leaf[node], leaves = leaves, leaves + 1
                continue
            for p, v in zip(parts, kept):
                children[node].append(len(children))
                centroid.append(v)
                children.append([])
                leaf.append(-1)
                todo.append((children[node][-1], p))
        return cls(np.asarray(centroid), children, leaf)

    @property
    def n_leaves(self) -> int:
        return sum(v >= 0 for v in self.leaf)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row: the nearest child at every level."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            kids = self.children[node]
            near = np.argmax(x[rows] @ self.centroid[kids].T, 1)
            todo += [(kid, rows[near == j]) for j, kid in enumerate(kids)]
        return out

    def best_bins(self, q: np.ndarray, visits: int) -> list[int]:
        """The first leaves that a best-bin-first walk reaches."""
        near = -(self.centroid @ q)
        heap, out = [(near[0], 0)], []
        while heap and len(out) < visits:
            _, node = heapq.heappop(heap)
            if self.children[node]:
                for kid in self.children[node]:
                    heapq.heappush(heap, (near[kid], kid))
            else:
                out.append(self.leaf[node])
        return out

    def calibrate(self, x: np.ndarray, k: int, target: float, queries: int = 400, seed: int = 11) -> int:
        """Fewest leaf visits at which the sample's own true neighbours are found with the target recall."""
        x = _unit(x)
        leaf = self.assign(x)
        rng = np.random.default_rng(seed)
        ranks = []
        for i in rng.choice(len(x), min(queries, len(x)), replace=False):
            s = x @ x[i]
            s[i] = -np.inf
            true = np.argsort(-s, kind="stable")[: min(k, len(x) - 1)]
            at = {b: n for n, b in enumerate(self.best_bins(x[i], self.n_leaves))}
            ranks += [at[b] + 1 for b in leaf[true]]
        visits = 1
        while visits < self.n_leaves and np.mean(np.asarray(ranks) <= visits) < target:
            visits += 1
        return visits


def exact_scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosines of one vector with rows, in double precision, with one order of summation for every row."""
    dot, qq, vv = (v * q).sum(1), (q * q).sum(), (v * v).sum(1)
    return dot / (np.sqrt(qq) * np.sqrt(vv))


def block_top_k(q_ids: np.ndarray, q: np.ndarray, v_ids: np.ndarray, v: np.ndarray, k: int) -> pd.DataFrame:
    """Best k rows of a block for each of a block of queries, their own ids left out."""
    out: list[tuple] = []
    vn = _unit(v)
    for a in range(0, len(q), 256):
        near = _unit(q[a : a + 256]) @ vn.T
        for j, s in enumerate(near):
            own = v_ids == q_ids[a + j]
            s[own] = -np.inf
            n = len(s) - int(own.sum())
            if n <= 0:
                continue
            edge = np.partition(s, len(s) - min(k, n))[len(s) - min(k, n)] - 1e-9
            some = np.flatnonzero((s >= edge) & ~own)
            score = exact_scores(q[a + j], v[some])
            best = np.lexsort((v_ids[some], -score))[:k]
            out += [(int(q_ids[a + j]), int(v_ids[some[b]]), float(score[b])) for b in best]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def nearest(vectors: DataFrame, queries: DataFrame, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", sample_rows: int = 20_000, branching: int = 8, leaf_rows: int = 1_500, block_rows: int = 4_096, target_recall: float = 0.98) -> DataFrame:
    """The k nearest found of every query: query_id, rank (from 1), vec_id, score; ties to the smaller vec_id.

    Null, zero and empty vectors, and those with null, NaN or infinite components, take no part; nor do null ids, nor
    vectors of another length than most of the sample.  A row with the query's id is not its own neighbour.  Repeated
    candidate rows count as rows each; of repeated query ids the smallest vector asks.  With fewer than k candidates all
    are returned; empty tables give no rows.  Other columns are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")

    def clean(df: DataFrame) -> DataFrame:
        v = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
        norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
        return v.where("vec_id is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('inf'))").where(norm > 0)

    all_ = clean(vectors)
    # the k + 1 smallest ids of a vector, and of a repeated id as many rows as can be returned
    kept = all_.groupBy("v", "vec_id").agg(F.least(F.count("*"), F.lit(k)).alias("times"))
    order = Window.partitionBy("v").orderBy("vec_id")
    kept = kept.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).select("vec_id", "v", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))).drop("col")
    kept = scratch.write(kept, "rows")
    sample = kept.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toPandas()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if sample.empty:
        return empty
    width = int(sample["v"].map(len).mode().iloc[0])
    sample = sample[sample["v"].map(len) == width]
    kept = kept.where(F.size("v") == width)
    x = np.stack(sample["v"].to_numpy())
    total = kept.count()
    per_leaf = max(16, int(leaf_rows * min(1.0, len(x) / max(total, 1))))
    tree = KMeansTree.fit(x, branching, per_leaf)
    visits = tree.calibrate(x, k, target_recall)

    def to_leaf(it):
        for p in it:
            if len(p):
                yield pd.DataFrame({"vec_id": p["vec_id"], "v": p["v"], "leaf": tree.assign(_unit(np.stack(p["v"].to_numpy())))})

    def to_bins(it):
        for p in it:
            if len(p):
                bins = [tree.best_bins(u, visits) for u in _unit(np.stack(p["v"].to_numpy()))]
                yield pd.DataFrame({"query_id": p["vec_id"], "q": p["v"], "leaf": bins})

    rows = scratch.write(kept.mapInPandas(to_leaf, "vec_id long, v array<double>, leaf long"), "leaves")
    asked = clean(queries).groupBy("vec_id").agg(F.min("v").alias("v")).where(F.size("v") == width)
    asks = asked.mapInPandas(to_bins, "query_id long, q array<double>, leaf array<long>").select("query_id", "q", F.explode("leaf").alias("leaf"))
    asks = scratch.write(asks, "asks")
    # by leaf, of which there are at most sample_rows: how many blocks its rows and its queries make
    blocks = rows.groupBy("leaf").agg(F.ceil(F.count("*") / block_rows).alias("vb")).join(asks.groupBy("leaf").agg(F.ceil(F.count("*") / block_rows).alias("qb")), "leaf")
    blocks = F.broadcast(blocks)
    left = asks.join(blocks, "leaf").select("leaf", "query_id", "q", F.pmod(F.xxhash64("query_id"), "qb").alias("qs"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("vb") - 1)).alias("vs"))
    right = rows.join(blocks, "leaf").select("leaf", "vec_id", "v", F.pmod(F.xxhash64("vec_id"), "vb").alias("vs"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("qb") - 1)).alias("qs"))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return block_top_k(np.empty(0), np.empty((0, 1)), np.empty(0), np.empty((0, 1)), k)
        return block_top_k(a["query_id"].to_numpy(), np.stack(a["q"].to_numpy()), b["vec_id"].to_numpy(), np.stack(b["v"].to_numpy()), k)

    key = ["leaf", "qs", "vs"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(meet, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
