"""Resampling towards a target's distribution of hashed word runs.

A feature is a run of one to ``n`` consecutive words.  One scan over a text keeps the running zlib states of the last ``n``
starts in a ring; each next word extends them all by a space and itself and opens a state of its own, so every run's CRC comes
from its prefix's, and no run is ever built as a string.  The scan's buckets are written once, two bytes a feature, and serve
both the corpus' counts and the documents' weights.

A bucket's gain is the log of its smoothed share in the target over that in the corpus; a document's weight is the sum over its
features; Gumbel noise drawn by hash from the id turns the highest scores into a draw without replacement.

Nulls and empty texts have no words and no features: weight 0.  Rows with a null id count in the corpus and get a weight, but have
no noise: null score, never drawn and not among the N rows drawn from.  Rows that repeat are rows of their own (equal rows get
neighbouring ranks).  An empty table gives no rows, an empty target equal shares of one.  Other columns are not read.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch

#: A-z, 0-9 and bytes beyond ASCII are of words, A-Z is lower-cased, all else parts words.
_WORDS = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def run_crcs(words: list[bytes], n: int) -> list[int]:
    """CRC-32 of every run of 1 to ``n`` words joined by one space, by the run's last word."""
    if n == 1:
        return list(map(crc32, words))
    ring: deque[int] = deque(maxlen=n - 1)  # states of the last starts, oldest first
    out: list[int] = []
    for w in words:
        states = list(map(crc32, repeat(b" " + w), ring))
        states.append(crc32(w))
        out += states
        ring.clear()
        ring.extend(states)
    return out


def bucketed(rows: DataFrame, n: int, buckets: int) -> DataFrame:
    """id, n_words, n_features and the buckets of all features, packed; ``rows`` are (id, text)."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                words, packed, features = [], [], []
                for text in part.column(1):
                    t = text.as_py()
                    w = t.encode("utf-8", "surrogatepass").translate(_WORDS).split() if t else []
                    crcs = np.array(run_crcs(w, n), np.int64) % buckets
                    words.append(len(w))
                    features.append(len(crcs))
                    packed.append(crcs.astype(kind).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words, pa.int64()), pa.array(features, pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "n_words", "n_features", "packed"])

    return rows.mapInArrow(go, "doc_id long, n_words long, n_features long, packed binary")


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All packed numbers of a batch, and each row's offset among them."""
    data = [x.as_py() for x in column]
    sizes = np.array([len(x) for x in data], np.int64) // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(data), kind), np.concatenate([[0], np.cumsum(sizes)])


def bucket_counts(scanned: DataFrame, buckets: int) -> DataFrame:
    """bucket, count: summed within a task first, so that a task hands over a row a bucket at most."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                total += np.bincount(_flat(b.column(0).slice(at, 256), kind)[0], minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bucket", "count"])

    return scanned.select("packed").mapInArrow(go, "bucket long, count long").groupBy("bucket").agg(F.sum("count").alias("count"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """bucket, gain in thousandths, of the buckets that the corpus has; ``buckets`` rows at most."""
    all_s, all_t = (F.lit(float(df.agg(F.sum("count")).first()[0] or 0)) for df in (corpus, target))
    both = corpus.withColumnRenamed("count", "s").join(target.withColumnRenamed("count", "t"), "bucket", "left")
    s, t = F.col("s").cast("double"), F.coalesce(F.col("t").cast("double"), F.lit(0.0))
    share = (t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets))
    return both.select("bucket", F.floor(1000 * F.log(share)).cast("long").alias("gain"))


def weigh(scanned: DataFrame, gains: list[int]) -> DataFrame:
    """doc_id, n_words, n_features, weight: sums of the features' gains."""
    shared = scanned.sparkSession.sparkContext.broadcast(np.array(gains, np.int64))
    kind = "<u2" if len(gains) <= 1 << 16 else "<u4"

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                cells, ends = _flat(part.column(3), kind)
                run = np.concatenate([[0], np.cumsum(shared.value[cells])])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(run[ends[1:]] - run[ends[:-1]])], names=["doc_id", "n_words", "n_features", "weight"])

    return scanned.mapInArrow(go, "doc_id long, n_words long, n_features long, weight long")


def rank_highest(rows: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """``rows`` with rank: 1, 2, ... for the highest ``percent`` of scores, ties to smaller doc_id, null for the others.

    Rows are sorted over ranges of scores; a range's offset is the sum of the sizes before it, so no task sees all rows.  The
    driver gets a row a range.
    """
    order = [F.desc("score"), F.col("doc_id"), F.col("_row")]  # the row's number parts rows that repeat
    run = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    run = scratch.write(run.withColumn("_at", F.monotonically_increasing_id()).drop("_row"), "sorted")
    part = F.shiftright("_at", 33)
    sizes = run.groupBy(part.alias("_part")).count().orderBy("_part").collect()
    most = percent * sum(r["count"] for r in sizes) // 100
    ends, before = np.cumsum([0, *(r["count"] for r in sizes)]).tolist(), [r["_part"] for r in sizes]
    offsets = rows.sparkSession.createDataFrame(list(zip(before, ends)), "_part long, _before long")
    rank = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return run.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn("rank", F.when(rank <= most, rank)).drop("_part", "_at", "_before")


def resample(docs: DataFrame, target: DataFrame, *, n: int = 1, buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row; ``target`` needs ``text_col``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "importance")
    text = F.col(text_col).cast("string").alias("text")
    scanned = scratch.write(bucketed(docs.select(F.col(id_col).cast("long").alias("doc_id"), text), n, buckets), "buckets")
    goal = bucketed(target.select(F.lit(None).cast("long").alias("doc_id"), text), n, buckets)
    counts = [scratch.write(bucket_counts(df, buckets), name) for df, name in ((scanned, "corpus"), (goal, "target"))]
    gains = [0] * buckets
    for r in bucket_gains(*counts, buckets).collect():
        gains[r.bucket] = r.gain
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = scratch.write(weigh(scanned, gains).withColumn("score", F.col("weight") + noise), "scores")
    scratch.drop(scanned)
    drawn = (F.col("n_words") >= min_words) & F.col("score").isNotNull()
    rest = scored.where(~drawn).withColumn("rank", F.lit(None).cast("long"))
    return rank_highest(scored.where(drawn), percent, scratch).unionByName(rest)
