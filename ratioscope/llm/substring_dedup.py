"""Removal of word windows that another document of smaller id also holds, by FM-indexes over content-made shards.

1. Every window of ``window`` words has an anchor: the least hash of its ``anchor``-word grams.  Equal windows have equal
   anchors, so windows routed by anchor meet in one shard.  Runs of windows with one anchor travel as one segment.
2. A first pass counts anchors by document.  Anchors of one document only are left out of the second pass, by a Bloom
   filter of fixed size ``bloom_bits`` (it fills up as data grows; then more segments travel, none is lost).  Anchors of
   very many documents, at most a bounded number of them, are hot: their windows are routed one by one, by their own hash.
3. Within a task, a segment that a smaller document of the task holds too is covered at once and does not travel, nor
   does a whole text that a smaller document repeats.  So a passage in a third of all documents is a row per task.
4. Each shard builds an FM-index of its segments, streams them through it backwards, and finds for every window the rows
   that share its words; it is covered if their smallest doc_id is smaller than its own.
5. Covered intervals return to their documents in one join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fm_index import FMIndex
from .words import U64, carried, hash_words, mix, ngrams, pieces, split_run, window_mask

_GOLD = U64(0x9E3779B97F4A7C15)
SEGMENT_WINDOWS = 48
WORD_BYTES = 6  # of each word's hash that shards compare


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def segments(h: np.ndarray, ends: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first word and number of windows of each run of windows; a run stays within a text."""
    pos = np.flatnonzero(window_mask(ends, window))
    if not len(pos):
        return np.empty(0, U64), pos, pos
    low = sliding_min(ngrams(h, anchor), window - anchor + 1)[pos]
    new = np.ones(len(pos), bool)
    new[1:] = (low[1:] != low[:-1]) | (pos[1:] != pos[:-1] + 1)
    # a text's first window starts a run, also where texts touch
    new[np.isin(pos, ends[:-1])] = True
    first = np.flatnonzero(new)
    since = np.arange(len(pos)) - np.repeat(first, np.diff(np.append(first, len(pos))))
    first = np.flatnonzero(since % SEGMENT_WINDOWS == 0)
    return low[first], pos[first], np.diff(np.append(first, len(pos)))


class Texts:
    """Reads a task's batches run by run, leaving out texts that a document of smaller or equal id repeats."""

    def __init__(self) -> None:
        self.least: dict[bytes, int] = {}

    def read(self, batches: Iterator[pa.RecordBatch]):
        """Yields (ids, row keys, word hashes, ends, number of words of each left-out copy); copies have no words."""
        for b in batches:
            ids, rids, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_pylist()
            for s, e in pieces(texts):
                run, copies = texts[s:e], np.zeros(e - s, np.int64)
                for i, t in enumerate(run):
                    if not t:
                        continue
                    key = hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    have = self.least.get(key)
                    if have is not None and have <= ids[s + i]:
                        # an equal id is the same row again: its words are covered where the first one's are
                        copies[i] = len(t.encode("utf-8", "surrogatepass").split()) if have < ids[s + i] else 0
                        run[i] = None
                    else:
                        self.least[key] = int(ids[s + i])
                flat, ends = split_run(run)
                yield ids[s:e], rids[s:e], hash_words(flat), ends, copies


def _anchor_pass(batches: Iterator[pa.RecordBatch], window: int, anchor: int, slices: int) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        key, count = np.unique(np.concatenate(held), return_counts=True)
        part = (key % U64(slices)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        key, count, part = key[order], np.minimum(count[order], 65535).astype("<u2"), part[order]
        cut = np.searchsorted(part, np.arange(slices + 1))
        some = [i for i in range(slices) if cut[i] < cut[i + 1]]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([key[cut[i] : cut[i + 1]].tobytes() for i in some], pa.binary()), pa.array([count[cut[i] : cut[i + 1]].tobytes() for i in some], pa.binary())], names=["slice", "keys", "counts"])

    for _, _, h, ends, _ in Texts().read(batches):
        low, at, _ = segments(h, ends, window, anchor)
        if len(low):
            doc = np.searchsorted(ends, at, side="right")
            order = np.lexsort((low, doc))
            low, doc = low[order], doc[order]
            one = np.ones(len(low), bool)
            one[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
            held.append(low[one])
            size += int(one.sum())
            if size > 4_000_000:
                yield from flush()
                held, size = [], 0
    if held:
        yield from flush()


def _cell(key: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Word of a slice's Bloom region and the three bits in it."""
    m = mix(key ^ _GOLD)
    one = U64(1)
    mask = (one << (m & U64(63))) | (one << (m >> U64(6) & U64(63))) | (one << (m >> U64(12) & U64(63)))
    return ((m >> U64(20)) % U64(words)).astype(np.int64), mask


def _bloom_slice(t: pa.Table, words: int, hot_docs: int) -> pa.Table:
    keys = np.concatenate([np.frombuffer(x.as_py(), "<u8") for x in t["keys"]])
    counts = np.concatenate([np.frombuffer(x.as_py(), "<u2") for x in t["counts"]]).astype(np.int64)
    key, inv = np.unique(keys, return_inverse=True)
    total = np.bincount(inv, counts).astype(np.int64)
    bits = np.zeros(words, U64)
    at, mask = _cell(key[total > 1], words)
    np.bitwise_or.at(bits, at, mask)
    return pa.table({"slice": pa.array([t["slice"][0].as_py()], pa.int32()), "bits": pa.array([bits.tobytes()], pa.binary()), "hot": pa.array([key[total >= hot_docs].tobytes()], pa.binary())})


def _expand(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the words of each piece, one after another, and each word's place in its piece."""
    first = np.cumsum(lengths) - lengths
    rel = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    return np.repeat(starts, lengths) + rel, rel


def _route_pass(batches: Iterator[pa.RecordBatch], window: int, anchor: int, shards: int, known) -> Iterator[pa.RecordBatch]:
    """Packed rows: kind 0 are segments for a shard, kind 1 covered intervals."""
    from pyspark import TaskContext

    bloom, hot = known.value
    slices, words = bloom.shape
    names = ["shard", "kind", "ids", "rids", "starts", "sizes", "words"]
    turn = TaskContext.get().partitionId()
    buf: list[tuple] = []
    size = 0

    def packed(shard: list[int], kind: int, cols: list[list[bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array([kind] * len(shard), pa.int32()), *(pa.array(c, pa.binary()) for c in cols)], names=names)

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal turn
        key, ids, rids, starts, wins, lens, full = (np.concatenate([x[i] for x in buf]) for i in range(7))
        text = np.concatenate([x[7] for x in buf])
        at = np.cumsum(lens) - lens
        covered = full.copy()
        live = np.flatnonzero(~full)
        if len(live):
            _, rel = _expand(at[live], lens[live])
            w = text  # only live pieces have words
            content = mix(np.add.reduceat(mix(w + (rel.astype(U64) + U64(1)) * _GOLD), at[live]) + lens[live].astype(U64))
            order = np.lexsort((ids[live], content))
            c = content[order]
            new = np.ones(len(c), bool)
            new[1:] = c[1:] != c[:-1]
            least = np.repeat(ids[live][order][new], np.diff(np.append(np.flatnonzero(new), len(c))))
            covered[live[order]] = ids[live][order] > least
        away = np.flatnonzero(~covered)
        if len(away):
            shard = (mix(key[away]) % U64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            away, shard = away[order], shard[order]
            idx, _ = _expand(at[away], lens[away])
            raw = text[idx].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES].tobytes()
            edge = np.concatenate([[0], np.cumsum(lens[away])]) * WORD_BYTES
            cut = np.flatnonzero(np.diff(shard, prepend=-1))
            cut = np.append(cut, len(shard))
            rng = list(zip(cut[:-1].tolist(), cut[1:].tolist()))
            take = lambda x, kind: [x[away[a:b]].astype(kind).tobytes() for a, b in rng]
            yield packed(shard[cut[:-1]].tolist(), 0, [take(ids, "<i8"), take(rids, "<i8"), take(starts, "<i4"), take(wins, "<i4"), [raw[edge[a] : edge[b]] for a, b in rng]])
        here = np.flatnonzero(covered)
        if len(here):
            a, b = starts[here], starts[here] + np.where(full[here], wins[here], wins[here] + window - 1)
            new = np.ones(len(here), bool)
            new[1:] = (ids[here][1:] != ids[here][:-1]) | (rids[here][1:] != rids[here][:-1]) | (a[1:] > b[:-1]) | (a[1:] < a[:-1])
            first = np.flatnonzero(new)
            b = np.maximum.reduceat(b, first)
            turn += 1
            yield packed([turn % shards], 1, [[ids[here][first].astype("<i8").tobytes()], [rids[here][first].astype("<i8").tobytes()], [a[first].astype("<i4").tobytes()], [b.astype("<i4").tobytes()], [b""]])

    for ids, rids, h, ends, copies in Texts().read(batches):
        key, at, wins = segments(h, ends, window, anchor)
        if len(hot):
            is_hot = np.isin(key, hot)
            if is_hot.any():
                one, _ = _expand(at[is_hot], wins[is_hot])
                key = np.concatenate([key[~is_hot], ngrams(h, window)[one]])
                keep = np.concatenate([np.zeros(int((~is_hot).sum()), bool), np.ones(len(one), bool)])
                at, wins = np.concatenate([at[~is_hot], one]), np.concatenate([wins[~is_hot], np.ones(len(one), np.int64)])
                order = np.argsort(at, kind="stable")
                key, at, wins, keep = key[order], at[order], wins[order], keep[order]
            else:
                keep = np.zeros(len(key), bool)
        else:
            keep = np.zeros(len(key), bool)
        if len(key):
            cell, mask = _cell(key, words)
            keep |= (bloom[(key % U64(slices)).astype(np.int64), cell] & mask) == mask
            key, at, wins = key[keep], at[keep], wins[keep]
        doc = np.searchsorted(ends, at, side="right") - 1
        lens = wins + window - 1
        idx, _ = _expand(at, lens)
        whole = np.flatnonzero(copies >= window)
        n, k = len(whole), len(key)
        buf.append((np.concatenate([key, np.zeros(n, U64)]), np.concatenate([ids[doc], ids[whole]]), np.concatenate([rids[doc], rids[whole]]), np.concatenate([at - ends[doc], np.zeros(n, np.int64)]), np.concatenate([wins, copies[whole]]), np.concatenate([lens, np.zeros(n, np.int64)]), np.concatenate([np.zeros(k, bool), np.ones(n, bool)]), h[idx]))
        size += len(idx)
        if size > 2_000_000:
            yield from flush()
            buf, size = [], 0
    if buf:
        yield from flush()


def _shard(t: pa.Table, window: int) -> pa.Table:
    """Covered intervals of one shard's segments, and those that came along."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    kinds = t["kind"].to_numpy()
    col = lambda name, kind, dt: np.concatenate([np.frombuffer(x.as_py(), dt) for x, k in zip(t[name], kinds) if k == kind]).astype(np.int64)
    if (kinds == 1).any():
        out.append((col("ids", 1, "<i8"), col("rids", 1, "<i8"), col("starts", 1, "<i4") << 32 | col("sizes", 1, "<i4")))
    if (kinds == 0).any():
        ids, rids, starts, wins = col("ids", 0, "<i8"), col("rids", 0, "<i8"), col("starts", 0, "<i4"), col("sizes", 0, "<i4")
        raw = np.frombuffer(b"".join(x.as_py() for x, k in zip(t["words"], kinds) if k == 0), np.uint8).reshape(-1, WORD_BYTES)
        word = np.zeros((len(raw), 8), np.uint8)
        word[:, :WORD_BYTES] = raw
        rank = np.unique(word.view("<u8").ravel(), return_inverse=True)[1] + 1
        lens = wins + window - 1
        place = np.cumsum(lens + 1) - (lens + 1)
        text = np.zeros(int((lens + 1).sum()), np.int64)  # 0 after each piece
        idx, _ = _expand(place, lens)
        text[idx] = rank
        owner = np.full(len(text), np.iinfo(np.int64).max)
        owner[idx] = np.repeat(ids, lens)
        index = FMIndex(text, window)
        least = np.minimum.reduceat(owner[index.rows], index.group_start)
        hit = np.zeros(len(text) + 1, np.int64)
        for piece, at, group in index.stream(text, place, lens):
            hit[at] = least[group] < ids[piece]
        # runs of covered windows; the last window - 1 words of a piece start none, so runs end within their piece
        edge = np.diff(hit, prepend=0)
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        piece = np.searchsorted(place, a, side="right") - 1
        off = starts[piece] - place[piece]
        out.append((ids[piece], rids[piece], (a + off) << 32 | (b + off + window - 1)))
    cols = [np.concatenate([x[i] for x in out]) for i in range(3)]
    return pa.table({"doc_id": pa.array(cols[0], pa.int64()), "rid": pa.array(cols[1], pa.int64()), "span": pa.array(cols[2], pa.int64())})


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without their covered words; untouched texts keep their bytes."""
    for b in batches:
        texts, spans = b.column(1).to_pylist(), b.column(2)
        for s, e in pieces(texts):
            n, gone, kept, clean = [], [], [], []
            for i in range(s, e):
                words = texts[i].encode("utf-8", "surrogatepass").split() if texts[i] else []
                n.append(len(words))
                if spans[i].is_valid:
                    x = np.asarray(spans[i].values)
                    cover = np.zeros(len(words) + 1, np.int64)
                    np.add.at(cover, x >> 32, 1)
                    np.add.at(cover, x & 0xFFFFFFFF, -1)
                    keep = np.cumsum(cover)[:-1] <= 0
                    words = [w for w, k in zip(words, keep.tolist()) if k]
                gone.append(n[-1] - len(words))
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
                clean.append(kept[-1] if gone[-1] else texts[i])
            rest = [c.slice(s, e - s) for c in b.columns[3:]]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(s, e - s), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(clean, pa.string()), *rest], names=["doc_id", "n_words", "n_removed", "kept", "text", "row"][: 5 + len(rest)])


def remove_repeats(docs: DataFrame, *, window: int = 13, anchor: int = 4, bloom_bits: int = 1 << 26, hot_share: int = 500, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row an input row: doc_id, n_words, n_removed, kept (its kept words joined by blanks), text; with ``carry`` also the
    input row, but for its text, as the struct ``row``.

    A word goes if a window of ``window`` words covers it whose word sequence also starts in a document of smaller id;
    windows are judged on the input.  ``text`` is the input's text where nothing goes, else ``kept``.  Null and empty texts
    have no words; texts shorter than a window lose nothing; rows with a null id lose nothing and cover nothing; rows that
    share an id do not cover each other.  Other columns are not read and may have any names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *([carried(docs, text_col)] if carry else [])).withColumn("rid", F.xxhash64("text"))
    scan = rows.where("doc_id is not null and text is not null").select("doc_id", "rid", "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total, size = scan.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    # tasks grow in number with the texts, not in size
    slices = max(64, parts, min(1 << 16, size >> 24))
    words = max(1, bloom_bits // 64 // slices)
    hot_docs = max(1000, total // hot_share)
    found = scan.mapInArrow(lambda it: _anchor_pass(it, window, anchor, slices), "slice int, keys binary, counts binary").groupBy("slice").applyInArrow(lambda t: _bloom_slice(t, words, hot_docs), "slice int, bits binary, hot binary")
    bloom = np.zeros((slices, words), U64)
    hot = [np.empty(0, U64)]
    for s, bits, h in found.toLocalIterator():  # bloom_bits in all; hot anchors: at most hot_share times a document's anchors
        bloom[s] = np.frombuffer(bits, "<u8")
        hot.append(np.frombuffer(h, "<u8"))
    known = spark.sparkContext.broadcast((bloom, np.concatenate(hot)))
    shards = max(2 * parts, size >> 24)
    routed = scan.mapInArrow(lambda it: _route_pass(it, window, anchor, shards, known), "shard int, kind int, ids binary, rids binary, starts binary, sizes binary, words binary")
    spans = routed.groupBy("shard").applyInArrow(lambda t: _shard(t, window), "doc_id long, rid long, span long")
    spans = spans.groupBy("doc_id", "rid").agg(F.collect_list("span").alias("spans"))
    joined = rows.join(spans, ["doc_id", "rid"], "left").select("doc_id", "text", "spans", *(["row"] if carry else []))
    schema = T.StructType([T.StructField(c, T.StringType() if c in ("kept", "text") else T.LongType()) for c in ("doc_id", "n_words", "n_removed", "kept", "text")])
    return joined.mapInArrow(_strip, schema.add(rows.schema["row"]) if carry else schema)
