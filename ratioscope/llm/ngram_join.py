"""Exact n-gram Jaccard join that skips by set relations.

Sets are the distinct word n-grams of whole texts.  Equal sets are one *class*.  Every class puts its rarest n-grams (its
prefix, by a hashed corpus-wide count, ties by hash) into inverted lists; two classes that link share a list.

* Index level: lists are cut into blocks by set size, of which only the same and the next one can match, and an entry
  carries its position in its set's order, which bounds the overlap still possible, so entries are skipped by position.
* Pair level: of the lists that two classes share, one lets the pair out.
* Answer level: in each block of a list one class leads.  A class is first verified against the leader it meets most; when
  they link, it takes over its leader's answers (they are one component).  Then only pairs of *different* components of one
  list are still open, and in those the members of the list's main component are never paired among themselves.

Pairs are let out of a list only if their sizes, positions and parity sketches (whose distance bounds the sets' difference from
below) allow a link, and are then verified on the full sets.  Nothing is capped:
each linked pair of classes is found or already joined through others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ..scratch import Scratch
from .words import U64, hash_words, mix, ngrams, pieces, split_run

SKETCH = 8  # 64-bit words of the parity sketch
FIRST = 16  # least n-grams of a class by which a pair is let out of one list only
FINE, LARGE = 256, 1000  # of the finer one that sets of more than LARGE members have too
MARKS = 18  # 2**MARKS numbers of 64 bits mark, by hash, the documents whose texts are read again


def shingle_sets(texts: list, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram hashes of each text: a shorter text is one n-gram, an empty one has none."""
    flat, ends = split_run(texts, lower=True)
    h = hash_words(flat)
    g = ngrams(h, n)
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        if b - a >= n:
            yield np.unique(g[a : b - n + 1])
        elif b > a:
            yield mix(ngrams(h[a:b], b - a) + U64(b - a))
        else:
            yield np.empty(0, U64)


def class_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def sketch(s: np.ndarray, words: int = SKETCH) -> np.ndarray:
    """Parity of the number of members in each of 64 * words cells: two sketches differ in at most as many bits as the sets."""
    cell = np.bincount((s >> U64(64 - (64 * words - 1).bit_length())).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(cell.astype(np.uint8)).view(np.int64)


def _count_pass(batches: Iterator[pa.RecordBatch], n: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Key, size and sketch of every row; at the end the counts of n-grams by hash cell, each class counted once."""
    seen: set[int] = set()
    counts = np.zeros(1 << bits, np.uint32)
    names = ["doc_id", "n", "k1", "k2", "sketch", "fine", "cells", "counts"]

    def rows(ids: pa.Array, keys: list, sizes: list, sk: list, fine: list, cells: list, cnt: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array([k and k[0] for k in keys], pa.int64()), pa.array([k and k[1] for k in keys], pa.int64()), pa.array(sk, pa.list_(pa.int64())), pa.array(fine, pa.list_(pa.int64())), pa.array(cells, pa.binary()), pa.array(cnt, pa.binary())], names=names)

    for b in batches:
        texts = b.column(1).to_pylist()
        for s, e in pieces(texts):
            keys, sizes, sk, fine = [], [], [], []
            for x in shingle_sets(texts[s:e], n):
                keys.append(class_key(x) if len(x) else None)
                sizes.append(len(x))
                sk.append(sketch(x) if len(x) else None)
                fine.append(sketch(x, FINE) if len(x) > LARGE else None)
                if len(x) and keys[-1][0] not in seen:
                    seen.add(keys[-1][0])
                    np.add.at(counts, (x >> U64(64 - bits)).astype(np.int64), 1)
            yield rows(b.column(0).slice(s, e - s), keys, sizes, sk, fine, [None] * (e - s), [None] * (e - s))
    hit = np.flatnonzero(counts)
    if len(hit):
        yield rows(pa.array([None], pa.int64()), [None], [-1], [None], [None], [hit.astype("<u4").tobytes()], [counts[hit].astype("<u4").tobytes()])


def _merge_counts(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << bits, np.uint32)
    for b in batches:
        for c, k in zip(b.column(0), b.column(1)):
            counts[np.frombuffer(c.as_py(), "<u4")] += np.frombuffer(k.as_py(), "<u4")
    hit = np.flatnonzero(counts)
    if len(hit):
        yield pa.RecordBatch.from_arrays([pa.array([hit.astype("<u4").tobytes()], pa.binary()), pa.array([counts[hit].astype("<u4").tobytes()], pa.binary())], names=["cells", "counts"])


def prefix_length(size: int, percent: int) -> int:
    """So many first n-grams of a set hold at least one of those it shares with any set it links to."""
    return size - -(-percent * size // 100) + 1


def _prefix_pass(batches: Iterator[pa.RecordBatch], n: int, bits: int, counts, percent: int) -> Iterator[pa.RecordBatch]:
    """List entries of every class met in this task."""
    seen: set[int] = set()
    rank = counts.value
    for b in batches:
        texts = b.column(0).to_pylist()
        for s, e in pieces(texts):
            token, cls, size, pos = [], [], [], []
            for x in shingle_sets(texts[s:e], n):
                if not len(x):
                    continue
                k = class_key(x)[0]
                if k in seen:
                    continue
                seen.add(k)
                p = prefix_length(len(x), percent)
                common = rank[(x >> U64(64 - bits)).astype(np.int64)]
                # rarest first, ties by hash (x is sorted)
                first = np.argsort(common, kind="stable")[:p]
                token.append(x[first].view(np.int64))
                cls.append(np.full(p, k))
                size.append(np.full(p, len(x), np.int32))
                pos.append(np.arange(p, dtype=np.int32))
            if token:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (token, cls, size, pos)], names=["token", "cls", "size", "pos"])


def _set_pass(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(0).to_pylist()
        for s, e in pieces(texts):
            sets = [x for x in shingle_sets(texts[s:e], n) if len(x)]
            keys = [class_key(x) for x in sets]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["k1", "k2", "items"])


def _mark(doc_id: str) -> tuple[Column, Column]:
    """The number that marks a document, and its bit there."""
    return F.shiftrightunsigned(F.xxhash64(doc_id), 64 - MARKS), F.expr(f"shiftleft(1L, cast(xxhash64({doc_id}) & 63 as int))")


def marked(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc_id is in ``ids``, and a few others: before any shuffle, by a table of at most 2**MARKS numbers, whatever
    the size of ``ids``.  The more ids, the more others; none that is in ``ids`` is left out."""
    at, bit = _mark("doc_id")
    marks = ids.groupBy(at.alias("at")).agg(F.bit_or(bit).alias("bits"))
    return rows.join(F.broadcast(marks), (at == F.col("at")) & (F.col("bits").bitwiseAND(bit) != 0), "left_semi")


def jaccard_components(docs: DataFrame, *, n: int = 3, percent: int = 90, count_bits: int = 20, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """One row an input row: doc_id, n_shingles, component_id.

    Two documents link when ``100 * |A & B| >= percent * |A | B|``; component_id is the smallest doc_id reachable.  Null
    and empty texts have no n-grams and are linked with nothing.  Rows with a null id have a null component and link with
    nothing.  Rows that share an id are judged by their own texts, and are one node where their sets are equal.  Other
    columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "jaccard")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    first = scratch.write(rows.mapInArrow(lambda it: _count_pass(it, n, count_bits), "doc_id long, n long, k1 long, k2 long, sketch array<long>, fine array<long>, cells binary, counts binary"), "info")
    info = first.where("n >= 0").select("doc_id", "n", "k1", "k2", "sketch", "fine")
    part = first.where("n < 0").select("cells", "counts")
    left = part.count()
    while left > 16:  # the counts of all tasks are summed in a tree
        left = -(-left // 16)
        part = scratch.write(part.repartition(left).mapInArrow(lambda it: _merge_counts(it, count_bits), "cells binary, counts binary"), "counts")
    counts = np.zeros(1 << count_bits, np.uint32)
    for c, k in part.toLocalIterator():
        counts[np.frombuffer(c, "<u4")] += np.frombuffer(k, "<u4")
    shared = spark.sparkContext.broadcast(counts)  # 4 << count_bits bytes

    classes = scratch.write(info.where("doc_id is not null and n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("sketch").alias("sketch"), F.min("fine").alias("fine")), "classes")

    entries = rows.where("doc_id is not null").select("text").mapInArrow(lambda it: _prefix_pass(it, n, count_bits, shared, percent), "token long, cls long, size int, pos int").where("token is not null and size is not null and pos is not null").repartition("token")
    # reads all columns, so that it and the join below share one shuffle, and one pass over the texts
    met = entries.groupBy("token").agg(F.min("cls").alias("c0"), F.max("cls").alias("c1"), F.min("size").alias("s0"), F.min("pos").alias("p0")).where("c0 != c1")
    # sets of one block differ in size by at most the factor at which they can still link
    block = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int") if percent < 100 else F.col("size")
    lists = scratch.write(entries.join(met, "token").where("size >= s0 and pos >= p0").select("token", "cls", "size", "pos", block.alias("block")), "lists")
    shared.destroy()

    by_key = classes.select(F.col("k1").alias("cls"), "n", "sketch")
    def apart(one: str, other: str) -> Column:
        return sum((F.bit_count(F.col(one)[i].bitwiseXOR(F.col(other)[i])) for i in range(SKETCH)), F.lit(0))

    def may_link(na: str, nb: str, sa: str, sb: str) -> Column:
        """|A & B| >= need and |A ^ B| = na + nb - 2 |A & B|, which the sketches' distance can't exceed."""
        need = F.ceil(F.lit(percent) * (F.col(na) + F.col(nb)) / F.lit(100 + percent))
        return apart(sa, sb) <= F.col(na) + F.col(nb) - 2 * need

    def verified(pairs: DataFrame) -> DataFrame:
        """Links, by the classes' smallest documents, among pairs (a, b) of keys."""
        la, lb = (classes.where("fine is not null").select(F.col("k1").alias(c), F.col("n").alias(f"n{c}"), F.col("fine").alias(f"f{c}")) for c in "ab")
        split = F.aggregate(F.zip_with("fa", "fb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
        need = F.ceil(F.lit(percent) * (F.col("na") + F.col("nb")) / F.lit(100 + percent))
        large = pairs.join(la, "a", "left").join(lb, "b", "left")
        near = scratch.write(large.where(F.col("fa").isNull() | F.col("fb").isNull() | (split <= F.col("na") + F.col("nb") - 2 * need)).select("a", "b"), "near")
        # only sets of pairs that are still possible travel
        keys = near.select(F.col("a").alias("k1")).union(near.select(F.col("b").alias("k1"))).distinct()
        reps = scratch.write(classes.join(keys, "k1", "left_semi").select(F.col("rep").alias("doc_id")).distinct(), "reps")
        found = marked(rows, reps).join(reps, "doc_id", "left_semi").select("text").mapInArrow(lambda it: _set_pass(it, n), "k1 long, k2 long, items array<long>")
        sets = scratch.write(found, "sets")
        sa, sb = (sets.select(F.col("k1").alias(c), F.col("k2").alias(f"{c}2"), F.col("items").alias(f"i{c}")) for c in "ab")
        both = F.size(F.array_intersect("ia", "ib")).cast("long")
        sure = near.join(sa, "a").join(sb, "b").where(100 * both >= percent * (F.size("ia") + F.size("ib") - both)).select("a", "a2", "b", "b2")
        ra, rb = (classes.select(F.col("k1").alias(c), F.col("k2").alias(f"{c}2"), F.col("rep").alias(f"r{c}")) for c in "ab")
        out = scratch.write(sure.join(ra, ["a", "a2"]).join(rb, ["b", "b2"]).select(F.col("ra").alias("a"), F.col("rb").alias("b")), "links")
        scratch.drop(near, reps, sets)
        return out

    lead = lists.groupBy("token", "block").agg(F.min("cls").alias("b"), F.max("cls").alias("most")).where("b != most").drop("most")
    votes = lists.join(lead, ["token", "block"]).where("cls != b").groupBy(F.col("cls").alias("a"), "b").agg(F.count("*").alias("votes"))
    best = votes.groupBy("a").agg(F.max(F.struct("votes", "b")).alias("x")).select("a", F.col("x.b").alias("b"))
    by_a, by_b = (by_key.select(F.col("cls").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "ab")
    links = verified(best.join(by_a, "a").join(by_b, "b").where(may_link("na", "nb", "sa", "sb")).select("a", "b"))
    comp = scratch.write(components(links, scratch), "comp")

    home = classes.join(comp, F.col("rep") == F.col("node"), "left").select(F.col("k1").alias("cls"), F.coalesce("comp", "rep").alias("comp"))
    home = home.groupBy("cls").agg(F.min("comp").alias("comp"), F.max("comp").alias("other"))  # two sets of one key, if ever: keep both open
    homed = scratch.write(lists.join(home, "cls").select("token", "cls", "size", "pos", "block", F.when(F.col("comp") == F.col("other"), F.col("comp")).otherwise(-F.abs("cls") - 1).alias("comp")), "homed")
    main = homed.groupBy("token", "comp").agg(F.count("*").alias("k")).groupBy("token").agg(F.max(F.struct("k", "comp")).alias("m"), F.count("*").alias("comps")).where("comps > 1").select("token", F.col("m.comp").alias("main"))
    open_ = scratch.write(homed.join(main, "token"), "open")
    # A pair comes out of the list of the least n-gram that both sides' FIRST least open ones hold: if they hold any, that is
    # the least that the two share at all.  Pairs that share none of these come out of every list that they share.
    least = open_.groupBy("cls").agg(F.slice(F.sort_array(F.collect_list("token")), 1, FIRST).alias("least"))
    open_ = open_.join(by_key.select("cls", "sketch").join(least, "cls"), "cls")
    x = open_.where("comp != main").select("token", F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)).alias("block"), F.col("cls").alias("a"), F.col("size").alias("na"), F.col("pos").alias("pa"), F.col("comp").alias("ca"), F.col("sketch").alias("sa"), F.col("least").alias("la"))
    y = open_.select("token", "block", F.col("cls").alias("b"), F.col("size").alias("nb"), F.col("pos").alias("pb"), F.col("comp").alias("cb"), F.col("sketch").alias("sb"), F.col("least").alias("lb"), (F.col("comp") == F.col("main")).alias("in_main"))
    reach = F.least("pa", "pb") + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    fits = (F.col("ca") != F.col("cb")) & (F.col("in_main") | (F.col("a") < F.col("b"))) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & ((100 + percent) * reach >= percent * (F.col("na") + F.col("nb")))
    here = F.coalesce(F.array_min(F.array_intersect("la", "lb")) == F.col("token"), F.lit(True))
    pairs = x.join(y, ["token", "block"]).where(fits & may_link("na", "nb", "sa", "sb") & here).select("a", "b").distinct()
    more = verified(pairs)
    comp = components(links.unionByName(more), scratch)

    out = info.join(classes.select("k1", "k2", "rep"), ["k1", "k2"], "left").join(comp, F.col("rep") == F.col("node"), "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "rep", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
