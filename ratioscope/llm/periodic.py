"""Periodic runs of words, by Crochemore's partition refinement.

Positions are in one class at level l if the l words from them are equal.  A class of level l + 1 holds those of a class of level l
whose successors share a class of level l.  Two neighbours in a class of level q that are q apart start a square whose root is no
power itself; squares of one period at consecutive positions are one maximal run.

The first levels, where most positions of ordinary prose lose their last equal partner, are made by sorts of all documents of a
batch together.  Positions left are refined by the smaller-half strategy: of the parts that a class fell into, all but the largest
split the classes of their predecessors at the next level, so that a position is moved a logarithmic number of times.  Words are
compared exactly.  Documents are independent: one pass, no shuffle; a task holds a few megabytes of text, or one document.

Null and empty texts have no words and no runs.  Rows are judged each, whatever their ids; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import pieces, split_run

#: Levels made by sorting before single positions are moved.
SORTED_LEVELS = 4
WORD = r"[^\x20\x09-\x0D]+"


def _squares_by_sorting(words: np.ndarray, ends: np.ndarray, levels: int) -> tuple[list[tuple[int, np.ndarray]], np.ndarray, np.ndarray, np.ndarray]:
    """(period, starts) of the squares of levels below ``levels``; then the positions that share a class at that level, with
    their classes and those of the level before, by class and position."""
    doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    final = np.zeros(len(words) + 1, bool)
    final[ends[1:] - 1] = True  # an empty document marks a place that is final already, or the spare one
    pos = np.arange(len(words))
    key, parent = doc * (int(words.max(initial=0)) + 1) + words, np.zeros(len(words), np.int64)
    found = []
    for level in range(1, levels + 1):
        order = np.argsort(key, kind="stable")
        pos, key, parent = pos[order], key[order], parent[order]
        fresh = np.append(True, key[1:] != key[:-1])[: len(key)]
        cls = np.cumsum(fresh) - 1
        many = np.bincount(cls, minlength=1)[cls] > 1
        pos, cls, parent = pos[many], cls[many], parent[many]
        if level == levels or not len(pos):
            break
        near = (cls[1:] == cls[:-1]) & (pos[1:] - pos[:-1] == level)
        found.append((level, pos[:-1][near]))
        label = np.full(len(words) + 1, -1)
        label[pos] = cls
        after = np.where(final[pos], -1, label[pos + 1])
        go = after >= 0
        pos, parent = pos[go], cls[go]
        key = parent * (int(cls[-1]) + 1) + after[go]
    return found, pos, cls, parent


def _squares_by_refining(pos: np.ndarray, cls_of: np.ndarray, parent: np.ndarray, ends: np.ndarray, level: int) -> Iterator[tuple[int, list[int]]]:
    """(period, starts) of the squares from ``level`` on.  Positions are numbered by text order; a class is a linked list."""
    order = np.argsort(pos, kind="stable")
    at = pos[order]
    doc_end = ends[np.searchsorted(ends, at, side="right")]
    room = ((doc_end - at) // 2).tolist()  # a longer period's square would leave the document
    joined = np.append(False, at[1:] == at[:-1] + 1)
    joined[np.flatnonzero(np.isin(at, ends))] = False  # the first word of a document follows nothing
    before = np.where(joined, np.arange(len(at)) - 1, -1).tolist()
    ended = np.flatnonzero(~np.append(joined[1:], False)).tolist()  # the next position has no partner, or isn't there
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    same = np.append(cls_of[1:] == cls_of[:-1], False)
    nxt, prv = np.full(len(at), -1), np.full(len(at), -1)
    nxt[place[:-1][same[:-1]]] = place[1:][same[:-1]]
    prv[place[1:][same[:-1]]] = place[:-1][same[:-1]]
    heads = np.flatnonzero(np.append(True, ~same[:-1]))
    tail = place[np.append(heads[1:] - 1, len(at) - 1)].tolist()  # by class, as classes are numbered below
    number = np.cumsum(np.append(False, ~same[:-1]))
    cls = np.empty(len(at), np.int64)
    cls[place] = number
    size = np.bincount(number).tolist()
    # parts of a class of the level before: all but the largest split others
    of = parent[heads]
    largest = pd.Series(size).groupby(of).transform("idxmax").to_numpy()
    members = np.split(place, heads[1:])
    pending = [members[c].tolist() for c in np.flatnonzero(largest != np.arange(len(heads)))]
    at, cls, nxt, prv = at.tolist(), cls.tolist(), nxt.tolist(), prv.tolist()
    apart: dict[int, list[int]] = defaultdict(list)
    for i, j in enumerate(nxt):
        if j >= 0 and level <= at[j] - at[i] <= room[i]:
            apart[at[j] - at[i]].append(i)
    last = max(room)
    lost = ended  # positions whose successor is alone: each becomes alone
    while level <= last:
        if level in apart:
            starts = [at[i] for i in apart.pop(level) if nxt[i] >= 0 and at[nxt[i]] - at[i] == level]
            if starts:
                yield level, starts
        if not (pending or lost):
            break
        level += 1
        touched: dict[int, list[int]] = defaultdict(list)
        for group in pending:
            into: dict[int, int] = {}
            for i in group:
                j = before[i]
                if j < 0:
                    continue
                c = cls[j]
                new = into.get(c)
                if new is None:
                    if size[c] == 1:  # alone already
                        continue
                    new = into[c] = len(size)
                    size.append(0)
                    tail.append(-1)
                    touched[c].append(new)
                _move(j, c, new, level, at, cls, nxt, prv, size, tail, room, apart)
        for j in lost:
            if size[c := cls[j]] > 1:
                touched[c].append(len(size))
                size.append(0)
                tail.append(-1)
                _move(j, c, len(size) - 1, level, at, cls, nxt, prv, size, tail, room, apart)
        pending, lost = [], []
        for c, parts in touched.items():
            parts = [c, *parts] if size[c] else parts
            big = max(parts, key=size.__getitem__)
            for p in parts:
                if p != big:
                    k, group = tail[p], []
                    while k >= 0:
                        group.append(k)
                        k = prv[k]
                    pending.append(group[::-1])


def _move(j: int, c: int, new: int, level: int, at: list, cls: list, nxt: list, prv: list, size: list, tail: list, room: list, apart: dict) -> None:
    """Position ``j`` from class ``c`` to the end of class ``new``; new neighbours are noted by their distance."""
    p, q = prv[j], nxt[j]
    if p >= 0:
        nxt[p] = q
        if q >= 0 and level <= (d := at[q] - at[p]) <= room[p]:
            apart[d].append(p)
    if q >= 0:
        prv[q] = p
    else:
        tail[c] = p
    p = tail[new]
    prv[j], nxt[j] = p, -1
    if p >= 0:
        nxt[p] = j
        if level <= (d := at[j] - at[p]) <= room[p]:
            apart[d].append(p)
    tail[new] = j
    cls[j] = new
    size[c] -= 1
    size[new] += 1


def maximal_runs(words: np.ndarray, ends: np.ndarray, *, min_length: int = 12, sorted_levels: int = SORTED_LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start (in ``words``), length and period of every maximal run of at least two periods and ``min_length`` words, by start,
    then period.  ``words`` are numbers, equal for equal words; ``ends`` the offsets of the documents, from 0."""
    found, pos, cls, parent = _squares_by_sorting(words, ends, sorted_levels)
    if len(pos):
        found += [(q, np.array(s)) for q, s in _squares_by_refining(pos, cls, parent, ends, sorted_levels)]
    out = []
    for q, starts in found:
        if len(starts):
            starts = np.unique(starts)
            first = np.flatnonzero(np.append(True, np.diff(starts) != 1))
            k = np.diff(np.append(first, len(starts)))
            out.append(np.stack([starts[first], k - 1 + 2 * q, np.full(len(first), q)]))
    if not out:
        none = np.empty(0, np.int64)
        return none, none, none
    s, length, q = np.concatenate(out, axis=1)
    keep = length >= min_length
    s, length, q = s[keep], length[keep], q[keep]
    order = np.lexsort((q, s))
    return s[order], length[order], q[order]


def periodic_runs(docs: DataFrame, *, min_length: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), collapsed: of every run only the words of its first
    period are kept, joined by one space."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in pieces(texts):
                flat, ends = split_run(texts[lo:hi])
                a = np.empty(len(flat), object)
                a[:] = flat
                ids = pd.factorize(a)[0] if len(flat) else np.empty(0, np.int64)
                s, length, q = maximal_runs(ids, ends, min_length=min_length)
                cover = np.zeros(len(flat) + 1, np.int64)
                np.add.at(cover, s + q, 1)
                np.add.at(cover, s + length, -1)
                gone = np.cumsum(cover)[:-1] > 0
                of = np.searchsorted(ends, s, side="right") - 1
                offsets = np.searchsorted(of, np.arange(hi - lo + 1))
                text = []
                for i in range(hi - lo):
                    x, y = ends[i], ends[i + 1]
                    own = flat[x:y] if not gone[x:y].any() else [w for w, g in zip(flat[x:y], gone[x:y]) if not g]
                    text.append(b" ".join(own))
                runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(s - ends[of]), pa.array(length), pa.array(q)], ["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(np.diff(ends)), runs, pa.array(text, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(go, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_periodic_tails(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text: a tenth of the texts, told by the id's CRC-32, get a tail that repeats its own first words."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("_h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    # words are a column of their own: they are found once a row, and only where they are used
    rows = rows.withColumn("_words", F.when((F.col("_h") % 10 == 0) & F.col("text").rlike(WORD), F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    n, g = F.size("_words").cast("long"), F.floor(F.col("_h") / 10)
    rows = rows.withColumn("_n", n).withColumn("_a", g % n).withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + g % 8)))
    at = lambda c: c.cast("int")
    rest = F.col("_n") - F.col("_a")
    root = F.slice("_words", at(F.col("_a") + 1), at(F.col("_p")))
    tail = F.slice(F.flatten(F.array_repeat(root, at(F.ceil(rest / F.col("_p"))))), F.lit(1), at(rest))
    new = F.array_join(F.concat(F.slice("_words", F.lit(1), at(F.col("_a"))), tail), " ")
    return rows.select("doc_id", F.when(F.col("_words").isNotNull(), new).otherwise(F.col("text")).alias("text"))
