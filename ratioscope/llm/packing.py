"""Cost-balanced packing of tokenized documents into fixed-length sequences.

A block of documents becomes ``ceil(tokens / max_tokens)`` sequences.  Documents, longest first, go whole to the
sequence of least estimated cost (``linear * n + quadratic * n**2`` summed over its pieces: attention stays within a
piece) that has room; those that fit nowhere whole are cut over the room that is left.  So every sequence of a block is
full but one, whose rest is carried into the next block of the same task.  A task's last rest is cut into sequences
whose lengths are powers of two, which need no padding.

One pass, no shuffle: a block's token ids stay in the Python worker (about ``block_tokens * 4`` bytes and the run of
texts in hand).  A retried task makes the same rows, as its input file split is the same.
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import pieces

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long"
#: White space other than blank and newline; texts with any of it are encoded whole.
ODD_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0                　"
ODD_ASCII = ODD_SPACE[:8]


class WordCachedEncoder:
    """Ids of a byte-level BPE tokenizer of the ``tokenizers`` library, as little-endian uint32 bytes.

    Such a tokenizer never merges over the start of a blank-led word, so a text of words parted by single blanks or
    newlines is the concatenation of its words' ids; a word is encoded once per worker.  Any other text, and one that holds
    an added token, is encoded whole.  Unseen words of letters, with sentence marks behind them, go to the library's BPE
    model itself, which spares its pre-tokenizer's work: a vocabulary without a token of a letter and a mark can't merge the two.
    """

    MARKS = ",.;:!?"

    def __init__(self, path: str, limit: int = 500_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.limit = limit
        self.cache: dict[str, bytes] = {}
        self.newline = np.asarray(self.tok.encode("\n", add_special_tokens=False).ids, "<u4")
        assert len(self.newline) == 1
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec["added_tokens"]]
        before = spec["pre_tokenizer"] or {}
        plain = spec["model"]["type"] == "BPE" and spec["normalizer"] is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space")
        mixed = not plain or any(x.isascii() and x.isalpha() and y in self.MARKS for k in spec["model"]["vocab"] if k not in self.added for x, y in zip(k, k[1:]))
        self.model = None if mixed else self.tok.model
        # the byte-level alphabet: printable bytes are themselves, the others follow from U+0100
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(shown)]
        self.alphabet = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    @staticmethod
    def units(text: str) -> list[str] | None:
        """Words with the white space before them; None if the text has runs of white space or unusual kinds."""
        if not text or text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
            return None
        if any(c in text for c in (ODD_ASCII if text.isascii() else ODD_SPACE)):
            return None
        out = text.replace("\n", " \n").split(" ")
        out[0] = "\r" + out[0]  # marks the word without a blank before it
        return out

    def _joined(self, plain: list[str], encode) -> list[bytes] | None:
        """Ids of words, parted by newlines in one call; none of them holds a newline."""
        ids = np.asarray(encode("\n".join(plain)), "<u4")
        cut = np.flatnonzero(ids == self.newline[0])
        if len(cut) != len(plain) - 1:
            return None
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip([0, *(cut + 1).tolist()], [*cut.tolist(), len(ids)])]

    def learn(self, todo: list[str]) -> None:
        if len(self.cache) + len(todo) > self.limit:
            self.cache.clear()
        words, other = [], []
        for u in todo:
            plain = u[1:] if u[0] in "\r\n" else u
            core = plain.rstrip(self.MARKS)
            (words if self.model and core.isalpha() and (core[-1].isascii() or core == plain) else other).append(u)
        lead = self.newline.tobytes()

        def keep(u: str, ids: bytes) -> None:
            self.cache[u] = lead + ids if u[0] == "\n" else ids

        if words:
            # one after another by newlines, so that the bytes of all are mapped at once
            mapped = "\n".join(u[1:] if u[0] in "\r\n" else " " + u for u in words).encode("utf-8", "surrogatepass").decode("latin-1").translate(self.alphabet)
            for u, m in zip(words, mapped.split(self.alphabet[10])):
                keep(u, np.asarray([t.id for t in self.model.tokenize(m)], "<u4").tobytes())
        if other:
            plain = [u[1:] if u[0] in "\r\n" else " " + u for u in other]
            got = self._joined(plain, lambda t: self.tok.encode(t, add_special_tokens=False).ids)
            for u, ids in zip(other, got if got is not None else map(self.whole, plain)):
                keep(u, ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [None if any(a in t for a in self.added) else self.units(t) for t in texts]
        get = self.cache.get
        found = [s and list(map(get, s)) for s in split]
        miss = {s[i] for s, f in zip(split, found) if s and None in f for i, v in enumerate(f) if v is None}
        if miss:
            self.learn(list(miss))
            for s, f in zip(split, found):
                if s and None in f:
                    for i, v in enumerate(f):
                        if v is None:
                            f[i] = self.cache[s[i]]
        return [b"".join(f) if f else self.whole(t) if t else b"" for f, t in zip(found, texts)]


def pack_lengths(lengths: list[int], max_tokens: int, linear: float = 1.0, quadratic: float = 1.0 / 2048) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length); all are full but the last one or none.

    ``lengths``: one number of tokens a document; zeros take no place.  Ties go to the earlier document and sequence.
    """
    total = sum(lengths)
    n = -(-total // max_tokens)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    if not n:
        return out
    room = [max_tokens] * n
    room[-1] = total - max_tokens * (n - 1)
    cost = lambda k: linear * k + quadratic * k * k
    heads, left = 0, []
    for d, k in enumerate(lengths):
        at = 0
        while k - at >= max_tokens and heads < n and room[heads] == max_tokens:
            out[heads].append((d, at, max_tokens))
            room[heads] = 0
            heads, at = heads + 1, at + max_tokens
        if k > at:
            left.append((k - at, d, at))
    left.sort(key=lambda x: (-x[0], x[1]))
    # open sequences by room: a heap each, under a tree of the cheapest
    leaves = 1 << max_tokens.bit_length()
    heaps: list[list[tuple[float, int]]] = [[] for _ in range(max_tokens + 1)]
    none = (float("inf"), n)
    tree = [none] * (2 * leaves)

    def update(r: int) -> None:
        i = r + leaves
        tree[i] = heaps[r][0] if heaps[r] else none
        while i > 1:
            i >>= 1
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

    for s in range(heads, n):
        heaps[room[s]].append((0.0, s))  # rising, so a heap
    for r in {room[s] for s in range(heads, n)}:
        update(r)
    cuts = []
    for k, d, at in left:
        i, found = k + leaves, none  # the cheapest of room k or more
        if k <= max_tokens:
            found = tree[i]
            while i > 1:
                if not i & 1:
                    found = min(found, tree[i + 1])
                i >>= 1
        if found[1] == n:
            cuts.append((k, d, at))
            continue
        c, s = found
        heapq.heappop(heaps[room[s]])
        update(room[s])
        out[s].append((d, at, k))
        room[s] -= k
        if room[s]:
            heapq.heappush(heaps[room[s]], (c + cost(k), s))
            update(room[s])
    open_ = [s for s in range(heads, n) if room[s]]
    for k, d, at in cuts:
        while k:
            s = open_[-1]
            take = min(k, room[s])
            out[s].append((d, at, take))
            room[s] -= take
            k, at = k - take, at + take
            if not room[s]:
                open_.pop()
    return out


def powers(n: int) -> list[int]:
    """n as falling powers of two."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def _pack_partition(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, max_tokens: int, block_tokens: int, linear: float, quadratic: float) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    enc = WordCachedEncoder(tokenizer)
    end = np.asarray([end_id], "<u4").tobytes()
    base = TaskContext.get().partitionId() << 36
    made = 0
    block: list[tuple[int | None, int, int, bytes]] = []  # doc_id, tokens before this part, tokens of the document, ids
    held = 0

    def emit(sequences: list[list[tuple[int, int, int]]]) -> pa.RecordBatch:
        nonlocal made
        cols: list[list] = [[] for _ in range(7)]
        for seq in sequences:
            at = 0
            for d, start, k in seq:
                doc_id, before, all_, ids = block[d]
                row = (doc_id, before + start, k, zlib.crc32(ids[4 * start : 4 * (start + k)]), all_, base + made, at)
                for c, v in zip(cols, row):
                    c.append(v)
                at += k
            made += 1
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    def close(last: bool) -> pa.RecordBatch:
        nonlocal block, held
        seqs = pack_lengths([len(b[3]) // 4 for b in block], max_tokens, linear, quadratic)
        rest: list[tuple[int, int, int]] = []
        if seqs and sum(k for *_, k in seqs[-1]) < max_tokens:
            rest = seqs.pop()
        if last:
            for size in powers(sum(k for *_, k in rest)):
                seq = []
                while size:
                    d, start, k = rest.pop(0)
                    take = min(k, size)
                    seq.append((d, start, take))
                    size -= take
                    if k > take:
                        rest.insert(0, (d, start + take, k - take))
                seqs.append(seq)
        out = emit(seqs)
        block = [(block[d][0], block[d][1] + s, block[d][2], block[d][3][4 * s : 4 * (s + k)]) for d, s, k in rest]
        held = sum(len(b[3]) // 4 for b in block)
        return out

    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        for a, b in pieces(texts.to_pylist()):
            run = [t or "" for t in texts.slice(a, b - a).to_pylist()]
            for doc_id, e in zip(ids[a:b], enc.encode(run)):
                e += end
                block.append((doc_id, 0, len(e) // 4, e))
                held += len(e) // 4
            if held >= block_tokens:
                yield close(False)
    yield close(True)


def pack_documents(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, max_tokens: int = 2048, block_tokens: int = 1 << 20, linear: float = 1.0, quadratic: float = 1.0 / 2048) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are the end id alone; a null id stays null; repeated rows are packed each; other columns,
    whatever their names, are not read.  An empty table gives no rows.
    """
    if docs.isStreaming:
        raise ValueError("packing needs a bounded table")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    args: dict[str, Any] = {"tokenizer": tokenizer, "end_id": end_id, "max_tokens": max_tokens, "block_tokens": block_tokens, "linear": linear, "quadratic": quadratic}
    return rows.mapInArrow(lambda it: _pack_partition(it, **args), SCHEMA)
