"""SentencePiece models run by the tokenizers library.

The model's protobuf is parsed here; its normaliser (character map, blank handling), its blank marker, its scores (unigram)
or merge order (BPE) and its byte fallback are rebuilt as a ``tokenizers`` pipeline.  Batches are encoded by the library's
own threads.  ``verify`` holds ids against the sentencepiece library; every worker runs it on ``PROBES`` before use.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import pieces

MARK = "▁"
#: Kinds of pieces in the model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
PROBES = ["", " ", "a", "Hello world", "  two  blanks ", "tab\tand\nnewline", "naïve café 東京 😀 ​", "▁mark ▁ ▁▁", "x" * 50, "1234567890 3.14", "<s> </s> <unk> <0x41>", "ﬁ Å ½", "\u0000 \u0001"]


def fields(data: bytes) -> Iterator[tuple[int, Any]]:
    """Numbers and raw values of a protobuf message."""

    def varint(i: int) -> tuple[int, int]:
        x = shift = 0
        while True:
            x |= (data[i] & 127) << shift
            i, shift = i + 1, shift + 7
            if data[i - 1] < 128:
                return x, i

    i = 0
    while i < len(data):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            v, i = varint(i)
        elif kind == 1:
            v, i = data[i : i + 8], i + 8
        elif kind == 2:
            n, i = varint(i)
            v, i = data[i : i + n], i + n
        elif kind == 5:
            v, i = data[i : i + 4], i + 4
        else:
            raise ValueError(f"protobuf wire type {kind}")
        yield tag >> 3, v


@dataclass
class SpmModel:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    suffix: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    strip_blanks: bool = True
    escape: bool = True

    @classmethod
    def parse(cls, data: bytes) -> SpmModel:
        m = cls()
        for n, v in fields(data):
            if n == 1:
                text, score, kind = "", 0.0, NORMAL
                for k, x in fields(v):
                    if k == 1:
                        text = x.decode("utf-8")
                    elif k == 2:
                        score = struct.unpack("<f", x)[0]
                    elif k == 3:
                        kind = x
                m.pieces.append((text, score, kind))
            elif n == 2:
                spec = dict(fields(v))
                m.model_type, m.byte_fallback, m.suffix = spec.get(3, UNIGRAM), bool(spec.get(35, 0)), bool(spec.get(24, 0))
            elif n == 3:
                spec = dict(fields(v))
                m.charsmap = spec.get(2, b"")
                m.dummy_prefix, m.strip_blanks, m.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        return m

    @classmethod
    def load(cls, path: str) -> SpmModel:
        with open(path, "rb") as f:
            return cls.parse(f.read())

    @property
    def unknown(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    def merges(self) -> list[tuple[str, str]]:
        """Every split of a piece into two pieces, best-scored piece first, then by the halves' ids."""
        ids = {p: i for i, (p, _, k) in enumerate(self.pieces) if k in (NORMAL, USER, UNUSED)}
        rows = []
        for p, score, kind in self.pieces:
            if kind in (NORMAL, UNUSED):
                rows += [(-score, ids[p[:i]], ids[p[i:]], p[:i], p[i:]) for i in range(1, len(p)) if p[:i] in ids and p[i:] in ids]
        return [(a, b) for *_, a, b in sorted(rows)]

    def tokenizer(self):
        """The whole pipeline as one ``tokenizers.Tokenizer``."""
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers

        if self.suffix or not self.escape or any(k == USER for *_, k in self.pieces):
            raise ValueError("only models that mark blanks before words, without user-defined pieces, are supported")
        unk = self.pieces[self.unknown][0]
        if self.model_type == UNIGRAM:
            # control, unused and byte pieces never match a text: their names here hold a blank, which normalized texts don't;
            # unknown stretches become bytes in SpmCodec
            low = min(s for _, s, k in self.pieces if k == NORMAL)
            vocab = [(p, s) if k == NORMAL else (f" {i}", low) for i, (p, s, k) in enumerate(self.pieces)]
            model = models.Unigram(vocab, self.unknown, byte_fallback=False)
        elif self.model_type == BPE:
            model = models.BPE({p: i for i, (p, _, _) in enumerate(self.pieces)}, self.merges(), unk_token=unk, fuse_unk=True, byte_fallback=self.byte_fallback)
        else:
            raise ValueError(f"model type {self.model_type}")
        steps: list = []
        if self.charsmap:
            steps.append(normalizers.Precompiled(self.charsmap))
        if self.strip_blanks:
            steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(MARK))
        steps.append(normalizers.Replace(" ", MARK))
        if self.strip_blanks:  # markers written in the text itself go at the end, too
            steps.append(normalizers.Replace(Regex(MARK + "+$"), ""))
        tok = Tokenizer(model)
        tok.normalizer = normalizers.Sequence(steps)
        back: list = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
        if self.dummy_prefix:
            back.append(decoders.Strip(" ", 1, 0))
        tok.decoder = decoders.Sequence(back)
        return tok


class SpmCodec:
    """Encodes and decodes with word-wise caching where no piece spans the start of a word."""

    def __init__(self, path: str, limit: int = 500_000):
        self.model = SpmModel.load(path)
        self.tok = self.model.tokenizer()
        self.norm = self.tok.normalizer
        self.by_word = not any(MARK in p.lstrip(MARK) for p, _, k in self.model.pieces if k in (NORMAL, USER))
        #: normalising is marking blanks and no more
        self.plain = not self.model.charsmap and not self.model.strip_blanks and self.model.dummy_prefix
        self.starts = np.asarray([p.startswith(MARK) for p, *_ in self.model.pieces])
        self.shown = [bytes([int(p[3:-1], 16)]) if k == BYTE else p.replace(MARK, " ").encode() for p, _, k in self.model.pieces]
        by_byte = {int(p[3:-1], 16): i for i, (p, _, k) in enumerate(self.model.pieces) if k == BYTE}
        self.bytes = by_byte if self.model.model_type == UNIGRAM and self.model.byte_fallback else None
        self.limit = limit
        self.cache: dict[str, bytes] = {}
        from tokenizers import Tokenizer, decoders

        self.raw = Tokenizer(self.tok.model)  # on normalized text
        self.raw.decoder = decoders.Fuse()

    def normalize(self, text: str) -> str:
        if self.plain:
            return MARK + text.replace(" ", MARK) if text else ""
        return self.norm.normalize_str(text) if text else ""

    def words(self, text: str) -> list[str] | None:
        """Words of the normalized text, without their markers; None where a word has none or more than one."""
        if not self.by_word:
            return None
        if self.plain and MARK not in text:
            return None if not text or text[0] == " " or text[-1] == " " or "  " in text else text.split(" ")
        normal = self.normalize(text)
        if not normal.startswith(MARK) or MARK + MARK in normal or normal.endswith(MARK):
            return None
        return normal[1:].split(MARK)

    def _ids(self, e, text: str) -> np.ndarray:
        """Ids of an encoding; what a unigram model doesn't know becomes its bytes' pieces."""
        ids = e.ids
        if self.bytes is not None and self.model.unknown in ids:
            out: list[int] = []
            for i, (a, b) in zip(ids, e.offsets):
                out += [self.bytes[x] for x in text[a:b].encode("utf-8", "surrogatepass")] if i == self.model.unknown else [i]
            ids = out
        return np.asarray(ids, "<u4")

    def _learn(self, some: list[str], run: int = 512) -> None:
        """Encode unseen words, ``run`` in a string, whose words' starts are those of pieces with a marker."""
        if len(self.cache) + len(some) > self.limit:
            self.cache.clear()
        runs = [some[i : i + run] for i in range(0, len(some), run)]
        texts = ["".join(MARK + w for w in r) for r in runs]
        for words, text, e in zip(runs, texts, self.raw.encode_batch(texts, add_special_tokens=False)):
            ids = self._ids(e, text)
            cut = np.flatnonzero(self.starts[ids])
            if len(cut) != len(words):
                self.cache.update((w, self._one(w)) for w in words)
                continue
            raw, edge = ids.tobytes(), [*cut.tolist(), len(ids)]
            self.cache.update((w, raw[4 * a : 4 * b]) for w, a, b in zip(words, edge, edge[1:]))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian uint32 ids of each text."""
        split = [self.words(t) if t else None for t in texts]
        get = self.cache.get
        found = [s and list(map(get, s)) for s in split]
        miss = {s[i] for s, f in zip(split, found) if s and None in f for i, v in enumerate(f) if v is None}
        if miss:
            self._learn(list(miss))
            for s, f in zip(split, found):
                if s and None in f:
                    for i, v in enumerate(f):
                        if v is None:
                            f[i] = self.cache[s[i]]
        whole = [i for i, f in enumerate(found) if not f and texts[i]]
        normal = [self.normalize(texts[i]) for i in whole]
        rest = {i: self._ids(e, t).tobytes() for i, t, e in zip(whole, normal, self.raw.encode_batch(normal, add_special_tokens=False))} if whole else {}
        return [b"".join(f) if f else rest.get(i, b"") for i, f in enumerate(found)]

    def _one(self, word: str) -> bytes:
        return self._ids(self.raw.encode(MARK + word, add_special_tokens=False), MARK + word).tobytes()

    def decode(self, ids: list[list[int]]) -> list[str]:
        """Texts of ids: the pieces' bytes where these are UTF-8, which is what the library gives too, else its own decoder."""
        at, out = self.shown.__getitem__, []
        for row in ids:
            parts = list(map(at, row))
            if self.model.dummy_prefix or self.model.strip_blanks:
                # the first piece loses its blank; where blanks are stripped so do those after it, while nothing is left
                for i, p in enumerate(parts):
                    parts[i] = p.removeprefix(b" ")
                    if parts[i] or not self.model.strip_blanks:
                        break
            try:
                out.append(b"".join(parts).decode("utf-8"))
            except UnicodeDecodeError:
                out.append(b"".join(parts).decode("utf-8", "replace") if self.bytes is not None else self.tok.decode(row, skip_special_tokens=False))
        return out


def verify(codec: SpmCodec, path: str, texts: list[str]) -> list[str]:
    """Texts whose ids or decoded forms differ from the sentencepiece library's."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    bad = []
    for t, raw in zip(texts, codec.encode(texts)):
        ids = np.frombuffer(raw, "<u4").tolist()
        if ids != sp.encode(t) or codec.decode([ids])[0] != sp.decode(ids):
            bad.append(t)
    return bad


def encode_documents(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, with_text: bool = True) -> DataFrame:
    """One row an input row: doc_id, n_tokens, n_unknown, n_fallback, ids_crc32 (of little-endian uint32 ids), round_trip
    (decoding gives the normalised text), and, if asked for, ids and the decoded text.

    Null and empty texts have no ids and decode to the empty text.  Ids of rows may be null or repeated; other columns are
    not read; an empty table gives no rows.  Texts are encoded whole.  A worker whose tokenizer differs from the
    sentencepiece library on ``PROBES`` fails.
    """
    schema = "doc_id long, n_tokens long, n_unknown long, n_fallback long, ids_crc32 long, round_trip boolean" + (", ids array<int>" if with_ids else "") + (", decoded string" if with_text else "")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = SpmCodec(model_path)
        if bad := verify(codec, model_path, PROBES):
            raise ValueError(f"ids differ from the sentencepiece library's: {bad}")
        kinds = np.asarray([k for *_, k in codec.model.pieces])
        lead = codec.model.dummy_prefix
        for b in batches:
            texts = b.column(1).to_pylist()
            for s, e in pieces(texts):
                run = [t or "" for t in texts[s:e]]
                raw = codec.encode(run)
                ids = [np.frombuffer(x, "<u4") for x in raw]
                back = codec.decode([i.tolist() for i in ids])
                want = [codec.normalize(t) for t in run]
                same = [(w[1:] if lead else w).replace(MARK, " ") == d for w, d in zip(want, back)]
                cols = [b.column(0).slice(s, e - s), pa.array([len(i) for i in ids], pa.int64()), pa.array([int((kinds[i] == UNKNOWN).sum()) for i in ids], pa.int64()), pa.array([int((kinds[i] == BYTE).sum()) for i in ids], pa.int64()), pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array(same, pa.bool_())]
                names = ["doc_id", "n_tokens", "n_unknown", "n_fallback", "ids_crc32", "round_trip"]
                if with_ids:
                    cols.append(pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())))
                    names.append("ids")
                if with_text:
                    cols.append(pa.array(back, pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(go, schema)


def decode_documents(tokens: DataFrame, model_path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of every row of ids; null ids give a null text."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = SpmCodec(model_path)
        for b in batches:
            ids = b.column(1).to_pylist()
            text = iter(codec.decode([i for i in ids if i is not None]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if i is None else next(text) for i in ids], pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(go, "doc_id long, text string")
