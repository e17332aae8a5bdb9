"""Personal data: fixed rules, and a character BiLSTM-CRF for spellings that the rules miss.

The rules are linear scans over whole texts.  The tagger is trained on a bounded sample of labelled spans: those that the rules find in
the table, some of them respelled (``name [at] host dot com``, phones without a plus, cards and addresses with other separators),
in their own surroundings.  A span of the tagger holds a digit, an ``@`` or a spelled ``at`` or ``dot``; stretches of text around
such signs are covered by overlapping windows, whose tag scores are blended, those of a window's middle weighing most, and one
Viterbi pass over each stretch decodes all its windows together.  What it finds is kept if it has the form of its kind (digits,
Luhn, parts of an address) and overlaps no span of the rules.

Null and empty texts have no spans.  Rows are judged each, whatever their ids; other columns are not read.  Texts are never cut; a task
holds one batch.  A table without any span of the rules trains no tagger: then the rules alone decide.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .bilstm_crf import Tagger, char_ids, fit, padded, spans_of
from .words import pieces

KINDS = ("email", "ip", "card", "phone")
_HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: What a span of the tagger holds at least; text further than ``REACH`` from any of these isn't read by it.
_SIGN = re.compile(r"[0-9@]|[(\[{]\s?(?:at|dot)\s?[)\]}]|\sdot\s", re.IGNORECASE)
REACH, WINDOW, STRIDE = 48, 128, 64
_AT = re.compile(r"\s*(?:[(\[{]\s?(?:at|@)\s?[)\]}]|@)\s*|\s+at\s+", re.IGNORECASE)
_DOT = re.compile(r"\s*[(\[{]\s?(?:dot|\.)\s?[)\]}]\s*|\s+(?:dot|\.)\s+", re.IGNORECASE)


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _is_ip(parts: list[str]) -> bool:
    return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)


def _is_card(digits: str) -> bool:
    return 14 <= len(digits) <= 19 and luhn(digits)


def rule_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) by start, then kind; leftmost and not overlapping within a kind."""
    out, end = [], 0
    for m in _HOST.finditer(text):  # a name reaches back from its @ to what isn't of names, or to the match before
        s = m.start()
        while s > end and text[s - 1] in _LOCAL:
            s -= 1
        if s < m.start():
            end = m.end()
            out.append((0, s, end))
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if _is_ip(m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and _is_card(re.sub("[^0-9]", "", m[0])):
            out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((3, m.start(), m.end()))
    return sorted(out, key=lambda x: (x[1], x[0]))


def has_form(kind: int, span: str) -> bool:
    """Whether a respelled span is one of its kind."""
    if kind == 0:
        plain = _DOT.sub(".", _AT.sub("@", span))
        return plain.count("@") == 1 and [(0, len(plain))] == [(s, e) for k, s, e in rule_spans(plain) if k == 0]
    if kind == 1:
        return _is_ip(re.split(r"[^0-9]+", _DOT.sub(".", span))) and len(re.findall(r"\.", _DOT.sub(".", span))) == 3
    digits = re.sub("[^0-9]", "", span)
    if kind == 2:
        return re.fullmatch(r"[0-9](?:[\x20._/-]{0,2}[0-9])+", span) is not None and _is_card(digits)
    return re.fullmatch(r"[+(]?[0-9](?:[\x20()./-]{0,3}[0-9])+", span) is not None and len(digits) < len(span) and 10 <= len(digits) <= 15


def respell(kind: int, span: str, rng: random.Random) -> str:
    """A spelling of the same thing; often the rules' own."""
    if rng.random() < 0.35:
        return span
    if kind == 0:
        name, _, host = span.partition("@")
        at = rng.choice([" at ", " (at) ", " [at] ", "(at)", "[at]", " @ ", "@"])
        dot = rng.choice([" dot ", " [dot] ", "[dot]", "(dot)", " (dot) ", "."])
        return name + at + host.replace(".", dot)
    if kind == 1:
        return span.replace(".", rng.choice(["[.]", " . ", "(.)", " dot ", "[dot]"]))
    digits = re.sub("[^0-9]", "", span)
    if kind == 2:
        sep = rng.choice([".", "/", "_", "  ", " - ", "."])[:2]
        return sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    a, b, c = digits[:-7], digits[-7:-4], digits[-4:]
    land, area = a[:-3], a[-3:]
    sep = rng.choice([" ", ".", "-", "/"])
    return rng.choice([f"({area}) {b}-{c}", f"{area}{sep}{b}{sep}{c}", f"{land}{sep}{area}{sep}{b}{sep}{c}", f"00{land} {area} {b} {c}", f"{area} / {b}{c}"])


def _unlike(rng: random.Random) -> str:
    """Numbers and signs that are no personal data."""
    d = lambda n: "".join(rng.choices("0123456789", k=n))
    return rng.choice([f"{rng.randint(1900, 2100)}-{d(2)}-{d(2)}", f"{rng.randint(0, 23):02d}:{d(2)}:{d(2)}", f"{d(1)}.{d(2)}", f"v{d(1)}.{d(1)}.{d(2)}", f"${d(3)},{d(3)}.{d(2)}", "".join(rng.choices("0123456789abcdef", k=rng.choice([18, 32, 40]))), "AKIA" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=16)), d(4), d(2) + "%", f"{d(2)}/{d(2)}/{d(4)}", f"@{rng.choice(['home', 'noon', 'first'])}", f"look at {d(2)} dot {d(1)}", f"{d(3)}-{d(5)}", f"{d(1)}.", f"{d(2)}.{d(2)}.{d(4)}"])


def training_rows(windows: list[tuple[int, str, str, str]], seed: int = 0) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Texts with labelled spans from (kind, before, span, after): the span respelled, and something that is none beside it."""
    rng = random.Random(seed)
    out = []
    for kind, before, span, after in windows:
        text = respell(kind, span, rng)
        head = before[len(before) - rng.randint(0, len(before)) :]
        if rng.random() < 0.5:
            head = _unlike(rng) + " " + head
        tail = after[: rng.randint(0, len(after))]
        out.append((head + text + tail, [(kind, len(head), len(head) + len(text))] if has_form(kind, text) else []))
        odd = _unlike(rng)
        out.append((before[-30:] + odd + after[:30], []))
    return out


def labelled_windows(docs: DataFrame, *, per_kind: int, text_col: str = "text", around: int = 40) -> DataFrame:
    """kind, before, span, after: at most ``per_kind`` different ones of each kind, those of least hash.  A task hands over as many
    of its own at most."""

    def least(rows: set) -> set:
        ranked = sorted(rows)
        return {r for k in range(len(KINDS)) for r in [x for x in ranked if x[1] == k][:per_kind]}

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: set = set()
        for b in batches:
            for t in b.column(0).to_pylist():
                found = rule_spans(t)
                for i, (k, s, e) in enumerate(found):
                    if e - s <= 64:
                        lo, hi = max([0, s - around, *(x[2] for x in found[max(0, i - 9) : i] if x[2] <= s)]), min([len(t), e + around, *(x[1] for x in found[i + 1 : i + 10] if x[1] >= e)])
                        own = (k, t[lo:s], t[s:e], t[e:hi])
                        rows.add((int.from_bytes(blake2b(repr(own).encode("utf-8", "surrogatepass"), digest_size=7).digest()), *own))
                if len(rows) > 16 * per_kind:
                    rows = least(rows)
        kept = sorted(least(rows))
        names = ["h", "kind", "before", "span", "after"]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in kept], kind) for c, kind in enumerate((pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()))], names=names)

    text = F.col(text_col).cast("string").alias("text")
    found = docs.select(text).where(F.col("text").rlike("[0-9@]")).mapInArrow(go, "h long, kind int, before string, span string, after string")
    found = Scratch(docs.sparkSession, "labelled").write(found.distinct(), "windows")
    some = [found.where(F.col("kind") == k).orderBy("h", "before", "span", "after").limit(per_kind) for k in range(len(KINDS))]
    return some[0].unionByName(some[1]).unionByName(some[2]).unionByName(some[3]).drop("h")


def fit_tagger(docs: DataFrame, *, per_kind: int = 250, rounds: int = 12, text_col: str = "text") -> Tagger | None:
    """The tagger, fitted in one task on at most ``2 * 4 * per_kind`` short rows; the driver gets its weights.  None without spans."""

    def train(t: pa.Table) -> pa.Table:
        rows = sorted(zip(*(t[c].to_pylist() for c in ("kind", "before", "span", "after"))))
        return pa.table({"model": pa.array([fit(KINDS, training_rows(rows), rounds=rounds).to_bytes()], pa.binary())})

    got = labelled_windows(docs, per_kind=per_kind, text_col=text_col).groupBy(F.lit(0).alias("all")).applyInArrow(train, "model binary").first()
    return None if got is None else Tagger.from_bytes(KINDS, got.model)


def _stretches(text: str) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for m in _SIGN.finditer(text):
        lo, hi = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def tagged_spans(texts: list[str | None], model: Tagger) -> list[list[tuple[int, int, int]]]:
    """What the tagger finds in each text, of the right form."""
    parts, windows, offset = [], [], 0
    for i, t in enumerate(texts):
        for lo, hi in _stretches(t) if t else []:
            parts.append((i, lo, hi))
            ids = char_ids(t[lo:hi])
            for s in range(0, max(1, len(ids) - WINDOW + STRIDE), STRIDE):
                windows.append((offset + s, ids[s : s + WINDOW]))
            offset += len(ids)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not parts:
        return out
    blended, weight = np.zeros((offset, 2 * len(KINDS) + 1)), np.zeros(offset)
    windows.sort(key=lambda w: len(w[1]))
    for lo in range(0, len(windows), 256):
        ids, mask = padded([w for _, w in windows[lo : lo + 256]])
        scores = model.scores(ids, mask)
        for k, (at, w) in enumerate(windows[lo : lo + 256]):
            n = len(w)
            middle = np.minimum(np.arange(n), np.arange(n)[::-1]) + 1.0
            blended[at : at + n] += scores[:n, k] * middle[:, None]
            weight[at : at + n] += middle
    ends = np.concatenate([[0], np.cumsum([hi - lo for _, lo, hi in parts])])
    tags = model.best(blended / weight[:, None], ends)
    for (i, lo, _), a, b in zip(parts, ends, ends[1:]):
        for k, s, e in spans_of(tags[a:b]):
            s, e = lo + s, lo + e
            while s < e and not (texts[i][s].isalnum() or texts[i][s] in "+("):
                s += 1
            while e > s and not texts[i][e - 1].isalnum():
                e -= 1
            if k == 0 and (m := _AT.search(texts[i], s, e)):  # a name is one word
                s = max(s, *(texts[i].rfind(c, s, m.start()) + 1 for c in " \t\n\r"))
            if s < e and has_form(k, texts[i][s:e]):
                out[i].append((k, s, e))
    return out


def find_spans(texts: list[str | None], model: Tagger | None) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Of each text the rules' spans, and all spans; both by start, then kind."""
    base = [rule_spans(t) if t else [] for t in texts]
    more = tagged_spans(texts, model) if model else [[] for _ in texts]
    out = []
    for own, new in zip(base, more):
        free = []
        if new:
            edges = sorted((s, e) for _, s, e in own)
            starts, top = [s for s, _ in edges], list(np.maximum.accumulate([e for _, e in edges])) if edges else []
            for k, s, e in new:
                i = np.searchsorted(starts, e)  # spans of the rules that start before this one ends
                if i == 0 or top[i - 1] <= s:
                    free.append((k, s, e))
        out.append((own, sorted(own + free, key=lambda x: (x[1], x[0])) if free else own))
    return out


SPANS = "array<struct<kind:string,start:long,end:long>>"


def find_personal(docs: DataFrame, model: Tagger | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans (kind, start, end in code points, end exclusive): the rules' spans, and these with the tagger's."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def column(rows: list) -> pa.Array:
        flat = [x for r in rows for x in r]
        fields = [pa.array([KINDS[k] for k, _, _ in flat], pa.string()), pa.array([s for _, s, _ in flat], pa.int64()), pa.array([e for _, _, e in flat], pa.int64())]
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rows])]), pa.int32()), pa.StructArray.from_arrays(fields, ["kind", "start", "end"]))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in pieces(texts):
                found = find_spans(texts[lo:hi], shared.value)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), column([x[0] for x in found]), column([x[1] for x in found])], names=["doc_id", "base", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(go, f"doc_id long, base {SPANS}, spans {SPANS}")
