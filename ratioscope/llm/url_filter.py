"""URL filtering with a bit-parallel wildcard automaton.

All glob rules are packed into one multiword Shift-And automaton that is run over every canonical URL
(``host + path``, host lower-cased) of an Arrow batch at once: a column of bytes is one step for all URLs.

Glob syntax: ``*`` any characters but ``/``; ``**`` any characters; everything else stands for itself.  A rule must
match the whole canonical URL.  ``HostRule`` is compiled into globs too: the host and all its subdomains, any path with
the given start.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "page_id long, host string, path string, rule string, verdict string, glob string"
_U = np.uint64


@dataclass(frozen=True)
class HostRule:
    """``text`` like ``example.net/en/``; the longest that fits a URL decides before any glob."""

    text: str
    verdict: str

    def globs(self) -> list[str]:
        host, _, path = self.text.partition("/")
        return [f"{host}/{path}**", f"*.{host}/{path}**"]


class ShiftAnd:
    """Patterns over bytes, packed one after another; a bit is one matched prefix of one pattern.

    ``step[c]``: bits that byte c leads into.  ``stay[c]``: bits under a wildcard that byte c keeps alive.
    """

    def __init__(self, globs: list[str]):
        starts, ends, bits = [], [], []
        step, stay, carry = [], [], []  # by bit: byte it needs (-1: the empty prefix), kept bytes, may follow bit - 1
        for g in globs:
            starts.append(len(step))
            step.append(-1)
            stay.append("")
            carry.append(False)
            raw, i = g.encode(), 0
            while i < len(raw):
                if raw[i : i + 2] == b"**":
                    stay[-1], i = "all", i + 2
                elif raw[i : i + 1] == b"*":
                    stay[-1], i = stay[-1] or "segment", i + 1
                else:
                    step.append(raw[i])
                    stay.append("")
                    carry.append(True)
                    i += 1
            ends.append(len(step) - 1)
        bits = len(step)
        self.words = max(1, -(-bits // 64))
        self.n = len(globs)
        self.step = np.zeros((256, self.words), _U)
        self.stay = np.zeros((256, self.words), _U)
        self.start = np.zeros(self.words, _U)
        self.ends = [(e // 64, _U(1) << _U(e % 64)) for e in ends]
        for i in range(bits):
            w, b = i // 64, _U(1) << _U(i % 64)
            if step[i] >= 0:
                self.step[step[i], w] |= b
            if stay[i]:
                keep = np.ones(256, bool)
                if stay[i] == "segment":
                    keep[ord("/")] = False
                self.stay[keep, w] |= b
        for s in starts:
            self.start[s // 64] |= _U(1) << _U(s % 64)

    def match(self, urls: list[bytes]) -> np.ndarray:
        """Boolean matrix: url by pattern.  URLs are taken longest first, so each step works on those not yet ended."""
        sizes = np.fromiter((len(u) for u in urls), np.int64, len(urls))
        order = np.argsort(-sizes, kind="stable")
        at = np.concatenate([[0], np.cumsum(sizes)])[:-1][order]
        flat, left = np.frombuffer(b"".join(urls), np.uint8), sizes[order]
        state = np.tile(self.start, (len(urls), 1))
        alive = len(urls)
        for k in range(int(left[0]) if len(urls) else 0):
            while alive and left[alive - 1] <= k:
                alive -= 1
            c = flat[at[:alive] + k]
            s = state[:alive]
            moved = s << _U(1)
            if self.words > 1:
                moved[:, 1:] |= s[:, :-1] >> _U(63)
            state[:alive] = (moved & self.step[c]) | (s & self.stay[c])
        out = np.zeros((len(urls), self.n), bool)
        for p, (w, b) in enumerate(self.ends):
            out[order, p] = (state[:, w] & b) != 0
        return out


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    if url is None or (i := url.find("://")) < 0:
        return "", ""
    rest = url[i + 3 :]
    cut = min((j for c in "?#" if (j := rest.find(c)) >= 0), default=len(rest))
    rest = rest[:cut]
    j = rest.find("/")
    host, path = (rest, "") if j < 0 else (rest[:j], rest[j:])
    return host.translate(_LOWER), path


_LOWER = {c: c + 32 for c in range(65, 91)}


def judge(urls: list[str | None], rules: list[HostRule], globs: list[str], auto: ShiftAnd) -> list[tuple]:
    """(host, path, rule, verdict, glob) of each URL; ``auto`` holds the rules' globs, then ``globs``."""
    parts = [split_url(u) for u in urls]
    hit = auto.match([(h + p).encode("utf-8", "surrogatepass") for h, p in parts])
    by_rule = np.stack([hit[:, 2 * i] | hit[:, 2 * i + 1] for i in range(len(rules))], 1) if rules else np.zeros((len(urls), 0), bool)
    rank = sorted(range(len(rules)), key=lambda i: (-len(rules[i].text), rules[i].text))
    out = []
    for (host, path), r, g in zip(parts, by_rule, hit[:, 2 * len(rules) :]):
        rule = next((rules[i] for i in rank if r[i]), None)
        glob = globs[int(np.argmax(g))] if g.any() else None
        out.append((host, path, rule and rule.text, rule.verdict if rule else "block" if glob else "allow", glob))
    return out


def filter_urls(pages: DataFrame, rules: list[HostRule], globs: list[str], *, id_col: str = "page_id", url_col: str = "url", run: int = 4096) -> DataFrame:
    """Verdict on every URL: page_id, host, path, rule, verdict, glob (the first block glob that matches, else null).

    A null URL, or one without ``://``, has empty host and path: no rule fits it.  Repeated rows are judged each, an
    empty table gives no rows, columns of other names are not read.  One pass without shuffle; the automaton's size
    follows the rules, not the data, and it travels in the task's closure.
    """
    every = [g for r in rules for g in r.globs()] + list(globs)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = ShiftAnd(every)
        for batch in batches:
            for i in range(0, batch.num_rows, run):
                part = batch.slice(i, run)
                rows = judge(part.column(1).to_pylist(), rules, list(globs), auto)
                cols = list(zip(*rows)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.string()) for c in cols)], names=["page_id", "host", "path", "rule", "verdict", "glob"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url")).mapInArrow(go, SCHEMA)
