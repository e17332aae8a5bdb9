"""Vectorized text primitives shared by the Arrow operators.

Texts arrive in Arrow batches; ``pieces`` cuts a batch into runs of a few megabytes so that memory follows one run (or
one text, if a single text is longer) and never the batch.  Words are ``[^\\x20\\x09-\\x0D]+``, which is what
``bytes.split()`` gives on UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN_BYTES = 2 << 20
U64 = np.uint64
_GOLD = U64(0x9E3779B97F4A7C15)
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def carried(docs: DataFrame, text_col: str) -> Column:
    """The struct ``row`` of all columns but the text, whatever their names."""
    return F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in docs.columns if c != text_col)).alias("row")


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finalizer: every output bit depends on every input bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= _M1
    x ^= x >> U64(27)
    x *= _M2
    x ^= x >> U64(31)
    return x


def pieces(texts: list, limit: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of a batch whose texts hold about ``limit`` characters."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def hash_words(words: list) -> np.ndarray:
    """64-bit keyed hashes of words (bytes), equal in every process."""
    if not words:
        return np.empty(0, U64)
    a = np.empty(len(words), dtype=object)
    a[:] = words
    return pd.util.hash_array(a, categorize=False)


def split_run(texts: list, lower: bool = False) -> tuple[list, np.ndarray]:
    """Words of a run of texts (None: none) and the offsets of each text's words."""
    flat: list = []
    ends = np.zeros(len(texts) + 1, np.int64)
    for i, t in enumerate(texts):
        if t:
            b = t.encode("utf-8", "surrogatepass")
            flat += (b.lower() if lower else b).split()  # bytes.lower() touches A-Z only
        ends[i + 1] = len(flat)
    return flat, ends


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position; the last n-1 positions of the input have none."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, U64)
    out = np.zeros(m, U64)
    with np.errstate(over="ignore"):
        for j in range(n):
            out = out * _GOLD + (h[j : j + m] ^ (out >> U64(29)))
    return mix(out)


def spans(ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For texts with word offsets ``ends``: first window position and number of n-word windows of each."""
    return ends[:-1], np.maximum(np.diff(ends) - n + 1, 0)


def window_mask(ends: np.ndarray, n: int) -> np.ndarray:
    """True where a window of n words starts and stays within its text."""
    total = int(ends[-1])
    m = max(total - n + 1, 0)
    flag = np.zeros(total + 1, np.int32)
    s, k = spans(ends, n)
    np.add.at(flag, s[k > 0], 1)
    np.add.at(flag, (s + k)[k > 0], -1)
    return np.cumsum(flag)[:m] > 0
