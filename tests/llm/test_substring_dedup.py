import hashlib
import random

import numpy as np
import pytest

from ratioscope.llm import substring_dedup as sd
from ratioscope.llm.fm_index import FMIndex, WaveletMatrix, k_ranks


def brute(docs, w):
    first: dict = {}
    for d, t in docs:
        x = (t or "").encode().split()
        for i in range(len(x) - w + 1):
            k = tuple(x[i : i + w])
            first[k] = min(first.get(k, d), d)
    out = {}
    for d, t in docs:
        x = (t or "").encode().split()
        gone = {j for i in range(len(x) - w + 1) if first[tuple(x[i : i + w])] < d for j in range(i, i + w)}
        out[d] = (len(x), len(gone), b" ".join(v for j, v in enumerate(x) if j not in gone).decode())
    return out


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(90)]
    passages = [rng.choices(vocab, k=k) for k in (13, 20, 60, 200)]
    out = [(1, None), (2, ""), (3, "short text"), (4, " ".join(passages[0])), (500, " ".join(passages[0]))]
    for d in range(10, 130, 2):
        t = rng.choices(vocab, k=rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            t += rng.choice(passages) + rng.choices(vocab, k=rng.randint(0, 9))
        out.append((d, "\n".join(t) if d % 4 else " ".join(t)))
    out += [(200, out[20][1]), (201, out[20][1]), (7, out[20][1]), (300, "a " * 3000), (301, "a " * 40), (302, "b " * 12)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("hot", [10**9, 3])
def test_equals_brute_force(spark, docs, hot, monkeypatch):
    if hot == 3:  # treat common anchors as hot: windows are then routed one by one
        monkeypatch.setattr(sd, "max", lambda *a: 3 if a[0] == 1000 else max(*a), raising=False)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in sd.remove_repeats(df, window=13, bloom_bits=1 << 16).collect()}
    assert got == brute(docs, 13)


def test_full_bloom_filter_loses_nothing(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.kept for r in sd.remove_repeats(df, window=13, bloom_bits=64).collect()}
    assert got == {d: v[2] for d, v in brute(docs, 13).items()}


def test_nulls_repeats_extra_columns_and_empty(spark):
    t = " ".join(map(str, range(30)))
    df = spark.createDataFrame([(None, t, "x"), (4, t, "y"), (4, t, "z"), (9, t, "q")], "doc_id long, text string, kept string")
    out = sd.remove_repeats(df, carry=True)
    got = sorted((str(r.doc_id), r.n_removed, r.row.kept, r.text) for r in out.collect())
    assert got == [("4", 0, "y", t), ("4", 0, "z", t), ("9", 30, "q", ""), ("None", 0, "x", t)]
    assert sd.remove_repeats(df.limit(0)).count() == 0
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_wavelet_rank_and_fm_intervals():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 37, 999)
    m = WaveletMatrix(x.copy(), 37)
    c, p = rng.integers(0, 37, 200), rng.integers(0, 1000, 200)
    assert m.rank(c, p).tolist() == [int((x[:j] == i).sum()) for i, j in zip(c, p)]
    text = np.append(rng.integers(1, 4, 400), 0)
    k = 5
    r = k_ranks(text, k)
    key = lambda i: tuple(text[i : i + k].tolist() + [0] * max(0, i + k - len(text)))
    order = sorted(range(len(text)), key=key)
    assert [key(i) for i in np.argsort(r, kind="stable")] == [key(i) for i in order]
    index = FMIndex(text, k)
    for n in range(1, k + 1):
        for i in range(0, 395, 17):
            lo, hi = index.interval(text[i : i + n])
            assert hi - lo == sum(np.array_equal(text[j : j + n], text[i : i + n]) for j in range(len(text) - n + 1))


def test_sliding_min_and_segments_cover_all_windows():
    x = np.random.default_rng(2).integers(0, 1000, 50)
    for w in (1, 2, 3, 7, 10):
        assert sd.sliding_min(x, w).tolist() == [x[i : i + w].min() for i in range(51 - w)]
    h = np.arange(100, dtype=np.uint64)
    ends = np.array([0, 5, 60, 60, 100])
    _, at, n = sd.segments(h, ends, 13, 4)
    got = [i for a, k in zip(at, n) for i in range(a, a + k)]
    assert got == [*range(5, 48), *range(60, 88)]
