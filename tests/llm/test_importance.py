import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from ratioscope.llm.importance import resample, run_crcs


def brute(docs, target, n, buckets, percent, min_words, seed):
    def features(t):
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    of = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for *_, f in of for b in f), Counter(b for x in target for b in features(x)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for i, w, f in of:
        weight = sum(map(gain, f))
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, w, len(f), weight, score, None])
    drawn = sorted((r for r in rows if r[1] >= min_words and r[4] is not None), key=lambda r: (-r[4], r[0]))
    for k, r in enumerate(drawn[: percent * len(drawn) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("n", [1, 2, 4])
def test_ring_gives_every_run_its_crc(n):
    rng = random.Random(n)
    for size in (0, 1, 2, 3, 30):
        words = [bytes(rng.choices(b"ab\xc3\xa9", k=rng.randint(1, 5))) for _ in range(size)]
        want = [zlib.crc32(b" ".join(words[i : j + 1])) for j in range(size) for i in range(max(0, j - n + 1), j + 1)]
        assert run_crcs(words, n) == want


@pytest.mark.parametrize("n,buckets", [(1, 100), (3, 70_000)])
def test_equals_brute_force(spark, n, buckets):
    rng = random.Random(3)
    text = lambda k: " ".join(rng.choice(["Alpha", "beta", "gámma", "δ9", "x-y", "Zeta_eta", "42", "\x00", "!!"]) for _ in range(k))
    docs = [(i, text(rng.randint(0, 60))) for i in range(80)] + [(90, None), (91, ""), (None, text(40)), (7, text(30)), (92, "word " * 20_000), (93, "a\x7fb c İI")]
    target = [text(50) for _ in range(5)] + [None, ""]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, rank string").repartition(5)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    out = resample(df, goal, n=n, buckets=buckets, percent=15, min_words=20, seed=9)
    got = sorted((tuple(r) for r in out.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=repr)
    assert got == brute(docs, target, n, buckets, 15, 20, 9)


def test_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "one two three " * 10)] * 40 + [(2, "four five six " * 10)] * 20, "doc_id long, text string").repartition(3)
    goal = spark.createDataFrame([("one two",)], "text string")
    got = resample(docs, goal, percent=50)
    assert sorted(r.rank for r in got.where("rank is not null").collect()) == list(range(1, 31)) and got.count() == 60
    assert resample(docs.limit(0), goal).count() == 0
    assert {r.weight for r in resample(docs, goal.limit(0)).collect()} != {0}
