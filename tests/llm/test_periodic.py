import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from ratioscope.llm.periodic import maximal_runs, periodic_runs, with_periodic_tails
from ratioscope.llm.queries import op13_periodic_runs


def smallest_period(x):
    return next(q for q in range(1, len(x) + 1) if all(x[i] == x[i + q] for i in range(len(x) - q)))


def brute(x, least=12):
    out = set()
    for q in range(1, len(x) // 2 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q) and smallest_period(x[i : j + q]) == q:
                out.add((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def found(lists, least, levels):
    ends = np.cumsum([0, *map(len, lists)])
    s, k, q = maximal_runs(np.array([w for x in lists for w in x], np.int64), ends, min_length=least, sorted_levels=levels)
    of = np.searchsorted(ends, s, side="right") - 1
    return [[(int(a - ends[d]), int(b), int(c)) for a, b, c, o in zip(s, k, q, of) if o == d] for d in range(len(lists))]


@pytest.mark.parametrize("levels", [1, 2, 4, 9])
def test_runs_equal_brute_force(levels):
    rng = random.Random(levels)
    for _ in range(60):
        lists = []
        for _ in range(rng.randint(0, 5)):
            x = rng.choices(range(rng.choice([1, 2, 3, 50])), k=rng.choice([0, 1, 2, 7, 30, 90]))
            for _ in range(rng.randint(0, 3)):  # a power of some passage, somewhere
                root = rng.choices(range(4), k=rng.randint(1, 12))
                at = rng.randint(0, len(x))
                x = x[:at] + (root * 9)[: rng.randint(1, 6 * len(root))] + x[at:]
            lists.append(x)
        assert found(lists, 2, levels) == [brute(x, 2) for x in lists]
        assert found(lists, 12, levels) == [brute(x) for x in lists]


def test_fibonacci_word_and_long_powers():
    a, b = [0], [0, 1]
    while len(b) < 200:
        a, b = b, b + a
    power = list(range(3000)) * 3 + [7]
    assert found([b, power, [1] * 5000], 12, 4) == [brute(b), [(0, 9000, 3000)], [(0, 5000, 1)]]


def of_contract(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["a", "B", "é", "longer", "x y"]) + rng.choice(["", "", "\n", "\t"]) for _ in range(rng.randint(0, 120)))) for i in range(150)]
    rows += [(i, " ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.randint(1, 300)))) for i in range(150, 260)] + [(300, None), (301, ""), (302, " \n"), (7, "a b " * 20), (7, "a b " * 20)]
    spark.createDataFrame([(i, t, [1]) for i, t in rows], "doc_id long, text string, runs array<int>").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    out = op13_periodic_runs(spark, str(tmp_path))
    got = sorted((tuple(r) for r in out.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()), key=repr)
    assert got == sorted((of_contract(i, t) for i, t in rows), key=repr)
    assert sum(r[1] for r in got) > 15


def test_nulls_long_texts_and_empty_tables(spark):
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    df = spark.createDataFrame([(None, "a " * 30), (1, None), (2, long)], "doc_id long, text string")
    out = {r.doc_id: r for r in periodic_runs(df).collect()}
    assert [tuple(x) for x in out[None].runs] == [(0, 30, 1)] and out[None].collapsed == "a"
    assert out[1].runs == [] and out[1].collapsed == "" and out[1].n_words == 0
    assert [tuple(x) for x in out[2].runs] == [(0, 60_000, 997)]
    assert periodic_runs(df.limit(0)).count() == 0
    kept = {r.doc_id: r.text for r in with_periodic_tails(df).collect()}
    assert kept[None] == "a " * 30 and kept[1] is None
