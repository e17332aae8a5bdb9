import random

import pytest

from ratioscope.llm.ngram_join import jaccard_components, prefix_length, shingle_sets, marked


def brute(docs, n=3, percent=90):
    def shingles(t):
        low = (t or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
        return {tuple(low)} if 0 < len(low) < n else {tuple(low[i : i + n]) for i in range(len(low) - n + 1)}

    sets = {d: shingles(t) for d, t in docs}
    comp = {d: d for d, _ in docs}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                ra, rb = root(a), root(b)
                comp[max(ra, rb)] = min(ra, rb)
    return {d: (len(sets[d]), root(d)) for d in sets}


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    out = [(1, ""), (2, None), (3, "one"), (4, "ONE"), (5, "one two"), (6, "Ä b"), (7, "ä b"), (8, " \t\n")]
    k = 10
    for g in range(12):
        base = rng.choices(vocab, k=rng.randint(5, 220))
        for _ in range(rng.choice([1, 2, 6, 9])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            out.append((k, " ".join(t) if g % 2 else "\n".join(t).upper()))
            k += 3
    long_ = [f"v{rng.randrange(5000)}" for _ in range(4000)]
    for j in range(6):  # large sets, near and not quite near
        t = list(long_)
        for _ in range(40 * j):
            t[rng.randrange(len(t))] = rng.choice(vocab)
        out.append((800 + j, " ".join(t)))
    out.append((999, "long " * 30_000 + " ".join(vocab)))
    return out


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (1, 100)])
def test_components_equal_brute_force(spark, docs, n, percent):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df, n=n, percent=percent).collect()}
    assert got == brute(docs, n, percent)


def test_chain_through_members_that_miss_the_leader(spark):
    # a ~ b ~ c, but a and c are too far apart: one component through b
    w = [f"x{i}" for i in range(100)]
    near = lambda k: " ".join(w[k:] + [f"y{i}" for i in range(k)])
    docs = [(30, near(0)), (20, near(4)), (10, near(8))]
    assert brute(docs)[30][1] == 10
    got = {r.doc_id: r.component_id for r in jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {30: 10, 20: 10, 10: 10}


def test_null_ids_repeats_extra_columns_and_empty(spark):
    rows = [(None, "a b c d", 1), (5, "a b c d", 2), (5, "a b c d", 3), (6, "a b c d", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df).collect()), key=str)
    assert got == [(5, 2, 5), (5, 2, 5), (6, 2, 5), (None, 2, None)]
    assert jaccard_components(df.limit(0)).count() == 0


def test_prefix_always_meets():
    for size in range(1, 200):
        need = -(-90 * size // 100)
        assert prefix_length(size, 90) == size - need + 1
    assert [len(x) for x in shingle_sets(["a b", "A B", None], 3)] == [1, 1, 0]


def test_marked_rows_hold_every_wanted_one_and_few_others(spark):
    rows = spark.range(-5_000, 15_000).selectExpr("id as doc_id", "'t' as text").unionByName(spark.sql("select cast(null as long) as doc_id, 't' as text"))
    ids = spark.range(-5_000, 15_000, 37).selectExpr("id as doc_id")
    want = {r.doc_id for r in ids.collect()}
    got = [r.doc_id for r in marked(rows, ids).collect()]
    assert want <= set(got)
    assert len(got) <= len(want) + 50
    assert marked(rows, ids.limit(0)).count() == 0
