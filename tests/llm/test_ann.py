import numpy as np
import pytest

from ratioscope.llm.ann import KMeansTree, exact_scores, nearest


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(25, 16))
    x = (centers[rng.integers(0, 25, 3000)] + 0.4 * rng.normal(size=(3000, 16))).astype("float32")
    x[600:900] = x[0]  # a tenth of all rows is one vector
    return x


def brute(x, q, k):
    s = exact_scores(x[q].astype(float), x.astype(float))
    order = [i for i in np.lexsort((np.arange(len(x)), -s)) if i != q]
    return [(int(i), float(s[i])) for i in order[:k]]


def test_recall_scores_and_ties(spark, vectors):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(5)
    rows = nearest(df, df.where("vec_id % 50 = 0"), leaf_rows=200, block_rows=128).collect()
    hit = total = 0
    for q in range(0, 3000, 50):
        want = brute(vectors, q, 5)
        got = sorted((r.rank, r.vec_id, r.score) for r in rows if r.query_id == q)
        assert [g[0] for g in got] == [1, 2, 3, 4, 5]
        assert all(abs(g[2] - exact_scores(vectors[q].astype(float), vectors[[g[1]]].astype(float))[0]) < 1e-12 for g in got)
        hit += len({w[0] for w in want} & {g[1] for g in got})
        total += 5
        if q in (0, 600, 650):
            assert [g[1] for g in got] == [w[0] for w in want]
    assert hit / total >= 0.95


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (7, [1.0, 1.0]), (8, []), (None, [1.0, 2.0]), (9, [1.0, 0.0]), (10, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, rank int")
    got = [(r.query_id, r.rank, r.vec_id) for r in nearest(df, df.where("vec_id in (1, 2, 3)")).orderBy("rank").collect()]
    assert got == [(1, 1, 9), (1, 2, 7)]
    assert nearest(df.limit(0), df).count() == 0


def test_tree_assigns_every_row_and_ranks_all_leaves(vectors):
    tree = KMeansTree.fit(vectors.astype(float), 4, 100)
    leaf = tree.assign(vectors / np.linalg.norm(vectors, axis=1, keepdims=True))
    assert set(leaf) <= set(range(tree.n_leaves)) and tree.n_leaves > 10
    assert sorted(tree.best_bins(vectors[0] / np.linalg.norm(vectors[0]), 10**6)) == list(range(tree.n_leaves))


def test_repeated_ids_do_not_hide_other_ids(spark):
    rows = [(1, [1.0, 0.0])] * 8 + [(7, [1.0, 0.0]), (9, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = nearest(df, df.where("vec_id in (1, 7)"), k=2).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out) == [(1, 1, 7, 1.0), (1, 2, 9, 0.0), (7, 1, 1, 1.0), (7, 2, 1, 1.0)]


def test_recall_over_many_leaves(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 24))
    x = centres[rng.integers(0, 60, 6000)] + 0.5 * rng.normal(size=(6000, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = nearest(df, df.where("vec_id % 50 = 0"), k=5, sample_rows=2000, leaf_rows=150).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = {}
    for q in range(0, 6000, 50):
        s = u @ u[q]
        s[q] = -9
        true[q] = set(np.argsort(-s)[:5].tolist())
    found = sum(r.vec_id in true[r.query_id] for r in out)
    print("recall@5", found / 600)
    assert len(out) == 600 and found / 600 >= 0.95
