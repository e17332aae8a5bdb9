import random
import re

import numpy as np
import pytest

from ratioscope.llm.quality import QualityModel, apply_quality, features, fit_quality, keep_quality, measure


def base(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(hit), failed]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(6)
    good = lambda: " ".join("".join(rng.choices("aeiourstln", k=rng.randint(2, 8))) for _ in range(rng.randint(25, 120))) + "."
    bad = lambda: " ".join("".join(rng.choices("XQZJK", k=rng.randint(2, 8))) + rng.choice(["!!", "$$$", "***"]) for _ in range(rng.randint(25, 120)))
    return [good() for _ in range(150)], [bad() for _ in range(150)]


def test_counts_equal_brute_force(texts):
    some = [None, "", " \n\t", "one", "a b c d e f g h " * 4, "x\nx\n \nx y\nx y", "é ü # | <b> &", "w " * 9, *texts[0][:20], *texts[1][:20], "\n".join(texts[0][:3] * 2), " ".join(texts[0][:60] * 2)]
    m = measure(some, None)
    got = [[int(m[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [bool(m["base_failed"][i])] for i in range(len(some))]
    assert got == [base(t) for t in some]


def test_held_out_accuracy_and_calibration(spark, texts):
    good, bad = texts
    rows = [(i, t, 1) for i, t in enumerate(good)] + [(1000 + i, t, 0) for i, t in enumerate(bad)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(None, "no id", "x"), (5000, None, "x")], "doc_id long, text string, kept string").repartition(3)
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i % 3], "doc_id long, quality int")
    model = fit_quality(docs, labels)
    out = {r.doc_id: r for r in apply_quality(docs, model).collect()}
    held = [(out[i].probability, q) for i, _, q in rows if i % 3 == 0]
    assert np.mean([(p >= 0.5) == bool(q) for p, q in held]) > 0.97
    assert not out[5000].kept and out[5000].base_failed
    assert keep_quality(docs, model).count() == sum(r.kept for r in out.values()) and keep_quality(docs, model).columns == docs.columns
    assert apply_quality(docs.limit(0), model).count() == 0


def test_scores_are_features_times_weights(texts):
    from ratioscope.llm.quality import N_CELLS
    from ratioscope.llm.words import hash_words, split_run

    rng = np.random.default_rng(0)
    model = QualityModel(rng.normal(size=N_CELLS), 0.3)
    some = [None, "a", "ab c", *texts[0][:5]]
    idx, val = features(some)
    flat, ends = split_run(some)
    want = [0.3 + float(v @ model.weights[i]) for i, v in zip(idx, val)]
    assert np.allclose(model.scores(some, hash_words(flat), ends), want)


def test_one_class_or_none_passes_all(spark, texts):
    docs = spark.createDataFrame([(1, texts[0][0])], "doc_id long, text string")
    for labels in ([(1, 1)], [(9, 0), (None, 1)]):
        model = fit_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert model.weights is None and apply_quality(docs, model).first().kept
