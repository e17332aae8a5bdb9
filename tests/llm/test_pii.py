import hashlib
import random
import re

import numpy as np
import pytest

from ratioscope.llm import pii
from ratioscope.llm.bilstm_crf import Tagger, char_ids, fit, padded, spans_of
from ratioscope.llm.queries import op12_personal_data

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]  # fixed values


def plain_luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def by_pattern(t):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, t):
            d = re.sub(r"[^0-9]", "", m[0])
            if k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split(".")) or k == 2 and 14 <= len(d) <= 19 and plain_luhn(d) or k == 3 and 10 <= len(d) <= 15:
                out.append((k, m.start(), m.end()))
    return sorted(out, key=lambda x: (x[1], x[0]))


def card(rng):
    d = "".join(rng.choices("0123456789", k=15))
    return next(d + c for c in "0123456789" if plain_luhn(d + c))


def piece(rng):
    d = lambda n: "".join(rng.choices("0123456789", k=n))
    return rng.choice([f"{rng.choice(['ab', 'x.y', 'ü', ''])}{d(1)}@mail{d(1)}.example.com", ".".join(str(rng.randint(0, 280)) for _ in range(rng.randint(3, 6))), card(rng), card(rng)[:4] + " " + card(rng)[4:], f"+1 ({d(3)}) {d(3)}-{d(4)}", f"+{d(13)}", "+", "@", "a@b", ".", d(20), "-", "word", "ñandú", " ", "\n", "😀", "000000000000000000000000001.2.3.4"])


def test_rules_equal_plain_patterns():
    rng = random.Random(1)
    for _ in range(4000):
        t = rng.choice(["", " "]).join(piece(rng) for _ in range(rng.randint(0, 12)))
        assert pii.rule_spans(t) == by_pattern(t), t


def test_rules_are_linear():
    for t in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "1.1." * 100_000, "+1" * 100_000, "+1" + "(" * 200_000, "x" * 100_000 + "@host.example"):
        pii.rule_spans(t)


def test_gradients_and_viterbi():
    rng = np.random.default_rng(0)
    model = Tagger.fresh(("a", "b"), embed=3, hidden=4, seed=1)
    model.p = {k: v.astype(float) + rng.normal(size=v.shape) * 0.1 for k, v in model.p.items()}
    texts = ["ab1 c", "x", "9 9 é"]
    ids, mask = padded([char_ids(t) for t in texts])
    tags, _ = padded([np.array([0, 1, 2, 0, 3]), np.array([1]), np.array([3, 4, 0, 1, 2])])
    _, grads = model.loss(ids, mask, tags)
    for name in model.p:
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in model.p[name].shape)
            was, got = model.p[name][at], []
            for e in (1e-3, -1e-3):
                model.p[name][at] = was + e
                got.append(model.loss(ids, mask, tags)[0])
            model.p[name][at] = was
            assert abs((got[0] - got[1]) / 2e-3 - grads[name][at]) < 2e-3, name
    # the best of all paths, told by the loss of each
    scores = model.scores(ids, mask)
    best = model.best(scores[:3, 0], np.array([0, 3]))
    one, m1 = padded([char_ids(texts[0][:3])])
    scores1 = model.scores(one, m1)[:, 0]
    best = model.best(scores1, np.array([0, 3]))
    legal = [p for p in np.ndindex(5, 5, 5) if all(x not in (2, 4) or (i and p[i - 1] in (x - 1, x)) for i, x in enumerate(p))]
    assert tuple(best) == min(legal, key=lambda p: model.loss(one, m1, np.array(p)[:, None])[0])
    assert spans_of(np.array([0, 1, 2, 3, 4, 4, 1, 0, 2])) == [(0, 1, 3), (1, 3, 6), (0, 6, 7)]
    # a row's scores don't depend on its batch
    assert np.allclose(scores[:3, 0][:0], scores1[:0]) and np.allclose(model.scores(*padded([char_ids("x")]))[0, 0], scores[0, 1], atol=1e-5)


@pytest.fixture(scope="module")
def windows():
    rng = random.Random(2)
    words = lambda: " ".join("".join(rng.choices("aeiounrstlé", k=rng.randint(2, 8))) for _ in range(7))
    d = lambda n: "".join(rng.choices("0123456789", k=n))
    kinds = [lambda: f"{words()[:4].strip().replace(' ', '').replace('é', 'e')}.{d(2)}@mail{d(1)}.example.com", lambda: ".".join(str(rng.randint(1, 254)) for _ in range(4)), lambda: card(rng), lambda: f"+1 ({d(3)}) 555-{d(4)}"]
    return [(k, words() + " ", kinds[k](), " " + words()) for _ in range(150) for k in range(4)]


def test_held_out_accuracy(windows):
    model = fit(pii.KINDS, pii.training_rows(windows[:400]), rounds=12)
    rows = pii.training_rows(windows[400:], seed=9)
    found = pii.tagged_spans([t for t, _ in rows], model)
    hit = sum(len(set(w) & set(f)) for (_, w), f in zip(rows, found))
    assert hit >= 0.9 * sum(len(w) for _, w in rows) and hit >= 0.95 * sum(map(len, found))
    # one text of all rows: windows overlap, spans are the same but for their place
    text = " , ".join(t for t, _ in rows)
    whole, starts = pii.tagged_spans([text], model)[0], np.cumsum([0, *(len(t) + 3 for t, _ in rows)])
    want = {(k, s + at, e + at) for (_, w), at in zip(rows, starts.tolist()) for k, s, e in w}
    assert len(want & set(whole)) >= 0.9 * len(want)
    base, all_of = pii.find_spans([text], model)[0]
    assert set(base) <= set(all_of) and len(all_of) > len(base) > 0 and base == pii.rule_spans(text)
    assert Tagger.from_bytes(pii.KINDS, model.to_bytes()).p.keys() == model.p.keys()


def test_query_equals_rules_and_adds(spark, windows, tmp_path):
    rng = random.Random(4)
    rows = [(i, " ".join(b + s + a for _, b, s, a in rng.sample(windows, rng.randint(0, 3)))) for i in range(400)]
    rows += [(500, None), (501, ""), (None, "x a.1@b.c"), (1007, "+49 30 1234567"), (1007, "+49 30 1234567"), (502, "1" * 2_000 + " 1.2.3.4"), (503, "call (743) 555-3824 now, write to jo.12 [at] mail3 [dot] example [dot] com today")]
    spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, kind string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = op12_personal_data(spark, str(tmp_path)).collect()
    said = lambda spans: ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in spans)
    want = [(i, *(sum(x[0] == k for x in by_pattern(t or "")) for k in range(4)), hashlib.sha256(said(by_pattern(t or "")).encode()).hexdigest()) for i, t in rows]
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted(want, key=repr)
    for r in got:
        base = said(by_pattern(dict(rows)[r.doc_id] or ""))
        assert set(filter(None, base.split(","))) <= set(filter(None, r.spans.split(",")))
    assert any(r.doc_id == 503 and "email" in r.spans for r in got)
    docs = spark.createDataFrame([(1, "no data here")], "doc_id long, text string")
    assert pii.fit_tagger(docs) is None and pii.find_personal(docs, None).first().spans == [] and pii.find_personal(docs.limit(0), None).count() == 0
