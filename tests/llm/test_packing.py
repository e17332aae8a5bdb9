import random
import zlib

import numpy as np
import pytest

from tokenizers import Tokenizer

from ratioscope.llm.packing import WordCachedEncoder, pack_documents, pack_lengths, powers

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


def test_encoder_equals_the_library():
    enc, plain = WordCachedEncoder(PATH), Tokenizer.from_file(PATH)
    texts = ["hello <|endoftext|> there", "a<|endoftext|>b  c", "words, with. marks! and: more; so? End.", "don't rock'starr x,y ..., a\u00d7b \u00e9\u00d7,", " ", "Hello world", "two  blanks", " lead", "trail ", "line\nbreak\n\nand more", "tab\there", "it's they're", "naïve Ünï 東京 😀", "a\u00a0b", "x" * 300, "<|endoftext|> stays text", "12345 6,789.0 %%% ###", "a\u2028b", "Ǆ ǆ ʰ"]
    rng = random.Random(1)
    texts += [" ".join("".join(rng.choices("abcéß,.!?'\n0", k=rng.randint(1, 9))) for _ in range(40)) for _ in range(60)]
    for limit in (10**6, 50):
        enc.limit = limit
        for t, raw in zip(texts, enc.encode(texts)):
            assert np.frombuffer(raw, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, t
    assert enc.model is not None


def test_pack_lengths_is_full_and_balanced():
    rng = random.Random(2)
    for n, top in ((0, 9), (1, 5), (40, 30), (300, 700), (50, 5000)):
        lengths = [rng.randint(0, top) for _ in range(n)]
        seqs = pack_lengths(lengths, 512)
        assert [sum(k for *_, k in s) for s in seqs[:-1]] == [512] * max(0, len(seqs) - 1)
        got = {}
        for s in seqs:
            for d, a, k in s:
                got.setdefault(d, []).append((a, k))
        for d, k in enumerate(lengths):
            at = 0
            for a, m in sorted(got.get(d, [])):
                assert a == at and m > 0
                at += m
            assert at == k
    assert powers(2047) == [1 << b for b in range(10, -1, -1)] and powers(0) == []


def test_documents_round_trip(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choices(["alpha", "beta,", "Gamma.", "東京"], k=rng.choice([0, 3, 50, 900, 4000])))) for i in range(60)] + [(None, "no id"), (100, None), (100, ""), (7, "again")]
    df = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, length long").repartition(3)
    rows = pack_documents(df, PATH, block_tokens=20_000).collect()
    plain = Tokenizer.from_file(PATH)
    ids = [(i, [*plain.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in docs]
    full = {(i, len(x), zlib.crc32(np.asarray(x, "<u4").tobytes())): x for i, x in ids}
    for r in rows:  # the CRC of every piece, cut ones too
        assert any(i == r.doc_id and n == r.doc_tokens and zlib.crc32(np.asarray(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for (i, n, _), x in full.items())
    assert sum(r.length < r.doc_tokens for r in rows) > 10
    sizes = {}
    for r in rows:
        sizes.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sizes.values():
        at = 0
        for o, k in sorted(s):
            assert o == at
            at += k
        assert at & (at - 1) == 0 and at <= 2048  # no padding at all
    assert sum(r.length for r in rows) == sum(len(x) for _, x in ids)
    assert pack_documents(df.limit(0), PATH).count() == 0


def test_room_beyond_many_cheaper_sequences():
    from ratioscope.llm.packing import pack_lengths

    lengths = [85, *[45] * 140, 12, *[1] * 703]  # 70 cheaper sequences have room for 10, only the dearest one for 12
    out = pack_lengths(lengths, 100, 1.0, 1.0)
    assert [(d, s, k) for seq in out for d, s, k in seq if d == 141] == [(141, 0, 12)]
    assert len(out) == 71 and all(sum(k for *_, k in seq) == 100 for seq in out)
