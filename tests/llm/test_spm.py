import struct

import pytest

from ratioscope.llm.spm import BPE, PROBES, UNIGRAM, SpmCodec, SpmModel, decode_documents, encode_documents, verify

P = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
PATH = P.path("piece_bpe_32k.model")


def varint(x):
    out = b""
    while x > 127:
        out, x = out + bytes([x & 127 | 128]), x >> 7
    return out + bytes([x])


def msg(n, data):
    return varint(n << 3 | 2) + varint(len(data)) + data


def num(n, x):
    return varint(n << 3) + varint(x)


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """A small model written by hand: scores, byte fallback, blank stripping."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    pieces += [(p, s, 1) for p, s in (("▁", -3.0), ("▁he", -2.5), ("he", -3.5), ("llo", -3.0), ("▁hello", -4.0), ("l", -5.0), ("o", -5.0), ("h", -6.0), ("e", -6.0), ("▁w", -4.5), ("or", -3.9), ("ld", -3.8), ("r", -7.0), ("d", -7.0), ("w", -7.0))]
    body = b"".join(msg(1, msg(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s) + num(3, k)) for p, s, k in pieces)
    body += msg(2, num(3, UNIGRAM) + num(35, 1)) + msg(3, msg(1, b"identity") + num(3, 1) + num(4, 1) + num(5, 1))
    path = tmp_path_factory.mktemp("m") / "u.model"
    path.write_bytes(body)
    return str(path)


def test_parity_of_both_kinds(unigram):
    assert SpmModel.load(PATH).model_type == BPE and SpmModel.load(unigram).model_type == UNIGRAM
    more = ["hello world", "  hello   world  ", "hello\nworld", "wörld é", "lllll ooo", "▁hello ▁▁ x", "helloworld " * 50]
    for path in (PATH, unigram):
        assert verify(SpmCodec(path, limit=20), path, [*PROBES, *more]) == []


def test_documents_round_trip(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = [(1, "Hello world"), (2, None), (3, ""), (None, "东京 tower"), (4, " odd  blanks "), (4, "long " * 20_000)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, ids long").repartition(2)
    out = encode_documents(df, PATH)
    rows = sorted(((str(r.doc_id), r.n_tokens, r.ids, r.decoded, r.round_trip) for r in out.collect()), key=str)
    want = sorted(((str(i), len(sp.encode(t or "")), sp.encode(t or ""), sp.decode(sp.encode(t or "")), True) for i, t in docs), key=str)
    assert rows == want
    back = {(str(r.doc_id), r.text) for r in decode_documents(out, PATH).collect()}
    assert back == {(str(i), t or "") for i, t in docs}
    assert encode_documents(df.limit(0), PATH).count() == 0
