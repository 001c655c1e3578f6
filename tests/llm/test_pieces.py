import random
import struct

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from labelweave.llm.common import tokenizer_path
from labelweave.llm.pieces import Encoder, Model, decode, decode_ids, encode, op1_sentencepiece

PATH = tokenizer_path("piece_bpe_32k.model")
TEXTS = ["", " ", "  ", "   a", "a  b ", "\na\t b\n\n", "é 日本語 😀x", "▁a", "a▁ b", "<s>hi</s>", "<unk> <0x41>", "\x00a", "a​b", "ﬁ", "x" * 900, " " * 50 + "a" + " " * 31, "The quick brown fox. " * 20, "internationalization,\nthe-2nd (3.14159)", "ѐ ⁇ a", "1234567890" * 5]


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, value):
    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3) + varint(value)


def unigram():
    """A model file with hand-made pieces."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    words = {"▁": -2.0, "▁▁": -3.5, "▁the": -1.5, "▁th": -3.0, "e": -2.5, "a": -3.0, "b": -3.25, "ab": -4.0, "aba": -5.5, "ba": -5.0, "▁a": -2.75, "c": -6.0, "é": -7.0, "abab": -9.0}
    pieces += [(w, s, 1) for w, s in words.items()]
    data = b"".join(field(1, field(1, t.encode()) + field(2, s) + field(3, k)) for t, s, k in pieces)
    return data + field(2, field(3, 1) + field(4, len(pieces))) + field(3, field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, "rb") as f:
        return Encoder(Model(f.read()))


def check(encoder, library, texts):
    flat, counts = encoder(pa.array(texts))
    for text, ids in zip(texts, np.split(flat, np.cumsum(counts)[:-1]), strict=True):
        want = library.encode(text)
        assert ids.tolist() == want, repr(text[:80])
        assert decode_ids(encoder.model, ids.astype(np.int64)) == library.decode(want)


def test_bpe_equals_the_library(encoder, library):
    check(encoder, library, TEXTS)
    rng = random.Random(6)
    alphabet = "aaaabceinorst   \nTé"
    check(encoder, library, ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(3000)])


def test_bpe_on_corpus_words(encoder, library, spark, small):
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    check(encoder, library, texts)
    again, counts = encoder(pa.array(texts[::-1]))  # from memory now
    assert counts.sum() == len(again) == sum(len(library.encode(t)) for t in texts)


def test_unigram_equals_the_library():
    data = unigram()
    library, encoder = sentencepiece.SentencePieceProcessor(model_proto=data), Encoder(Model(data))
    rng = random.Random(9)
    texts = ["", " ", "the", " the  a", "zz a zq", "ababab"] + ["".join(rng.choice("abceth  éz") for _ in range(rng.randint(1, 30))) for _ in range(2000)]
    flat, counts = encoder(pa.array(texts))
    for text, ids in zip(texts, np.split(flat, np.cumsum(counts)[:-1]), strict=True):
        assert ids.tolist() == library.encode(text), text


def test_decoding_any_ids(encoder, library):
    rng = random.Random(3)
    for ids in [[], [0], [1, 264, 2], [131, 203, 5], [259, 264], [28705]] + [[rng.choice([rng.randrange(32000), rng.randrange(3, 259)]) for _ in range(12)] for _ in range(500)]:
        assert decode_ids(encoder.model, np.array(ids, np.int64)) == library.decode(ids), ids
    with pytest.raises(ValueError):
        decode_ids(encoder.model, np.array([40_000]))


def test_query_and_edge_cases(spark, small, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in op1_sentencepiece(spark, small).collect():
        assert r.n_ids == len(library.encode(docs[r.doc_id]))
    rows = [(1, None), (None, "a b"), (3, ""), (4, "x " * 50_000), (5, "a b"), (5, "a b")]
    df = spark.createDataFrame([(*r, b"z", 3) for r in rows], "doc_id bigint, text string, ids binary, n_ids int")
    found = decode(encode(df)).collect()
    assert [r.text for r in found] == ["" if t is None else t for _, t in rows] and [r.doc_id for r in found] == [r[0] for r in rows]
    assert encode(df.limit(0)).count() == 0
