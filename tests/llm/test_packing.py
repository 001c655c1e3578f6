import zlib

import numpy as np
import pytest

from labelweave.llm.common import tokenizer_path
from labelweave.llm.packing import op10_packing, pack, piece_lengths

SCHEMA = "doc_id bigint, text string, length int, ids string"


def ids_of(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")).encode(text or "", add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("n", [1, 2, 3, 4095, 4096, 4097, 12345])
def test_lengths_are_powers_of_two_that_add_up(n):
    found = piece_lengths(n, 4096)
    assert sum(found) == n and all(x & (x - 1) == 0 and x <= 4096 for x in found)
    assert found == sorted(found, reverse=True)


def test_pieces_rebuild_every_text(spark):
    texts = [None, "", " \n ", "Hello, WORLD 42! it's", "a<|endoftext|>b c", "x\x1cy\x1f z", "é é ΣΑΣ İ ﬁ 日本語     q", "w" * 300, "ab " * 9000, "Hello, WORLD 42! it's"]
    rows = [(k % 9 or None, t, 7, "clash") for k, t in enumerate(texts)]
    found = pack(spark.createDataFrame(rows, SCHEMA).repartition(1)).collect()
    assert len({x.sequence_id for x in found}) == len(found)
    want = sorted(ids_of(t) for t in texts)
    whole, now = [], None
    for x in found:  # one partition: pieces of a row follow one another
        ids = np.frombuffer(x.ids, "<u4").tolist()
        assert len(ids) == x.length and x.offset == 0 and 1 << x.bucket == x.length
        if x.start == 0:
            whole.append(now := [])
        assert len(now) == x.start
        now += ids
    assert sorted(whole) == want


def test_empty_table_and_small_max_length(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert pack(empty).count() == 0
    rows = pack(spark.createDataFrame([(1, "a b c d e f g", 0, "")], SCHEMA), max_length=4).collect()
    assert [x.length for x in rows] == [4, 4] and rows[0].doc_tokens == 8
    with pytest.raises(ValueError):
        pack(empty, max_length=12)


def test_query(spark, small):
    found = op10_packing(spark, small).toPandas()
    docs = spark.read.parquet(f"{small}/documents.parquet").toPandas()
    for x in docs.itertuples():
        ids = np.array(ids_of(x.text), "<u4")
        own = found[found.doc_id == x.doc_id].sort_values("start")
        assert own.length.sum() == len(ids) == own.doc_tokens.iloc[0]
        assert [zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in own.itertuples()] == own.ids_crc32.tolist()


def test_memory_does_not_change_ids():
    import random

    import pyarrow as pa

    from labelweave.llm.packing import CachedEncoder

    rng = random.Random(3)
    texts = [" ".join(rng.choice(["alpha", "beta", f"w{rng.randrange(4000)}x", "it's", "ÜBER"]) for _ in range(60)) for _ in range(300)]
    small, large = CachedEncoder(tokenizer_path("word_bpe_49k.json"), cache=150), CachedEncoder(tokenizer_path("word_bpe_49k.json"))
    for at in range(0, 300, 10):
        a, b = small(pa.array(texts[at : at + 10])), large(pa.array(texts[at : at + 10]))
        assert (a[0] == b[0]).all() and (a[1] == b[1]).all()
    assert len(small.known) < len(large.known)


def test_a_word_is_encoded_once_whatever_marks_and_case_it_has():
    import pyarrow as pa

    from labelweave.llm.packing import CachedEncoder

    names = [f"{a}{b}é" for a in ("thon", "inwh", "ertion", "Über") for b in ("Ly", "ble", "heit", "ing")]
    texts = [f"{x}{m} ({x.upper()}{m}'s" for x in names for m in ("", ",", ".", "!!", "###", "***", ".***")]
    encode = CachedEncoder(tokenizer_path("word_bpe_49k.json"))
    flat, counts = encode(pa.array(texts))
    want = [x.ids for x in encode.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(x) for x in want] and flat.tolist() == [i for x in want for i in x]
    assert len(encode.known) <= len(names) + 20


@pytest.mark.parametrize("cache", [1, 1000])
def test_odd_words_have_the_ids_of_the_whole_text(cache):
    import random

    import pyarrow as pa

    from labelweave.llm.packing import CachedEncoder

    rng, encode = random.Random(5), CachedEncoder(tokenizer_path("word_bpe_49k.json"), cache=cache)
    parts = [*"aShtJW''' \t\n\x0c\x00\x1c\x1f<|>.,!_07éÉß×÷Ÿº²¼\x85\xa0\xad", "́", "̱", "̌", "İ", "ſ", "Σ", "日", "ﬁ", "٣", "　", "\U0001d400", "<|endoftext|>", "<|ENDOFTEXT|>", "'re", "'RE", "'ll", "'VE", "'S", "</w>"]
    for _ in range(30):
        some = rng.sample(parts, rng.choice([4, 12, len(parts)]))
        texts = ["".join(rng.choices(some, k=rng.choice([0, 1, 2, 5, 30]))) for _ in range(60)]
        flat, counts = encode(pa.array(["'", *texts, "s"]).slice(1, 60))
        want = [x.ids for x in encode.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert counts.tolist() == [len(x) for x in want] and flat.tolist() == [i for x in want for i in x]


def test_vocabulary_that_cuts_otherwise_gets_whole_chunks(tmp_path):
    import json

    import pyarrow as pa

    from labelweave.llm.packing import CachedEncoder

    form = json.loads(open(tokenizer_path("word_bpe_49k.json")).read())
    form["normalizer"], form["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = None, r"\S+"
    (path := tmp_path / "other.json").write_text(json.dumps(form))
    from tokenizers import Tokenizer

    texts = ["It's HIGH time, isn't it? 42!", "\x1ca \x00 b\x00c", "", "w" * 100 + " x."]
    flat, counts = CachedEncoder(str(path))(pa.array(texts))
    want = [Tokenizer.from_file(str(path)).encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(x) for x in want] and flat.tolist() == [i for x in want for i in x]
