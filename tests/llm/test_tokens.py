import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelweave.llm import tokens
from labelweave.llm.common import tokenizer_path

PATH = tokenizer_path(tokens.VOCABULARY)
MARK = "<|endoftext|>"


@pytest.fixture(scope="module")
def counter():
    return tokens.PrefixCounter(PATH)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def at_every_prefix(library, text):
    return [len(x.ids) for x in library.encode_batch([text[: i + 1] for i in range(len(text))], add_special_tokens=False)]


def check(counter, library, texts):
    flat, sizes = counter(texts)
    assert sizes.tolist() == [len(t) for t in texts]
    for text, own in zip(texts, np.split(flat, np.cumsum(sizes)[:-1]), strict=True):
        assert own.tolist() == at_every_prefix(library, text), repr(text)


CASES = [
    "", "a", " ", "  ", "\n", "a  b", "a \n b", "a\n\nb", "a \t", "it's", "it'll do", "we'Re", "'re", "'r", "'ve've", "''s", " 's", "!'re", "'s's'd'llx'm", "l'l", "x'le",
    f"{MARK}", f"a{MARK}b", f"a!{MARK}", f"a  {MARK}  b", f"{MARK}{MARK}", f"x{MARK[:-1]} {MARK[:7]}{MARK}<|", f"  {MARK}'re", f"it'r{MARK}",
    "x" * 300, "ab" * 700 + " c", " " * 400 + "z", "=" * 1000, "日本語テキスト 漢字", "é" * 20, "👍🏽 ok 👍", "١٢٣ 1²3", "\x1c\x1d a\x85b c　d᠎", "é́a", "\u0000�",
]


def test_cases(counter, library):
    check(counter, library, CASES)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list("aelrstvmd'  \n\t.!<|>1 ")), st.characters(codec="utf-8")), max_size=40), min_size=1, max_size=4))
def test_random_texts(counter, library, texts):
    check(counter, library, texts)


def test_words_and_specials(counter, library):
    rng = random.Random(5)
    parts = ["the", " quick", "tion", "'re", "'ll", "  ", "\n\n", " \n", MARK, MARK[:5], "I've", "1234", "!!", "ŝtono", " Straße", "supercalifragilistic", "=====", "\t\t\tx"]
    check(counter, library, ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(60)])


def test_every_token_of_the_vocabulary(counter, library):
    """Tokens in text form, each for itself and in pairs."""
    own = [t for t in (library.decode([i]) for i in range(0, 50_256, 7)) if "�" not in t and t]
    flat, sizes = counter(own)
    assert flat[np.cumsum(sizes) - 1].tolist() == [len(x.ids) for x in library.encode_batch(own, add_special_tokens=False)]
    rng = random.Random(1)
    both = ["".join(rng.choices(own, k=3)) for _ in range(5000)]
    flat, sizes = counter(both)
    assert flat[np.cumsum(sizes) - 1].tolist() == [len(x.ids) for x in library.encode_batch(both, add_special_tokens=False)]


def test_long_chunks_and_windows(counter, library, monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdetion") for _ in range(5000))
    monkeypatch.setattr(tokens, "WINDOW", 300)
    flat, _ = tokens.PrefixCounter(PATH)([text])
    for i in [*range(1, 5000, 97), 299, 300, 301, 428, 600, 5000]:
        assert flat[i - 1] == len(library.encode(text[:i], add_special_tokens=False).ids)


def test_small_memory_gives_the_same(counter):
    few, texts = tokens.PrefixCounter(PATH, cache=3), [c for c in CASES if len(c) < 100]
    for text in texts * 2:
        assert few([text])[0].tolist() == counter([text])[0].tolist()


def test_long_texts_in_parts(counter, monkeypatch):
    text = " ".join(CASES) * 3
    want = counter([text])[0].tolist()
    monkeypatch.setattr(tokens, "PART", 50)
    assert "".join(tokens.parts_of(text, 50)) == text and len(tokens.parts_of(text, 50)) > 10
    assert tokens._counted(counter, [text])[0].tolist() == want


def test_table_answers_without_encoding(spark, library):
    """Nulls, empty texts, repeated and null ids, other columns."""
    texts = ["hello hello hello hello", None, "", "supercalifragilisticexpialidocious words", f"a{MARK}b"]
    rows = [(k % 4 if k else None, t, "x") for k, t in enumerate(texts)]
    stored = tokens.prefix_table(spark.createDataFrame(rows, "doc_id bigint, text string, counts string")).cache()
    for budget in (0, 1, 3, 100):
        got = {r.n_chars: r.kept for r in stored.select("n_chars", tokens.longest_prefix(budget).alias("kept")).collect()}
        for t in texts:
            own = [len(library.encode((t or "")[:i], add_special_tokens=False).ids) for i in range(len(t or "") + 1)]
            assert got[len(t or "")] == max(i for i, c in enumerate(own) if c <= budget)
        direct = tokens.token_counts(spark.createDataFrame(rows, "doc_id bigint, text string, counts string"), limit=budget)
        assert sorted(r.kept_chars for r in direct.collect()) == sorted(len(t or "") and got[len(t or "")] for t in texts)
    for n in (0, 5, 1000):
        got = {r.n_chars: r.c for r in stored.select("n_chars", tokens.tokens_of_prefix(n).alias("c")).collect()}
        assert all(got[len(t or "")] == len(library.encode((t or "")[:n], add_special_tokens=False).ids) for t in texts)
    assert sorted(str(r.doc_id) for r in stored.collect()) == sorted(str(k % 4 if k else None) for k in range(5))
    assert tokens.prefix_table(stored.select("doc_id", F.lit("").alias("text")).where("false")).count() == 0


def test_query_against_the_library(spark, small, library):
    got = {r.doc_id: r for r in tokens.op11_token_counts(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        n = len(library.encode(d.text or "", add_special_tokens=False).ids)
        r = got[d.doc_id]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((d.text or "").encode()), n, n > 1024)
        assert len(library.encode((d.text or "")[: r.kept_chars], add_special_tokens=False).ids) <= 1024
