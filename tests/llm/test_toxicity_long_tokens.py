import pyarrow as pa

from labelweave.llm import toxicity as T


def fitted():
    bad = ["scum", "idiot", "idiot scum", "scum idiot"] * 30
    texts = [f"a w{k} {b} and so on v{k}" for k, b in enumerate(bad)] + [f"w{k} a fine day v{k}" for k in range(200)]
    return T.fit(texts, [1] * len(bad) + [0] * 200)


def test_toxic_words_beyond_200_characters_of_a_text_without_blanks(spark):
    tagger = fitted()
    texts = ["fine,day," * k + "scum,idiot" + ",day" * k for k in (23, 3000)] + ["x" * 300 + "/scum_idiot", "日本語、" * 100 + "idiot。", " ok " + "fine/day/" * 500 + "\nscum idiot ", "fine,day," * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {x.doc_id: x for x in T.score(docs, tagger).collect()}
    assert [found[k].predicted for k in range(6)] == [1, 1, 1, 1, 1, 0]
    assert all("idiot" in "".join(texts[k][s.start : s.end] for s in found[k].spans) for k in range(5))
    assert all("fine" not in texts[k][s.start : s.end] for k in range(5) for s in found[k].spans)
    assert [x.doc_id for x in T.drop_toxic(docs, tagger).collect()] == [5]


def test_scoring_and_training_cut_alike():
    tagger = T.fit([], [])
    for text in ["a " + "b,c;" * 100 + " d", "," * 500, "x" * 500 + ",", " " + "_a-" * 90 + "z "]:
        own = [text[a:b] for a, b in T.tokens(text)]
        assert "".join(own) == "".join(text.split())
        assert tagger.marginals(pa.array([text, "one two", text]))[1].tolist() == [len(own), 2, len(own)]
        assert T.Corpus([text]).lengths.tolist() == [len(own)]


def test_training_sees_words_beyond_200_characters():
    toxic = ["fine,day," * 30 + f"w{k},vile,v{k}" for k in range(100)]
    corpus = T.Corpus(toxic + ["fine,day," * 30] * 100)
    assert T.weak_labels(corpus, (T.np.arange(200) < 100).astype(float)).sum() >= 100
