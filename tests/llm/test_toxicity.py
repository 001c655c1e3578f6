import zlib

import numpy as np
import pyarrow as pa

from labelweave.llm import toxicity as T


def plain_marginals(u, lengths, transition, start):
    """Forward-backward token by token."""
    out, pairs, at = [], np.zeros((2, 2)), 0
    for n in lengths:
        x, at = u[at : at + n], at + n
        if not n:
            continue
        a, b, t = np.zeros((n, 2)), np.ones((n, 2)), np.exp(transition)
        a[0] = [1, np.exp(start + x[0])]
        for k in range(1, n):
            a[k] = (a[k - 1] @ t) * [1, np.exp(x[k])]
            a[k] /= a[k].sum()
        for k in range(n - 2, -1, -1):
            b[k] = t @ (b[k + 1] * [1, np.exp(x[k + 1])])
            b[k] /= b[k].sum()
        m = a * b
        out += list(m[:, 1] / m.sum(axis=1))
        for k in range(n - 1):
            z = a[k][:, None] * t * (b[k + 1] * [1, np.exp(x[k + 1])])[None]
            pairs += z / z.sum()
    return np.array(out), pairs


def test_forward_backward_equals_the_plain_recursion():
    rng = np.random.default_rng(3)
    for lengths in ([3, 0, 1, 130, 64, 65, 128], [0, 0], [1], [2000]):
        lengths = np.array(lengths)
        u, transition = rng.normal(size=lengths.sum()) * 2, rng.normal(size=(2, 2))
        p, pairs = T.forward_backward(u, lengths, transition, -0.7)
        want, want_pairs = plain_marginals(u, lengths, transition, -0.7)
        assert np.allclose(p, want) and np.allclose(pairs, want_pairs)


def test_held_out_accuracy_and_whole_texts(spark):
    d = "/root/testdata/sf0.01"
    found = T.op7_toxicity(spark, d).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{d}/documents.parquet").toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{d}/labels.parquet").toPandas()
    assert len(found) == len(docs)
    assert all(x == (zlib.crc32(str(i).encode()) % 5 == 0) for i, x in found.held_out.items())
    assert ((found.score >= 0.5) == (found.predicted == 1)).all() and found.score.between(0, 1).all()
    out = labels[[zlib.crc32(str(i).encode()) % 5 == 0 for i in labels.doc_id]]
    assert (found.predicted[out.doc_id].to_numpy() == out.toxic.to_numpy()).mean() > 0.97
    for i, x in found[found.predicted == 1].head(20).iterrows():
        assert all(0 <= s["start"] < s["end"] <= len(docs.text[i]) for s in x.spans)


def test_edge_cases(spark):
    bad = ["scum", "idiot", "idiot scum", "scum idiot"] * 30
    texts = [f"a w{k} {b} and so on v{k}" for k, b in enumerate(bad)] + [f"w{k} a fine day v{k}" for k in range(200)]
    tagger = T.fit(texts, [1] * len(bad) + [0] * 200)
    deep = "fine day " * 40_000 + "scum idiot"
    rows = [(1, None), (2, ""), (3, " \n\x1c"), (None, "you scum"), (5, deep), (5, deep), (6, "a fine day"), (7, "ünïcode 日本 idiot!")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, score string, predicted int")
    found = T.score(docs, tagger).collect()
    assert [x.predicted for x in found] == [0, 0, 0, 1, 1, 1, 0, 1]
    assert deep[found[4].spans[-1].start :] == "scum idiot" and found[4].score == found[5].score
    assert rows[7][1][found[7].spans[0].start : found[7].spans[0].end] == "idiot!"
    kept = T.drop_toxic(docs, tagger)
    assert kept.columns == docs.columns and [x.doc_id for x in kept.collect()] == [1, 2, 3, 6]
    assert T.score(docs.limit(0), tagger).count() == 0 and T.drop_toxic(docs.limit(0), tagger).count() == 0


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id bigint, text string")
    for labels in ([], [(1, None, None)], [(1, 1, 1)], [(None, 0, 1), (99, 1, 1)]):
        tagger = T.train(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
        assert [x.predicted for x in T.score(docs, tagger).collect()] == [0, 0]


def test_copies_do_not_make_words_toxic():
    texts = ["alpha beta gamma"] * 100 + [f"delta{k} eps" for k in range(100)]
    assert not T.weak_labels(T.Corpus(texts), np.array([1.0] * 100 + [0.0] * 100)).any()
    spread = [f"a{k} vile b{k}" for k in range(100)] + texts[100:]
    assert T.weak_labels(T.Corpus(spread), np.array([1.0] * 100 + [0.0] * 100)).sum() == 100


def test_tokens_of_arrow_and_of_the_pattern_agree():
    tagger = T.fit([], [])
    for text in ["", " ", "a", " a  b\n", "x\x1cy z w​v", " é　ü"]:
        assert tagger.marginals(pa.array([text]))[1].tolist() == [len(T.CHUNK.findall(text))]
