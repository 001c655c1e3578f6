import zlib

import numpy as np

import corpus_pipeline
from labelweave.llm import secrets, toxicity
from tests.llm.test_lines import plain as plain_lines
from tests.llm.test_packing import ids_of
from tests.llm.test_secrets import plain as plain_secrets
from tests.llm.test_secrets import redacted
from tests.llm.test_simhash import plain_similar


def columns_kept(spark, stage, docs, sf_dir):
    found = stage(spark, docs, sf_dir)
    assert found.columns == docs.columns and found.dtypes == docs.dtypes
    return found


def test_run_equals_the_stages_one_by_one(spark):
    """A brute-force version of every stage; the classifier's decisions are taken over, and those on near duplicates are checked against all pairs."""
    small = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{small}/documents.parquet")
    tagger = toxicity.train(docs, spark.read.parquet(f"{small}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.score(docs, tagger).collect() if r.predicted}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id not in bad}
    assert 0 < len(bad) < docs.count()
    had = {i for i, t in texts.items() if (t or "").strip()}
    texts = {i: t for i, t in plain_lines(texts).items() if i not in had or t.strip()}
    third = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    stay = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, third, small).collect()}
    group = plain_similar(texts)
    assert {i for i in texts if group[i] == i} <= stay
    assert sum(group[i] != i for i in stay) <= 2  # near duplicates that the fingerprints miss
    texts = {i: texts[i] for i in stay}
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    found = {r.doc_id: [tuple(s) for s in r.spans] for r in secrets.scan(frame).collect()}
    clean = {}
    for i, t in texts.items():
        assert [s for s in found[i] if s[1] < 3] == plain_secrets(t)
        clean[i] = redacted(t, found[i])
    got = corpus_pipeline.run(spark, small).toPandas()
    assert set(got.doc_id) == set(clean) and got.sequence_id.is_unique
    for i, t in clean.items():
        ids, own = np.array(ids_of(t), "<u4"), got[got.doc_id == i].sort_values("start")
        assert own.length.sum() == len(ids)
        assert [zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in own.itertuples()] == own.ids_crc32.tolist()


def test_stages_keep_columns_and_bear_anything(spark, small):
    rows = [(1, "a clean text of many words\nsecond line of it is here", "en", "s", 5), (1, "a clean text of many words\nsecond line of it is here", "en", "s", 5), (2, None, None, None, None), (None, "no id here", None, "s", 1), (None, "no id here", None, "s", 1), (3, "", "en", "s", 0), (4, "token = abcdefghijklmnop", "en", "s", 3), (5, "word " * 100_000, "de", "s", 9)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, spans int"
    docs = spark.createDataFrame([(*r, 1) for r in rows], schema)
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            frame = columns_kept(spark, stage, frame, small)
        corpus_pipeline.STAGES[-1][1](spark, frame, small).collect()
    near = corpus_pipeline.drop_near_duplicates(spark, docs, small).collect()
    assert sorted(r.doc_id or 0 for r in near) == [0, 1, 2, 4, 5], near
    redacted = {r.doc_id: r for r in corpus_pipeline.redact_secrets(spark, docs, small).collect()}
    assert redacted[4].text == "[REDACTED]" and redacted[4].n_chars == 10 and redacted[2].text is None
