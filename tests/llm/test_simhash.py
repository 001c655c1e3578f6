import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from labelweave.llm import simhash
from labelweave.llm.common import Scratch
from labelweave.llm.components import components
from labelweave.llm.simhash import FINE, WIDE, drop_near_duplicates, fingerprint, links, near_duplicates, op9_simhash


def plain_fingerprint(text, words=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    tokens, now = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            tokens += [now] if now else []
            now = ""
        else:
            now += c
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i : i + words]) for i in range(len(tokens) - words + 1)] or [" ".join(tokens)]
    hs = [xxhash.xxh64(s.encode(), 42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(fps):
    """{fp: smallest fp reachable} over all pairs."""
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def test_fingerprint():
    for text in [None, "", "  \n", "One", "one TWO", "a b c", "É é x \x0b y\x1cz w", "the cat sat on the mat " * 50]:
        assert fingerprint((text or "").encode())[0] & (2**64 - 1) == plain_fingerprint(text), text


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 200), (7, 3), (None, 5)]
    found = {x.node: x.component for x in components(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark)).collect()}
    assert found == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100)}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), Scratch(spark)).count() == 0


def families(seed=1):
    rng, fps = random.Random(seed), set()
    for _ in range(60):
        base = rng.getrandbits(64)
        fps.add(base)
        for _ in range(rng.randint(0, 30)):
            x = base
            for b in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << b
            fps.add(x)
            base = rng.choice([base, x])
    base = rng.getrandbits(64)
    return sorted({x - 2**64 if x >> 63 else x for x in fps | {base ^ rng.getrandbits(9) for _ in range(400)}})


def test_links_span_all_pairs_with_any_block(spark):
    fps = families()
    want = plain_components(fps)
    reps = spark.createDataFrame([(f,) for f in fps], "f0 bigint")
    for block in (5, 50, 10_000):
        edges = [(x.a0, x.b0) for x in links(reps, FINE, Scratch(spark), block=block).collect()]
        assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 3 or want[a] == want[b] for a, b in edges)
        found = {x.node: x.component for x in components(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark)).collect()}
        assert {f: found.get(f, f) for f in fps} == want


def test_nulls_copies_and_clashing_columns(spark):
    rows = [(3, "a b c d"), (2, "A b  C d"), (None, "a b c d"), (9, None), (8, ""), (8, ""), (None, "quite alone here")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, fp int, component_id int")
    found = sorted(((x.doc_id, x.component_id) for x in near_duplicates(docs).collect()), key=str)
    assert found == sorted([(3, 2), (2, 2), (None, 2), (9, 8), (8, 8), (8, 8), (None, None)], key=str)
    assert near_duplicates(docs.limit(0)).count() == 0


def test_query(spark, small):
    found = op9_simhash(spark, small).toPandas()
    docs = spark.read.parquet(f"{small}/documents.parquet").toPandas()
    fps = {x.doc_id: plain_fingerprint(x.text) for x in docs.itertuples()}
    assert {x.doc_id: x.fingerprint for x in found.itertuples()} == {k: f"{v:016x}" for k, v in fps.items()}
    root = plain_components(sorted(set(fps.values())))
    least = {}
    for k, v in fps.items():
        least[root[v]] = min(k, least.get(root[v], k))
    assert {x.doc_id: x.component_id for x in found.itertuples()} == {k: least[root[v]] for k, v in fps.items()}
    assert np.unique(found.component_id).size < len(found)


def plain_similar(texts, least=0.8):
    """{id: smallest id of the group that pairs with a Jaccard similarity of `least` on five-word shingles connect}, over all pairs."""
    sets = {}
    for i, t in texts.items():
        w = [x.lower() for x in (t or "").split()]
        sets[i] = {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids, root = sorted(texts), {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if min(len(a), len(b)) >= least * max(len(a), len(b)) and (not (a | b) or len(a & b) >= least * len(a | b)):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def edited(rng, words, share):
    return " ".join(f"new{rng.randrange(10**6)}" if rng.random() < share else w for w in words)


def test_wide_scale_finds_similar_texts_and_leaves_others(spark):
    rng = random.Random(3)
    texts, near = {}, {}
    for k in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(150, 400))]
        texts[10 * k] = " ".join(words)
        texts[10 * k + 1] = texts[10 * k].upper()
        texts[10 * k + 2] = near[10 * k + 2] = edited(rng, words, 0.01)
        texts[10 * k + 3] = edited(rng, words, 0.2)  # no near duplicate
    group = plain_similar(texts)
    df = spark.createDataFrame([(t, i, 7) for i, t in texts.items()], "text string, doc_id bigint, component int").repartition(6)
    found = drop_near_duplicates(df)
    assert found.columns == df.columns
    kept = {x.doc_id for x in found.collect()}
    assert all(i in kept for i in texts if group[i] == i)  # none but near duplicates go
    assert not any(10 * k + 1 in kept for k in range(60))  # all copies go
    gone = [i for i in near if group[i] != i]
    assert len(gone) > 40 and sum(i not in kept for i in gone) >= 0.9 * len(gone)


def test_wide_scale_nulls_versions_and_repeats(spark):
    a = "one two three four five six seven"
    rows = [(1, a), (1, a), (1, "another text under the same id as the first row"), (None, a), (None, "no id at all but words enough"), (None, "no id at all but words enough"), (2, None), (3, ""), (4, "one two"), (5, "one two")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, version int")
    found = drop_near_duplicates(docs).select("doc_id", "text").collect()
    assert sorted(map(tuple, found), key=str) == sorted([(1, a), (1, rows[2][1]), (None, rows[4][1]), (2, None), (4, "one two")], key=str)
    assert drop_near_duplicates(docs.limit(0)).count() == 0


def test_wide_scale_on_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {x.doc_id: x.text for x in docs.collect()}
    group = plain_similar(texts)
    kept = {x.doc_id for x in drop_near_duplicates(docs).collect()}
    want = {i for i in texts if group[i] != i}
    assert {i for i in texts if group[i] == i} <= kept
    assert len(want - kept) >= 0.9 * len(want) > 0
    assert fingerprint(b"", WIDE) == [0, 0]


def with_similarity(rng, words, least, most):
    """Words of which single ones are replaced until the five-word shingles' similarity is between least and most; None if it falls below."""
    a, out = shingle_set(words), list(words)
    for at in rng.sample(range(len(words)), len(words)):
        out[at] = f"new{rng.randrange(10**9)}"
        b = shingle_set(out)
        s = len(a & b) / len(a | b)
        if s <= most:
            return (" ".join(out), s) if s >= least else (None, s)
    return None, 0.0


def shingle_set(words):
    return {" ".join(words[k : k + 5]) for k in range(len(words) - 4)}


def test_recall_by_band_of_similarity(spark):
    rng, rows, band = random.Random(12), [], {}
    for least, most in ((0.8, 0.82), (0.82, 0.85), (0.85, 0.9), (0.9, 0.99), (0.7, 0.79)):
        n = 0
        while n < 150:
            words = [f"w{rng.randrange(50_000)}" for _ in range(rng.randint(100, 500))]
            text, _ = with_similarity(rng, words, least, most)
            if text:
                k = 2 * len(band)
                rows += [(k, " ".join(words)), (k + 1, text)]
                band[k + 1], n = least, n + 1
    kept = {r.doc_id for r in drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)).collect()}
    assert all(k - 1 in kept for k in band)
    recall = {b: sum(k not in kept for k in band if band[k] == b) / 150 for b in sorted(set(band.values()))}
    print(recall)
    assert recall[0.7] == 0 and all(recall[b] >= 0.9 for b in recall if b != 0.7), recall


@pytest.mark.parametrize("block", [2048, 2])
def test_a_link_that_fails_does_not_hide_another(spark, monkeypatch, block):
    """Three fingerprints in a row, of which the outer two are near duplicates and the middle one is none of either."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(200)]
    far, (near, s) = [f"v{k}" for k in range(200)], with_similarity(rng, words, 0.85, 0.95)
    texts = {1: " ".join(words), 2: " ".join(far), 3: near, 4: " ".join(far) + " end"}
    prints = {1: (0, 0), 2: (0b1111111111, 0), 3: (0b111111111111, 0), 4: (0b1111111111 | 1 << 40, 0)}
    signed = spark.createDataFrame([(i, *f) for i, f in prints.items()], "id bigint, f0 bigint, f1 bigint")
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    made = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("version")).join(signed, "id")
    monkeypatch.setattr(simhash, "fingerprints", lambda *a, **k: made)
    plain_blocks = simhash.in_blocks
    monkeypatch.setattr(simhash, "in_blocks", lambda *a, **k: plain_blocks(*a, **k | {"block": block}))
    assert sorted(r.doc_id for r in drop_near_duplicates(docs).collect()) == [1, 2]
