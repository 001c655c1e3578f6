import duckdb
import numpy as np
import pytest

from labelweave.llm import ann, forest
from labelweave.llm.registry import ORACLE_SQL
from labelweave.llm.vectors import unit

SCHEMA = "vec_id bigint, embedding array<float>, score double, node int"


def odd_rows():
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [0.95, 0.05, 0.0]), (4, None), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 0.0]), (7, [nan, 1.0, 0.0])]
    rows += [(8, [inf, 0.0, 0.0]), (None, [1.0, 0.0, 0.0]), (9, [1.0, 0.0]), (10, []), (50, [1.0, 0.0, 0.0]), (11, [0.0, 1.0, 0.0]), (100, [-1.0, 0.0, 1e-3]), (12, [0.0, 1e30, 1e30])]
    return [(*r, 0.5, 1) for r in rows]


def table_of(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").toPandas()
    return rows.vec_id.to_numpy(), np.stack(rows.embedding).astype(float)


def plain_nearest(ids, x, queries, k=5):
    u = unit(x)
    out = {}
    for q in queries:
        i = int(np.flatnonzero(ids == q)[0])
        s = u @ u[i]
        out[int(q)] = [int(ids[j]) for j in sorted(range(len(ids)), key=lambda j: (-s[j], ids[j])) if ids[j] != q][:k]
    return out


def test_nearest_recall_and_scores(spark, small):
    ids, x = table_of(spark, small)
    found = ann.op3_nearest(spark, small).toPandas()
    want = plain_nearest(ids, x, ids[ids % 50 == 0])
    hits = sum(len(set(found.vec_id[found.query_id == q]) & set(w)) for q, w in want.items())
    assert set(found.query_id) == set(want) and hits >= 0.9 * 5 * len(want)
    place = {v: i for i, v in enumerate(ids)}
    for r in found.itertuples():
        a, b = x[place[r.query_id]], x[place[r.vec_id]]
        assert r.score == pytest.approx(a @ b / np.sqrt((a @ a) * (b @ b)), abs=1e-12)


def test_tree_visits_reach_the_recall_on_structured_vectors(spark):
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(40, 16))[rng.integers(0, 40, 3000)] + 0.3 * rng.normal(size=(3000, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    for leaf, block in ((60, 2048), (60, 40), (5000, 500)):
        found = ann.nearest(df, df.where("vec_id % 50 = 0"), leaf=leaf, block=block).toPandas()
        want = plain_nearest(np.arange(3000), x.astype(float), range(0, 3000, 50))
        hits = sum(len(set(found.vec_id[found.query_id == q]) & set(w)) for q, w in want.items())
        assert hits >= 0.9 * 300 and (found.groupby("query_id").size() == 5).all()
    tree = ann.grow(unit(x.astype(float)), 50)
    assert ann.calibrate(tree, unit(x.astype(float)), 5, 0.95) < 25


def test_nearest_edge_cases(spark):
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    found = {}
    for r in ann.nearest(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert found[50][:3] == [1, 2, 3] and set(found[50][3:]) == {11, 12} and set(found) == {50, 100}
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0
    mixed = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (50, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [1.0, 0.0])], "vec_id bigint, embedding array<float>")
    got = [(r.query_id, r.rank, r.vec_id) for r in ann.nearest(mixed, mixed.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 3), (0, 2, 1), (50, 1, 2)]
    copies = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(200)], "vec_id bigint, embedding array<float>")
    got = ann.nearest(copies, copies.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 3, 4, 5] + [0, 1, 2, 3, 4] * 3


def plain_links(ids, x, threshold=0.9):
    s = unit(x) @ unit(x).T >= threshold
    np.fill_diagonal(s, False)
    root = ids.copy()
    while True:
        new = np.minimum(root, np.where(s, root[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (new == root).all():
            return {int(i): (int(n), int(r)) for i, n, r in zip(ids, s.sum(axis=1), root, strict=True)}
        root = new


def test_forest_finds_all_links(spark, small):
    ids, x = table_of(spark, small)
    found = {r.vec_id: (r.n_links, r.component_id) for r in forest.op4_forest(spark, small).collect()}
    assert found == plain_links(ids, x)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{small}/embeddings.parquet'")
    assert found == {r[0]: (r[1], r[2]) for r in con.execute(ORACLE_SQL["op4_forest"]).fetchall()}


def test_forest_with_spill_and_blocks(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(400, 32))
    x = np.concatenate([base, base[:200] + 0.25 * rng.normal(size=(200, 32)), base[7] + 0.2 * rng.normal(size=(300, 32)), base[:20], base[:20] * 3]).astype(np.float32)
    ids = rng.permutation(len(x)).astype(np.int64)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id bigint, embedding array<float>").repartition(3)
    want = plain_links(ids, x.astype(float))
    for leaf, block in ((40, 2048), (40, 30)):
        found = {r.vec_id: (r.n_links, r.component_id) for r in forest.near_duplicates(df, leaf=leaf, block=block, trees=8, spill=1.2).collect()}
        assert found == want


def test_forest_edge_cases(spark):
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    found = sorted(((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in forest.near_duplicates(df).collect()), key=str)
    assert (0, 0, None, True) in found and (50, 4, 1, False) in found and (1, 4, 1, True) in found
    mixed = spark.createDataFrame([(5, [1.0, 0.0]), (6, [1.0, 0.1]), (7, [1.0, 0.0, 0.0]), (8, [1.0, 0.0, 0.1]), (9, [0.0, 0.0, 1.0])], "vec_id bigint, embedding array<float>")
    assert {r.vec_id: (r.n_links, r.component_id) for r in forest.near_duplicates(mixed).collect()} == {5: (1, 5), 6: (1, 5), 7: (1, 7), 8: (1, 7), 9: (0, 9)}
    assert [x for x in found if x[0] in (4, 5, 6, 7, 8, 9, 10)] == sorted([(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10)], key=str)
    assert len(found) == len(odd_rows()) and forest.near_duplicates(df.limit(0)).count() == 0
