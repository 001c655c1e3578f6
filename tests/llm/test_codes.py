import hashlib
import math

import duckdb
import numpy as np
import pytest

from labelweave.llm import codes
from labelweave.llm.registry import ORACLE_SQL
from tests.llm.test_vectors import odd_rows

SCHEMA = "vec_id bigint, embedding array<float>, label int, code int"


def plain(ids, x, labels, parts=4, entries=256, rounds=4):
    """By definition, one vector after the other, in Python's integers."""
    rows = [[int(np.floor(1024 * float(c))) for c in v] for v in x]
    w = len(rows[0]) // parts
    cut = [[r[p * w : (p + 1) * w] for r in rows] for p in range(parts)]
    first = sorted(range(len(ids)), key=lambda i: ids[i])[:entries]
    books = [[cut[p][i] for i in first] for p in range(parts)]
    far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b, strict=True))
    assign = lambda p: [min(range(len(books[p])), key=lambda e: (far(v, books[p][e]), e)) for v in cut[p]]
    for _ in range(rounds):
        for p in range(parts):
            own = assign(p)
            for e in range(len(books[p])):
                if members := [cut[p][i] for i, a in enumerate(own) if a == e]:
                    books[p][e] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    found = [assign(p) for p in range(parts)]
    error = [sum(far(cut[p][i], books[p][found[p][i]]) for p in range(parts)) for i in range(len(rows))]
    by = {}
    for e, y in zip(error, labels, strict=True):
        by[y] = by.get(y, 0) + e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((i, "".join(f"{found[p][k]:02x}" for p in range(parts)), error[k], by[labels[k]], digest) for k, i in enumerate(ids))


def got(df):
    return sorted((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


def test_query_against_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{small}/embeddings.parquet'")
    df = codes.op12_vector_codes(spark, small)
    want = sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE_SQL['op12_vector_codes']})").fetchall())
    assert got(df) == want and len(want) == 500


@pytest.mark.parametrize("salted", [False, True])
def test_against_definition(spark, monkeypatch, salted):
    """Ties, copies, one label for many rows, null labels, entries without parts; with labels sent to all and with salts."""
    rng = np.random.default_rng(3)
    x = rng.integers(-3, 4, (150, 8)).astype(np.float32) / 1024 * rng.choice([1, 700], (150, 1)).astype(np.float32)
    x[40:70] = x[3]
    ids, labels = rng.permutation(150), [None if k % 7 == 0 else 1 if k % 3 else k for k in range(150)]
    df = spark.createDataFrame([(int(i), v.tolist(), y, 0) for i, v, y in zip(ids, x, labels, strict=True)], SCHEMA).repartition(3)
    if salted:
        monkeypatch.setattr(codes, "small", lambda saved: saved)
    assert got(codes.compress(df, entries=20)) == plain(ids.tolist(), x, labels, entries=20)
    assert got(codes.compress(df, parts=2, entries=256, rounds=1)) == plain(ids.tolist(), x, labels, parts=2, rounds=1)


def test_odd_rows(spark):
    """Nulls, gaps, other lengths, huge components, repeated and null ids, clashing columns; empty tables."""
    rows = [(i, v, 5, 1) for i, v, _, _ in odd_rows()]
    found = codes.compress(spark.createDataFrame(rows, SCHEMA), parts=3, entries=4).collect()
    bound = math.isqrt((2**63 - 1) // 12)
    kept = [(10**9 if i is None else i, [min(c, bound / 1024) for c in v]) for i, v, _, _ in rows if v is not None and len(v) == 3 and all(c is not None and math.isfinite(c) for c in v)]
    want = [r[:3] for r in plain([i for i, _ in kept], [v for _, v in kept], [5] * len(kept), parts=3, entries=4)]
    assert sorted((10**9 if r.vec_id is None else r.vec_id, r.code, r.error) for r in found if r.vec_id not in (9, 10)) == want and len(want) == 10
    assert sorted((r.vec_id, r.code, r.error) for r in found if r.vec_id in (9, 10)) == [(9, None, None), (10, None, None)]
    assert codes.compress(spark.createDataFrame([], SCHEMA)).collect() == []
    none = codes.compress(spark.createDataFrame([(1, [1.0, 2.0, 3.0], None, 0), (2, None, 1, 0)], SCHEMA)).collect()
    assert [tuple(r) for r in none] == [(1, None, None, None, None)]
    with pytest.raises(ValueError):
        codes.compress(spark.createDataFrame([], SCHEMA), entries=300)
