from fractions import Fraction

import numpy as np
import pytest

from labelweave.llm import whitening
from tests.llm.test_vectors import odd_rows

SCHEMA = "vec_id bigint, embedding array<float>, n int, component string"


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(c) for c in v], 0, "") for i, v in zip(ids, x, strict=True)], SCHEMA).repartition(3)


def check(found, ids, x, most=8):
    """Against integers of any size and eigenvectors of the covariance."""
    rows = [[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in x]
    n, d = len(rows), len(rows[0])
    sums = [sum(c) for c in zip(*rows, strict=True)]
    centred = [[n * c - s for c, s in zip(r, sums, strict=True)] for r in rows]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in centred), n**3)) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    by = {(r.vec_id, r.component): r for r in found}
    assert len(by) == len(found) == n * min(most, d)
    for c in range(1, min(most, d) + 1):
        want = np.array(centred, float) / n @ vectors[:, c - 1] / np.sqrt(values[c - 1])
        got = np.array([by[int(i), c].whitened for i in ids])
        sign = np.sign(got @ want)
        assert np.allclose(got, sign * want, atol=1e-8)
        for i, r in zip(ids, centred, strict=True):
            row = by[int(i), c]
            exact = sum(v * v for v in r)
            assert (row.n, row.deviation) == (n, exact if exact < 2**63 else None)
            assert row.explained == pytest.approx(values[c - 1] / np.trace(cov), rel=1e-9) and 0 <= row.identity_error < 1e-9
    w = np.array([[by[int(i), c].whitened for c in range(1, min(most, d) + 1)] for i in ids])
    w -= w.mean(axis=0)
    assert found[0].identity_error == pytest.approx(np.abs(w.T @ w / n - np.eye(w.shape[1])).max(), abs=1e-12)


def test_query(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").toPandas()
    keep = [k for k, v in enumerate(rows.embedding) if v is not None and np.isfinite(np.asarray(v, float)).all()]
    check(whitening.op13_whitening(spark, small).collect(), rows.vec_id.to_numpy()[keep], np.stack(rows.embedding[keep]).astype(float))


def test_few_dimensions_and_large_numbers(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3)) * 2e4 + 1e7  # deviations about as large as 64 bits hold
    found = whitening.whiten(frame(spark, range(60), x)).collect()
    check(found, range(60), x.astype(np.float32))
    assert 0 < sum(r.deviation is None for r in found) < len(found)
    x = (rng.normal(size=(60, 3)) @ np.diag([1, 1e3, 1e6]) + [0, 5e4, -3e8]).astype(np.float32)
    check(whitening.whiten(frame(spark, range(60), x)).collect(), range(60), x)
    check(whitening.whiten(frame(spark, range(60), x), components=2).collect(), range(60), x, most=2)


def test_scatter_is_exact(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-(2**50), 2**50, (5000, 4))
    df = spark.createDataFrame([(i, [float(c) / 1024 for c in v]) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>").repartition(5)
    got = whitening.scatter(whitening._own(df, "vec_id", "embedding"), 4, 5000, 2**50, 1024, 0)
    rows = np.concatenate([x, np.ones((5000, 1), np.int64)], axis=1).astype(object)
    assert (got == rows.T @ rows).all()
    moduli = whitening.primes(10**12)
    values = np.array([[-(10**11), 3, 0]], object)
    assert (whitening.from_residues(np.array([[int(v) % p for v in values[0]] for p in moduli]), moduli) == values[0]).all()


def test_odd_rows(spark):
    """Nulls, gaps, other lengths, huge components, repeated and null ids, clashing columns; no variance; empty tables."""
    found = whitening.whiten(spark.createDataFrame([(i, v, 1, "x") for i, v, _, _ in odd_rows()], SCHEMA)).collect()
    assert {r.vec_id for r in found} == {1, 2, 3, 5, None, 50, 11, 100, 12} and len(found) == 30
    assert {r.n for r in found} == {10} and all(r.deviation is None for r in found)
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None, 0, "")], SCHEMA)).count() == 0
    same = whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0], 0, "") for i in range(3)], SCHEMA)).collect()
    assert len(same) == 6 and all(r.whitened is None and r.explained is None and r.deviation == 0 and r.identity_error == 0 for r in same)
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i], 0, "") for i in range(3)], SCHEMA)).collect()
    assert sorted((r.component, r.whitened is None) for r in line) == [(1, False)] * 3 + [(2, True)] * 3
    assert all(r.explained == pytest.approx(1.0) for r in line if r.component == 1)
