import math

import numpy as np
import pytest

from labelweave.functions import metrics as M
from labelweave.operators import confusion as C
from labelweave.operators import labels, select

ETA = [[0.9, 0.2, 0.1], [0.8, 0.3, 0.05], [0.7, 0.6, 0.2], [0.1, 0.05, 0.4]]
Y = [[1, 0, 0], [1, 1, 0], [0, 1, 1], [0, 0, 1]]


def frames(spark, y, *more):
    """Dimensions, and a sparse table for each matrix."""
    cells = lambda a: [(i, j, float(v)) for i, row in enumerate(a) for j, v in enumerate(row) if v]
    make = lambda a: spark.createDataFrame(cells(a), "instance_id bigint, label_id int, value double")
    dims = spark.range(len(y)).withColumnRenamed("id", "instance_id"), spark.createDataFrame([(j,) for j in range(len(y[0]))], "label_id int")
    return (*dims, make(y), *map(make, more))


def scores(spark, eta):
    return spark.createDataFrame([(i, j, v) for i, r in enumerate(eta) for j, v in enumerate(r)], "instance_id bigint, label_id int, eta double")


def test_recorded_value_of_fractional_predictions(spark):
    eta, pred = [[0.4, 0.2, 0.6], [0.8, 0.4, 0.8]], [[1, 0, 1], [0.76810359, 0.69829113, 0.53360528]]
    inst, lab, t, p = frames(spark, eta, pred)
    conf = C.confusion(t, p, inst, lab, normalize=True)
    assert M.averaged(conf, M.f1, epsilon=1e-5).first().value == pytest.approx(0.6046468639156677, abs=1e-12)
    assert M.averaged(conf, M.f1).first().value == pytest.approx(0.6046521991766182, abs=1e-12)


@pytest.mark.parametrize("y, p, score, jac", [
    ([[0.4, 0.2, 0.6], [0.8, 0.4, 0.3]], [[0, 0, 1], [1, 0, 0]], 0.683333, 0.344322),
    ([[0.4, 0.2, 0.6], [0.8, 0.4, 0.8]], [[0, 0, 1], [1, 0, 1]], 0.7, 0.42381),
    ([[0.4, 0.2, 0.6], [0.8, 0.4, 0.8]], [[1, 0, 1], [1, 1, 1]], 0.633333, 0.544444),
])
def test_hamming_and_jaccard(spark, y, p, score, jac):
    inst, lab, t, q = frames(spark, y, p)
    conf = C.confusion(t, q, inst, lab, normalize=True)
    assert M.averaged(conf, M.accuracy).first().value == pytest.approx(score, abs=1e-6)
    assert M.averaged(conf, M.jaccard).first().value == pytest.approx(jac, abs=1e-6)


@pytest.mark.parametrize("k, want, f1, rec, pk, cov, aban", [(1, ([2, 0, 1], [1, 0, 0], [0, 2, 1], [1, 2, 2]), 0.488888889, 0.5, 0.75, 2 / 3, 0.75), (2, ([2, 2, 1], [2, 1, 0], [0, 0, 1], [0, 1, 2]), 0.711111111, 0.833333333, 0.625, 1, 1)])
def test_top_k_of_a_small_matrix(spark, k, want, f1, rec, pk, cov, aban):
    inst, lab, t = frames(spark, Y)
    pred = select.top_k(scores(spark, ETA), k)
    conf = C.confusion(t, pred, inst, lab)
    rows = conf.orderBy("label_id").collect()
    assert tuple([int(r[e]) for r in rows] for e in C.ENTRIES) == want
    rates = C.confusion(t, pred, inst, lab, normalize=True)
    assert M.averaged(rates, M.f1).first().value == pytest.approx(f1, abs=1e-6)
    assert M.averaged(rates, M.recall).first().value == pytest.approx(rec, abs=1e-6)
    assert M.averaged(rates, M.precision_at_k, "sum", k=k).first().value == pytest.approx(pk)
    assert M.hits(conf).first().value == pytest.approx(cov)
    assert M.hits(C.confusion(t, pred, inst, lab, by="instance_id")).first().value == pytest.approx(aban)


def test_propensities(spark):
    inst, lab, t = frames(spark, Y)
    for r in labels.inverse_propensities(t, lab, inst).collect():
        assert r.inverse_propensity == pytest.approx(1.32103172)
    unseen = labels.inverse_label_priors(t.where("label_id > 0"), lab, inst).collect()
    assert {r.label_id: r.inverse_prior for r in unseen}[0] == math.inf


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    for name in ("precision", "recall", "f1", "fbeta", "jaccard", "balanced_accuracy", "gmean", "hmean"):
        c, psi = rng.uniform(0.05, 1, (4, 50)), M.Metric(name, beta=2.0).psi
        for i, g in enumerate(M.gradient(name, *c, beta=2.0)):
            up, down = c.copy(), c.copy()
            up[i] += 1e-6
            down[i] -= 1e-6
            assert np.allclose(g, (psi(*up) - psi(*down)) / 2e-6, atol=1e-6), name
    zero = np.zeros(2)
    assert all(np.isfinite(g).all() for n in ("gmean", "hmean") for g in M.gradient(n, zero, zero, zero, zero))
    assert M.hmean(zero, zero, zero, zero).tolist() == [0, 0]


def test_edge_cases(spark):
    inst, lab, t = frames(spark, [[0, 0], [0, 0]])
    conf = C.confusion(t, t, inst, lab).collect()
    assert [(r.tp, r.fp, r.fn, r.tn) for r in conf] == [(0, 0, 0, 2)] * 2
    eta = scores(spark, [[0.5, 0.5], [0.2, 0.9]])
    assert [tuple(r)[:2] for r in select.top_k(eta, 1).orderBy("instance_id").collect()] == [(0, 0), (1, 1)]
    assert select.top_k(eta, 9).count() == 4 and select.predict(eta, 0, th=0.5).count() == 3
    assert select.top_k(eta.limit(0), 2).count() == 0
    one = C.ConfusionMatrix(C.confusion(t, t, inst, lab))
    assert (one + one - one).equals(one) and (2 * one / 2).equals(one)
    assert [r.tn for r in one.normalize().df.collect()] == [1.0, 1.0]
    assert [r.tn for r in (one // 3).df.collect()] == [0.0, 0.0]
    assert select.exactly_k(t, inst, 0).first().at_k
