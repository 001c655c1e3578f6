import numpy as np
import pytest
from pyspark.sql import functions as F

from labelweave.functions import metrics as M
from labelweave.operators import block_coordinate as B
from labelweave.operators import confusion as C
from labelweave.operators import frank_wolfe, select
from labelweave.operators import labels as L


@pytest.fixture(scope="module")
def data(spark):
    """A long-tailed problem: scores, sampled labels, dimensions."""
    rng = np.random.default_rng(1)
    eta = rng.random((300, 8)) * np.linspace(1, 0.15, 8)
    y = rng.random(eta.shape) < eta
    cells = [(i, j, float(eta[i, j]), int(y[i, j])) for i in range(300) for j in range(8)]
    grid = spark.createDataFrame(cells, "instance_id bigint, label_id int, eta double, y int").cache()
    return grid, spark.range(300).withColumnRenamed("id", "instance_id"), spark.createDataFrame([(j,) for j in range(8)], "label_id int")


def expected(grid, pred, inst, lab, metric):
    y = grid.selectExpr("instance_id", "label_id", "eta as value")
    c = C.confusion(y, pred, inst, lab, normalize=True).orderBy("label_id").toPandas()
    return metric.value(*(c[e].to_numpy() for e in C.ENTRIES))


def test_block_coordinate_beats_top_k(data):
    grid, inst, lab = data
    eta, metric = grid.select("instance_id", "label_id", "eta"), M.Metric("f1")
    start = expected(grid, select.top_k(eta, 2), inst, lab, metric)
    pred, history = B.minibatch(eta, inst, lab, metric, 2, slices=6)
    assert history == sorted(history) and history[0] == pytest.approx(start)
    one = expected(grid, B.exact(eta, lab, metric, 2), inst, lab, metric)
    two = expected(grid, pred, inst, lab, metric)
    assert two == pytest.approx(history[-1], abs=1e-6)
    assert one > start and two > start and abs(one - two) < 0.01
    assert pred.groupBy("instance_id").count().where("count <> 2").isEmpty()


def test_precision_gives_top_k(data):
    grid, inst, lab = data
    eta = grid.select("instance_id", "label_id", "eta")
    pred = B.exact(eta, lab, M.Metric("f1", mix=0.0, k=2), 2).select("instance_id", "label_id")
    top = select.top_k(eta, 2).select("instance_id", "label_id")
    assert pred.exceptAll(top).isEmpty() and top.exceptAll(pred).isEmpty()


def test_frank_wolfe_near_the_closed_form(data):
    grid, inst, lab = data
    eta, metric = grid.select("instance_id", "label_id", "eta"), M.Metric("recall")
    y = grid.where("y = 1").selectExpr("instance_id", "label_id", "1D as value")
    found = frank_wolfe.find_classifier(y, eta, inst, lab, metric, 2, max_iters=4)
    utilities = [h["utility"] for h in found.history]
    assert utilities == sorted(utilities) and found.p.sum() == pytest.approx(1)
    priors = L.label_priors(y, lab, inst)
    c = C.confusion(y, select.for_macro_recall(eta, 2, priors), inst, lab, normalize=True).toPandas()
    best = metric.value(*(c[e].to_numpy() for e in C.ENTRIES))
    assert abs(best - utilities[-1]) < 0.02
    sums = found.expected(eta).groupBy("instance_id").sum("value").collect()
    assert all(r[1] == pytest.approx(2) for r in sums)
    assert found.predict(eta, seed=1).groupBy("instance_id").count().where("count <> 2").isEmpty()


def test_coverage_step_against_the_formula(data):
    grid, inst, lab = data
    eta = grid.select("instance_id", "label_id", "eta")
    x = np.zeros((300, 8))
    for r in eta.collect():
        x[r.instance_id, r.label_id] = r.eta
    chosen = np.zeros(x.shape, bool)
    chosen[np.arange(300), x.argmax(axis=1)] = True
    fail = np.prod(np.where(chosen, 1 - x, 1.0), axis=0)
    gain = 0.7 / 8 * x * fail / np.where(chosen, 1 - x, 1.0) + 0.3 * x / (300 * 1)
    found = {r.instance_id: r.label_id for r in B.coverage_step(eta, select.top_k(eta, 1), 300, 8, 1, alpha=0.7).collect()}
    assert [found[i] for i in range(300)] == gain.argmax(axis=1).tolist()


def test_coverage_step_over_packed_rows(spark, small, data, tmp_path):
    """The same labels and gains as from tables of cells, a score of 1 and a row of one label among them; the query shuffles no cells."""
    grid, inst, lab = data
    eta = grid.select("instance_id", "label_id", F.when((F.col("instance_id") == 7) & (F.col("label_id") == 2), 1.0).otherwise(F.col("eta")).alias("eta")).where("instance_id <> 9 or label_id = 4")
    names = np.arange(8)
    for k in (1, 2):
        gains = B.coverage_gains(eta, select.top_k(eta, k), 300, 8, k, 0.7)
        want = {(r.instance_id, r.label_id): r.gain for r in select.best(gains, k).collect()}
        rows = B.start_rows(eta, names, k)
        found = {(r.instance_id, r.label_id): r.gain for r in B.coverage_step_gains(rows, names, k, 0.7).collect()}
        assert set(found) == set(want) and len(want) == 299 * k + 1 and all(found[x] == pytest.approx(want[x], abs=1e-12) for x in want)
    assert B.coverage_step_gains(B.start_rows(eta.limit(0), names, 2), names, 2).count() == 0
    from labelweave.plans.queries import queries

    plan = queries()["coverage_step"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and plan.count("Exchange") == 1


def test_slices_are_dealt_anew_and_old_ones_deleted(data, spark):
    import os

    from labelweave.shared import shared_dir

    grid, inst, lab = data
    eta = grid.select("instance_id", "label_id", "eta")
    deal = B.dealt(3, 5)
    places = inst.select(deal(0).alias("a"), deal(1).alias("b")).collect()
    assert {r.a for r in places} == {r.b for r in places} == set(range(5)) and 0.1 < np.mean([r.a == r.b for r in places]) < 0.3
    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    metric = M.Metric("f1")
    pred, history = B.minibatch(eta, inst, lab, metric, 2, slices=5, seed=3, max_iters=6, tolerance=-1.0)
    assert len(history) == 7 and history == sorted(history) and history[-1] > history[0]
    assert expected(grid, pred, inst, lab, metric) == pytest.approx(history[-1], abs=1e-9)
    (own,) = set(os.listdir(folder)) - before
    assert len(os.listdir(os.path.join(folder, own))) == 5  # the last sweep's slices alone
    other, _ = B.minibatch(eta, inst, lab, metric, 2, slices=5, seed=4, max_iters=1, tolerance=-1.0)
    first, _ = B.minibatch(eta, inst, lab, metric, 2, slices=5, seed=3, max_iters=1, tolerance=-1.0)
    assert not other.select("instance_id", "label_id").exceptAll(first.select("instance_id", "label_id")).isEmpty()


def test_greedy_start_and_large_sets(data):
    grid, inst, lab = data
    eta, metric = grid.select("instance_id", "label_id", "eta"), M.Metric("f1")
    pred, history = B.minibatch(eta, inst, lab, metric, 2, slices=4, init="greedy", max_iters=3, tolerance=-1.0)
    assert history == sorted(history) and expected(grid, pred, inst, lab, metric) == pytest.approx(history[-1], abs=1e-9)
    sliced = B.exact(eta, lab, metric, 2, most_cells=100)  # too many for one task
    assert expected(grid, sliced, inst, lab, metric) == pytest.approx(history[-1], abs=0.01)


def mixture_value(found, grid, inst, lab, metric):
    """The metric at the expected confusion matrix of a randomized classifier over labels that are known."""
    y = grid.where("y = 1").selectExpr("instance_id", "label_id", "1D as value")
    c = C.confusion(y, found.expected(grid.select("instance_id", "label_id", "eta")), inst, lab, normalize=True).orderBy("label_id").toPandas()
    return np.array([c[e].to_numpy() for e in C.ENTRIES]), metric.value(*(c[e].to_numpy() for e in C.ENTRIES))


def test_a_mixture_carried_on_over_new_rows(data):
    """Only new rows are read, sums stay exact, and the outcome is as good as one that is found afresh."""
    grid, inst, lab = data
    metric = M.Metric("f1")

    def part(low, high):
        own = grid.where((grid.instance_id >= low) & (grid.instance_id < high))
        return own.where("y = 1").selectExpr("instance_id", "label_id", "1D as value"), own.select("instance_id", "label_id", "eta"), own.select("instance_id").distinct()

    found = frank_wolfe.find_classifier(*part(0, 100), lab, metric, 2, max_iters=6)
    fixed = frank_wolfe.extend(found, *part(100, 300), metric, max_iters=0, least=0.0)
    exact, value = mixture_value(found, grid, inst, lab, metric)
    assert fixed.n == 300 and np.allclose(fixed.confusion, exact) and fixed.history[0]["utility"] == pytest.approx(value)
    for low in (100, 200):
        before, found = found, frank_wolfe.extend(found, *part(low, low + 100), metric, max_iters=6)
        assert found.n == low + 100 and found.p.sum() == pytest.approx(1) and len(found.p) <= len(before.p) + 6
    afresh = frank_wolfe.find_classifier(*part(0, 300), lab, metric, 2, max_iters=12)
    assert mixture_value(found, grid, inst, lab, metric)[1] >= mixture_value(afresh, grid, inst, lab, metric)[1] - 0.01
    assert frank_wolfe.extend(found, *part(900, 901), metric) is found
