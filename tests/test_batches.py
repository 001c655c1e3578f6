"""Packed rows as arrays: choices within rows of any length, sums by label, searches from cells and from packed rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelweave.functions import metrics as M
from labelweave.operators import batches, select
from labelweave.operators import block_coordinate as B
from labelweave.operators.packed import cells_in_rows
from labelweave.streaming import online


def test_largest_of_each_row():
    rng = np.random.default_rng(2)
    for size in (np.full(40, 6), rng.integers(0, 7, 40)):
        gain = rng.integers(0, 4, size.sum()) / 3 - 0.4
        cuts = np.split(np.arange(size.sum()), np.cumsum(size)[:-1])
        want = np.zeros(len(gain), bool)
        for own in cuts:
            want[sorted(own, key=lambda i: (-gain[i], i))[:2]] = True
        assert (batches.largest(gain, size, 2) == want).all()
        assert (batches.largest(gain, size, 0) == (gain >= 0)).all()


@pytest.mark.parametrize("init", ["top", "random", "greedy"])
def test_packed_rows_are_searched_like_cells(spark, init):
    rng = np.random.default_rng(3)
    cells = [(i, j, float(rng.random())) for i in range(90) for j in range(6) if rng.random() < 0.7] + [(0, 9, 0.5)]
    eta = spark.createDataFrame(cells, "instance_id bigint, label_id int, eta double")
    labels, instances = spark.createDataFrame([(j,) for j in range(6)], "label_id int"), spark.range(95).withColumnRenamed("id", "instance_id")
    rows = lambda df: sorted((r.instance_id, r.label_id, r.value) for r in df.collect())
    more = {"slices": 2, "max_iters": 1, "tolerance": -1.0, "init": init}
    one, first = B.minibatch(eta, instances, labels, M.Metric("f1"), 2, **more)
    two, second = B.minibatch(cells_in_rows(eta), instances, labels, M.Metric("f1"), 2, **more)
    assert rows(one) == rows(two) and first == pytest.approx(second) and all(j < 6 for _, j, _ in rows(one))


def test_a_frozen_step_is_the_step_over_cells(spark):
    from labelweave.operators import confusion, select
    from labelweave.operators.packed import label_ids

    rng = np.random.default_rng(5)
    cells = [(i, j, float(rng.random())) for i in range(70) for j in range(6)]
    eta = spark.createDataFrame(cells, "instance_id bigint, label_id int, eta double")
    labels, instances = spark.createDataFrame([(j,) for j in range(6)], "label_id int"), spark.range(70).withColumnRenamed("id", "instance_id")
    metric, pred = M.Metric("hmean", mix=0.5, k=2), select.top_k(eta, 2)
    conf = confusion.confusion(eta.withColumnRenamed("eta", "value"), pred, instances, labels)
    want = select.best(B.slice_gains(eta, pred, conf, 70, 6, metric), 2)
    names = label_ids(labels)
    found = B.step_gains(B.start_rows(cells_in_rows(eta), names, 2), names, metric, 2)
    rows = lambda df: {(r.instance_id, r.label_id): r.gain for r in df.collect()}
    assert rows(found) == pytest.approx(rows(want))


@pytest.mark.parametrize("kind,metric", [("greedy", M.Metric("hmean", mix=0.5, k=2)), ("gradient", M.Metric("f1")), ("gradient", M.Metric("f1", "micro"))])
def test_replay_in_chunks_is_sequential(spark, kind, metric):
    from labelweave.streaming import online

    rng, want = np.random.default_rng(6), []
    cells = [[(i, j, float(rng.random()), int(rng.random() < 0.4)) for j in range(7) if rng.random() < 0.8] for i in range(120)]
    learner = online.Learner(kind, metric, 2, 7, names=np.arange(7))
    for own in cells:
        index, eta, y = (np.array([c[x] for c in own]) for x in (1, 2, 3))
        chosen = learner.choose(index, eta)
        learner.update(index, y, chosen)
        want += [(own[0][0], int(index[j])) for j in chosen]
    rows = spark.createDataFrame([c for own in cells for c in own], "instance_id bigint, label_id int, eta double, y int")
    found = online.replay(rows, spark.range(7).selectExpr("cast(id as int) as label_id"), kind, metric, 2, chunk=50)
    assert sorted((r.instance_id, r.label_id) for r in found.collect()) == sorted(want)


def test_exact_takes_packed_rows(spark):
    cells = [(i, j, (i * 7 + j * 5) % 11 / 11) for i in range(30) for j in range(5)]
    eta = cells_in_rows(spark.createDataFrame(cells, "instance_id bigint, label_id int, eta double"))
    labels, rows = spark.createDataFrame([(j,) for j in range(5)], "label_id int"), lambda df: sorted((r.instance_id, r.label_id) for r in df.collect())
    want = sorted((i, j) for i in range(30) for j in sorted(range(5), key=lambda j: (-((i * 7 + j * 5) % 11), j))[:2])
    for most in (1000, 10):  # in one task, and in slices
        assert rows(B.exact(eta, labels, M.Metric("f1", mix=0.0, k=2), 2, most_cells=most, max_iters=1)) == want


def test_retuned_frank_wolfe_takes_packed_rows_and_follows_the_table_form(spark):
    """Periods that are searched in arrays give the labels of find_classifier, extend and predict on the cells."""
    from labelweave.operators import frank_wolfe

    rng = np.random.default_rng(5)
    cells = [(i, j, round(float(rng.random()), 2), int(rng.random() < 0.4)) for i in range(10, 250) for j in range(6) if (i + j) % 9]
    rows, labels, metric = spark.createDataFrame(cells, "instance_id bigint, label_id int, eta double, y int").cache(), spark.createDataFrame([(j,) for j in range(5)], "label_id int"), M.Metric("f1")
    packed = rows.groupBy("instance_id").agg(F.sort_array(F.collect_list(F.struct("label_id", "eta", "y"))).alias("cells"))
    found = [sorted((r.instance_id, r.label_id) for r in online.replay_retuned(x, labels, "frank_wolfe", metric, 2, first=60, growth=1.5, max_iters=4).collect()) for x in (packed, rows)]
    mixture, want = None, []
    for before, start, stop in ((0, 10, 70), (10, 70, 100), (70, 100, 145), (100, 145, 212), (145, 212, 400)):
        own, seen = rows.where(F.col("instance_id").between(start, stop - 1)).select("instance_id", "label_id", "eta"), rows.where(F.col("instance_id").between(before, start - 1))
        data = seen.where("y > 0").select("instance_id", "label_id", F.lit(1.0).alias("value")), seen.select("instance_id", "label_id", "eta"), seen.select("instance_id").distinct()
        if start > 10:
            mixture = frank_wolfe.extend(mixture, *data, metric, max_iters=4) if mixture else frank_wolfe.find_classifier(*data, labels, metric, 2, max_iters=4)
        want += mixture.predict(own).collect() if mixture else select.predict(own, 2).collect()
    assert found[0] == found[1] == sorted((r.instance_id, r.label_id) for r in want)


def test_the_first_cells_in_few_passes():
    rng = np.random.default_rng(6)
    for key in (rng.integers(0, 4, 900).astype(float), np.where(rng.random(900) < 0.9, np.inf, 1.0), np.where(rng.random(900) < 0.2, np.nan, 1.0)):
        order = np.argsort(key.reshape(90, 10), axis=1, kind="stable")[:, :3]
        want = np.zeros((90, 10), bool)
        np.put_along_axis(want, order, True, axis=1)
        assert (batches.first(key, np.full(90, 10), 3) == want.ravel()).all()


@pytest.mark.parametrize("kind", ["default", "gradient", "thresholds", "greedy"])
def test_a_batch_of_packed_rows_is_learned_like_cells(spark, kind):
    rng = np.random.default_rng(7)
    cells = [(i, j, round(float(rng.random()), 2), int(rng.random() < 0.4)) for i in range(80) for j in range(6) if rng.random() < 0.8]
    rows, labels = spark.createDataFrame(cells, "instance_id bigint, label_id int, eta double, y int").cache(), spark.createDataFrame([(j,) for j in range(5)], "label_id int")
    packed = rows.groupBy("instance_id").agg(F.sort_array(F.collect_list(F.struct("label_id", "eta", "y"))).alias("cells"))
    seen, states = [], []
    for data in (rows, packed):
        learner, own = online.BatchLearner(labels, M.Metric("f1"), 2, kind=kind), []
        for number in (0, 1):
            learner.step(data.where(F.col("instance_id") % 2 == number), number, lambda d, n, own=own: own.extend(sorted((r.instance_id, r.label_id) for r in d.collect())))
        seen.append(own), states.append(learner.state.c)
    assert seen[0] == seen[1] and len(seen[0]) > 100 and (states[0] == states[1]).all() and learner.state.n == len({c[0] for c in cells})
    one = online.Learner(kind, M.Metric("f1"), 2, 5, names=np.arange(5))  # both batches by frozen weights, row by row
    for number in (0, 1):
        later = online.Learner(kind, M.Metric("f1"), 2, 5, n=one.n, c=one.c.copy(), names=one.names)
        for i in range(number, 80, 2):
            own = [c for c in cells if c[0] == i and c[1] < 5]
            index, eta, y = (np.array([c[x] for c in own], t) for x, t in ((1, int), (2, float), (3, float)))
            picked = one.choose(index, eta) if len(own) else np.zeros(0, int)
            assert sorted((i, int(j)) for j in index[picked]) == [x for x in seen[0] if x[0] == i]
            if any(c[0] == i for c in cells):
                later.update(index, y, picked)
        one = later
    assert np.allclose(one.c, states[0])
