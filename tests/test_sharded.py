"""Label tables in place of arrays give the classifier that arrays give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelweave.functions.metrics import Metric
from labelweave.operators import frank_wolfe, sharded


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    eta = rng.random((150, 12)) * np.linspace(1, 0.1, 12)
    cells = [(i, j, float(eta[i, j]), int(rng.random() < eta[i, j])) for i in range(150) for j in range(12) if rng.random() < 0.7]
    grid = spark.createDataFrame(cells, "instance_id bigint, label_id int, eta double, y int").cache()
    y = grid.where("y = 1").selectExpr("instance_id", "label_id", "1D as value")
    return y, grid.select("instance_id", "label_id", "eta"), spark.range(150).withColumnRenamed("id", "instance_id"), spark.createDataFrame([(j,) for j in range(12)], "label_id int")


@pytest.mark.parametrize(("metric", "k"), [(Metric("f1"), 2), (Metric("balanced_accuracy"), 0), (Metric("recall", mix=0.4, k=2), 2)])
def test_same_classifier(spark, data, monkeypatch, metric, k):
    want = frank_wolfe.find_classifier(*data, metric, k, max_iters=4)
    monkeypatch.setattr(sharded, "SENT", 0 if k else 100)
    found = sharded.find_classifier(*data, metric, k, max_iters=4, blocks=5)
    assert found.p == pytest.approx(want.p.tolist(), abs=1e-9) and [h["utility"] for h in found.history] == pytest.approx([h["utility"] for h in want.history])
    rows = {(r.classifier_id, r.label_id): (r.a, r.b) for r in found.weights.collect()}
    assert len(rows) == want.a.size
    for (c, j), (a, b) in rows.items():
        assert (a, b) == pytest.approx((want.a[c, j], want.b[c, j]), rel=1e-6, abs=1e-9)
    u = (F.col("instance_id") % 17 + 0.5).cast("double") / 17
    assert sorted(map(tuple, found.predict(data[1], draw=u).collect())) == sorted(map(tuple, want.predict(data[1], draw=u).collect()))


def test_coupled_objectives_are_refused(data):
    with pytest.raises(ValueError):
        sharded.find_classifier(*data, Metric("f1", "micro"), 2)
