"""Drawing labels without a grid; classifiers side by side in packed rows."""

import math
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelweave.operators import frank_wolfe, select


def test_drawn_labels_differ_and_all_sets_are_as_likely(spark):
    n, m, k = 20_000, 6, 3
    rows = select.random_labels(spark.range(n).withColumnRenamed("id", "instance_id"), m, k, seed=4)
    sets = Counter(tuple(sorted(r.own)) for r in rows.groupBy("instance_id").agg(F.collect_list("label_id").alias("own")).collect())
    assert set(sets) == set(combinations(range(m), k)) and sum(sets.values()) == n
    want = n / math.comb(m, k)
    assert sum((c - want) ** 2 / want for c in sets.values()) < 45  # chi-squared, 19 degrees of freedom: 43.8 at 0.001
    again = select.random_labels(spark.range(n).withColumnRenamed("id", "instance_id"), m, k, seed=4)
    assert again.exceptAll(rows).isEmpty() and not select.random_labels(spark.range(n).withColumnRenamed("id", "instance_id"), m, k, seed=5).exceptAll(rows).isEmpty()


def test_a_row_costs_k_and_not_m(spark):
    one = spark.range(50).withColumnRenamed("id", "instance_id")
    rows = select.random_labels(one, 2_000_000_000, 5).collect()
    assert len({(r.instance_id, r.label_id) for r in rows}) == 250 and max(r.label_id for r in rows) > 10**9
    plan = rows and select.random_labels(one, spark.createDataFrame([(j,) for j in (3, 9, 11)], "label_id int"), 2)
    assert "Cartesian" not in plan._jdf.queryExecution().toString() and "NestedLoop" not in plan._jdf.queryExecution().toString()
    assert {r.label_id for r in plan.collect()} == {3, 9, 11} and plan.count() == 100
    for m, k, size in ((2, 5, 2), (0, 3, 0), (4, 0, 0)):
        assert select.random_labels(one, m, k).count() == 50 * size


@pytest.fixture(scope="module")
def mixture(spark):
    rng = np.random.default_rng(6)
    found = frank_wolfe.RandomizedClassifier(2, np.array([3, 5, 8, 9]), rng.normal(size=(5, 4)), rng.normal(size=(5, 4)), np.array([0.1, 0.4, 0.2, 0.2, 0.1]))
    cells = [(i, int(j), float(rng.random())) for i in range(80) for j in found.labels if rng.random() < 0.8]
    return found, cells, spark.createDataFrame(cells, "instance_id bigint, label_id int, eta double").repartition(3)


def by_hand(found, cells, i, c, k):
    own = [(found.a[c][list(found.labels).index(j)] * e + found.b[c][list(found.labels).index(j)], -j) for r, j, e in cells if r == i]
    return {-j for g, j in (sorted(own, reverse=True)[:k] if k else [x for x in own if x[0] >= 0])}


@pytest.mark.parametrize("k", [2, 0])
def test_predictions_of_a_mixture(spark, mixture, k):
    found, cells, eta = mixture
    weights, parts = found.weights(spark), found.mixture(spark)
    u = (F.col("instance_id") % 20 + 0.5).cast("double") / 20
    got = frank_wolfe.predict_randomized(eta, weights, parts, k, u)
    high = np.cumsum(found.p)
    want = {(i, j) for i in {r[0] for r in cells} for j in by_hand(found, cells, i, int(np.flatnonzero((i % 20 + 0.5) / 20 < high)[0]), k)}
    assert {(r.instance_id, r.label_id) for r in got.collect()} == want
    share = {(r.instance_id, r.label_id): r.value for r in frank_wolfe.expected_predictions(eta, weights, parts, k).collect()}
    expect = {}
    for i in {r[0] for r in cells}:
        for c in range(5):
            for j in by_hand(found, cells, i, c, k):
                expect[i, j] = expect.get((i, j), 0) + found.p[c]
    assert share == pytest.approx(expect)


def test_plans_have_one_shuffle_of_cells(spark, mixture):
    found, _, eta = mixture
    for df in (found.predict(eta), found.expected(eta)):
        plan = df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
    with pytest.raises(ValueError):
        frank_wolfe.expected_predictions(eta, found.weights(spark).where("label_id <> 5 or classifier_id > 0"), found.mixture(spark), 2)


def test_places_without_a_window(spark):
    from labelweave.operators.labels import label_map, most_frequent
    from labelweave.operators.places import placed

    rng = np.random.default_rng(9)
    rows = [(int(v), i, float(v % 7)) for i, v in enumerate(rng.permutation(500))]
    df = spark.createDataFrame(rows, "v bigint, i int, prior double").repartition(6)
    assert {r.v: r.pos for r in placed(df, "v").collect()} == {v: v for v, _, _ in rows}
    down = placed(df, F.desc("prior"), F.asc("v"), name="at")
    assert [r.v for r in down.orderBy("at").collect()] == [v for _, v in sorted((-p, v) for v, _, p in rows)]
    assert "Window" not in down._jdf.queryExecution().optimizedPlan().toString() and placed(df.limit(0), "v").count() == 0
    top = most_frequent(df.select(F.col("v").cast("int").alias("label_id"), "prior"), 0.1)
    assert sorted(r.label_id for r in top.collect()) == sorted(v for _, v in sorted((-p, v) for v, _, p in rows)[:50])
    names = label_map(df.select(F.format_string("n%03d", "v").alias("label")), df.select(F.lit("a").alias("label")))
    assert names.dtypes == [("label", "string"), ("label_id", "int")]
    assert {r.label: r.label_id for r in names.collect()} == {"a": 0} | {f"n{v:03d}": v + 1 for v, _, _ in rows}
