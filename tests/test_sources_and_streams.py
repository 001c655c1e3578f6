import os

import numpy as np
import pytest

from labelweave.functions import metrics as M
from labelweave.operators import labels as L
from labelweave.sources import text
from labelweave.streaming import online


def test_text_formats(spark, tmp_path):
    labels = tmp_path / "labels.txt"
    labels.write_text("3 10 5\n1,2 0:0.5 3:1\n 4:1.0\n4 1:2\n")
    found = text.read_labels(spark, str(labels))
    assert sorted(map(tuple, found.collect())) == [(0, 1, 1.0), (0, 2, 1.0), (2, 4, 1.0)]
    scores = tmp_path / "scores.txt"
    scores.write_text("1:0.5 2:0.25\n\n7:1e-3\n")
    assert sorted(map(tuple, text.read_scores(spark, str(scores)).collect())) == [(0, 1, 0.5), (0, 2, 0.25), (2, 7, 0.001)]
    names = tmp_path / "names.txt"
    names.write_text("cat dog\nbird\n")
    ids = L.label_map(spark.createDataFrame([("dog",), ("cat",)], "label string"), spark.createDataFrame([("bird",), ("dog",)], "label string"))
    got = text.read_labels(spark, str(names), header=False, delimiter=" ", features_after="\t", label_map=ids)
    assert sorted(map(tuple, got.collect())) == [(0, 1, 1.0), (0, 2, 1.0), (1, 0, 1.0)]
    out = str(tmp_path / "weights")
    text.write_weights(spark.createDataFrame([(0, 1.5), (1, 9.0), (2, 2.0)], "label_id int, a double"), out)
    assert [r.a for r in text.read_weights(spark, out).orderBy("label_id").collect()] == [1.5, 2.0, 2.0]


def test_arrays(spark):
    rows = spark.createDataFrame([(0, [3, 1], [0.5, 0.7])], "instance_id bigint, labels array<int>, scores array<double>")
    cells = text.from_arrays(rows)
    assert sorted(map(tuple, cells.collect())) == [(0, 1, 0.7), (0, 3, 0.5)]
    packed = text.pack(cells, "eta")
    assert sorted(map(tuple, text.unpack(packed).collect())) == [(0, 1, 0.7), (0, 3, 0.5)]
    assert [r.label_id for r in text.from_dense(rows, "scores", 1).collect()] == [1]


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(2)
    eta = rng.random((200, 5)) * np.linspace(1, 0.3, 5)
    rows = [(i, j, float(eta[i, j]), int(rng.random() < eta[i, j])) for i in range(200) for j in range(5)]
    return spark.createDataFrame(rows, "instance_id bigint, label_id int, eta double, y int").cache(), spark.createDataFrame([(j,) for j in range(5)], "label_id int"), eta, rows


def test_replay_keeps_order_and_counts(spark, cells):
    df, labels, eta, rows = cells
    top = online.replay(df, labels, "default", M.Metric("f1"), 2).groupBy("instance_id").count().collect()
    assert len(top) == 200 and all(r["count"] == 2 for r in top)
    learner, want = online.Learner("gradient", M.Metric("f1"), 2, 5), []
    for i in range(200):
        chosen = learner.choose(np.arange(5), eta[i])
        learner.update(np.arange(5), np.array([r[3] for r in rows[5 * i : 5 * i + 5]], float), chosen)
        want += [(i, int(j)) for j in chosen]
    found = online.replay(df.repartition(7), labels, "gradient", M.Metric("f1"), 2)
    assert sorted((r.instance_id, r.label_id) for r in found.collect()) == sorted(want)
    assert np.allclose(learner.c.sum(axis=0), 200, atol=1e-4)


def test_stream_of_one_batch_uses_the_start_weights(spark, cells, tmp_path):
    df, labels, _, _ = cells
    source = str(tmp_path / "in")
    df.coalesce(1).write.parquet(source)
    seen = []
    stream = spark.readStream.schema(df.schema).parquet(source)
    query, learner = online.start(stream, labels, M.Metric("f1"), 2, lambda d, n: seen.append(d.count()), os.path.join(tmp_path, "state"))
    query.awaitTermination()
    assert seen == [400] and learner.state.n == 200 and np.allclose(learner.state.c.sum(axis=0), 200, atol=1e-4)


def test_retuned_predictions_and_results(spark, cells, tmp_path):
    df, labels, eta, _ = cells
    found = online.replay_retuned(df, labels, "thresholds", M.Metric("f1"), 0, first=80, growth=2.0).collect()
    early = {(r.instance_id, r.label_id) for r in found if r.instance_id < 80}
    assert early == {(i, j) for i in range(80) for j in range(5) if eta[i, j] >= 0.5}
    assert any(r.instance_id >= 160 for r in found)
    both = online.replay_retuned(df, labels, "frank_wolfe", M.Metric("recall"), 2, first=120, growth=2.0)
    assert both.groupBy("instance_id").count().where("count <> 2").isEmpty()
    path = str(tmp_path / "results")
    text.write_results(spark.createDataFrame([(1, 0.5)], "seed int, v double"), path)
    assert text.read_results(spark, path, "seed int, v double").first().v == 0.5
