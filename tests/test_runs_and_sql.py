"""Many runs in one pass, and table functions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelweave.functions import metrics as M
from labelweave.functions import sql
from labelweave.operators import confusion, runs, select


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    cells = [(i, j, float(rng.integers(0, 9)) / 8) for i in range(60) for j in range(7) if rng.random() < 0.8]
    truth = [(i, j, 1.0) for i, j, e in cells if rng.random() < e]
    eta, y = spark.createDataFrame(cells, "instance_id bigint, label_id int, eta double").cache(), spark.createDataFrame(truth, "instance_id bigint, label_id int, value double").cache()
    return eta, y, spark.range(60).withColumnRenamed("id", "instance_id"), spark.createDataFrame([(j,) for j in range(8)], "label_id int")


def test_runs_together_are_runs_alone(spark, data):
    eta, y, instances, labels = data
    gains = {"plain": lambda c: c["eta"], "turned": lambda c: c["eta"] * ((c["label_id"] * 5 + F.col("instance_id")) % 7 - 3)}
    found = runs.top_k_runs(eta, gains, [1, 3])
    conf = runs.confusion_by_run(y, found, instances, labels)
    rows = {(r.run, r.label_id): (r.tp, r.fp, r.fn, r.tn) for r in conf.collect()}
    assert len(rows) == 4 * 8
    values = {(r.run, r.metric): r.value for r in runs.metrics_by_run(conf, {"f1": M.Metric("f1"), "micro": M.Metric("recall", "micro")}).collect()}
    for name, k in (("plain", 1), ("plain", 3), ("turned", 3)):
        gain = F.col("eta") if name == "plain" else F.col("eta") * ((F.col("label_id") * 5 + F.col("instance_id")) % 7 - 3)
        pred = select.best(eta.withColumn("gain", gain), k).select("instance_id", "label_id", F.lit(1.0).alias("value"))
        want = confusion.confusion(y, pred, instances, labels).collect()
        assert {(f"{name}/{k}", r.label_id): (r.tp, r.fp, r.fn, r.tn) for r in want} == {x: v for x, v in rows.items() if x[0] == f"{name}/{k}"}
        c = np.array([[r.tp, r.fp, r.fn, r.tn] for r in want]).T / 60
        assert values[f"{name}/{k}", "f1"] == pytest.approx(M.Metric("f1").value(*c)) and values[f"{name}/{k}", "micro"] == pytest.approx(M.Metric("recall", "micro").value(*c))


def test_summary(spark):
    rows = [(f"{m}/{s}", "f1", v) for m, vs in (("a", (1.0, 3.0)), ("b", (2.0, 2.0)), ("c", (5.0,))) for s, v in enumerate(vs)]
    found = runs.summary(spark.createDataFrame(rows, "run string, metric string, value double"), F.substring_index("run", "/", 1))
    assert sorted((r.method, r.runs, r.mean, r.std, round(r.stderr, 6), r.rank) for r in found.collect()) == [("a", 2, 2.0, 1.0, 0.707107, 2), ("b", 2, 2.0, 0.0, 0.0, 2), ("c", 1, 5.0, 0.0, 0.0, 1)]


def test_table_functions(spark, data):
    eta, *_ = data
    sql.register(spark)
    eta.withColumn("more", F.lit("x")).createOrReplaceTempView("scores_here")
    rows = lambda df: sorted((r.instance_id, r.label_id) for r in df.collect())
    top = spark.sql("SELECT * FROM top_labels(TABLE(SELECT * FROM scores_here), k => 2)")
    assert top.dtypes == [("instance_id", "bigint"), ("label_id", "int"), ("value", "double")]
    assert rows(top) == rows(select.top_k(eta, 2))
    assert "more" not in top._jdf.queryExecution().optimizedPlan().toString()
    above = spark.sql("SELECT * FROM labels_from(TABLE(SELECT * FROM scores_here), threshold => '0.5')")
    assert rows(above) == rows(select.predict(eta, 0, th=0.5))
    eta.select(F.col("instance_id").cast("string").alias("doc"), F.when(F.col("eta") < 0.9, F.col("eta")).alias("s"), F.concat(F.lit("l"), "label_id").alias("tag")).createOrReplaceTempView("named_here")
    named = spark.sql("SELECT * FROM top_labels(TABLE(SELECT * FROM named_here), k => 2, gain => 's * 2', instance => 'doc', label => 'tag')")
    assert named.dtypes[:2] == [("instance_id", "string"), ("label_id", "string")]
    assert sorted((int(r.instance_id), int(r.label_id[1:])) for r in named.collect()) == rows(select.top_k(eta.where("eta < 0.9"), 2))
    for bad in ("top_labels(TABLE(SELECT * FROM scores_here), k => 0)", "top_labels(TABLE(SELECT * FROM scores_here), k => 1, label => 'nothing')"):
        with pytest.raises(Exception, match="k has to be|no column"):
            spark.sql(f"SELECT * FROM {bad}").collect()


def test_table_functions_on_packed_rows(spark, data):
    eta, *_ = data
    sql.register(spark)
    odd = eta.withColumn("eta", F.when(F.col("eta") == 0.5, F.lit(float("nan"))).when(F.col("eta") > 0.2, F.col("eta")))
    odd.createOrReplaceTempView("cells_here")
    odd.groupBy("instance_id").agg(F.collect_list(F.struct("label_id", "eta")).alias("cells")).createOrReplaceTempView("packed_here")
    rows = lambda text: sorted((r.instance_id, r.label_id, r.value) for r in spark.sql(text).collect())
    for text in ("top_labels(TABLE(SELECT *, 'x' AS more FROM {}), k => 2, gain => 'eta * (label_id % 3 - 1)')", "labels_from(TABLE(SELECT * FROM {}), threshold => 'label_id / 8D')"):
        one, two = (rows(f"SELECT * FROM {text.format(x)}") for x in ("cells_here", "packed_here"))
        assert one == two and one
    assert [r[:2] for r in one] == sorted((r.instance_id, r.label_id) for r in odd.where("eta >= label_id / 8D").collect())
