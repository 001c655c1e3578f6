"""Many runs at once: predictions of seeds, methods and numbers of labels share their scans and shuffles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelweave.functions.metrics import Metric


def top_k_runs(eta: DataFrame, gains: dict[str, Callable[[Column], Column]], ks: list[int]) -> DataFrame:
    """(run, instance_id, label_id, value): for each named gain and each k the k best labels of each instance; run is `name/k`.

    A gain is a function of a cell (label_id, eta), and may read the column instance_id. Scores are packed once,
    and a gain is sorted once for all k. Ties go to smaller labels.
    """
    rows = eta.groupBy("instance_id").agg(F.collect_list(F.struct("label_id", F.col("eta").cast("double").alias("eta"))).alias("cells"))
    picked = []
    for name, gain in gains.items():
        order = F.sort_array(F.transform("cells", lambda c: F.struct((-gain(c)).alias("g"), c["label_id"].alias("label_id"))))  # noqa: B023
        rows = rows.withColumn(f"order_{name}", F.transform(F.slice(order, 1, max(ks)), lambda x: x["label_id"]))
        picked += [F.transform(F.slice(f"order_{name}", 1, k), lambda j: F.struct(F.lit(f"{name}/{k}").alias("run"), j.alias("label_id"))) for k in ks]  # noqa: B023
    return rows.select("instance_id", F.inline(F.flatten(F.array(*picked)))).select("run", "instance_id", "label_id", F.lit(1.0).alias("value"))


def confusion_by_run(y_true: DataFrame, y_pred: DataFrame, instances: DataFrame, labels: DataFrame) -> DataFrame:
    """(run, label_id, tp, fp, fn, tn) of predictions (run, instance_id, label_id, value), a row for each run and label.

    Labels and predictions of all runs meet in one shuffle, in which a cell's label is read once whatever the number
    of runs; then sums are added up before they are shuffled.
    """
    y = y_true.select(F.lit(None).cast("string").alias("run"), "instance_id", "label_id", F.lit(0.0).alias("p"), F.col("value").cast("double").alias("y"))
    p = y_pred.select(F.col("run").cast("string").alias("run"), "instance_id", "label_id", F.col("value").cast("double").alias("p"), F.lit(0.0).alias("y"))
    cells = y.unionByName(p).groupBy("instance_id", "label_id").agg(F.sum("y").alias("y"), F.collect_list(F.when(F.col("run").isNotNull(), F.struct("run", "p"))).alias("runs"))
    each = cells.select("label_id", "y", F.explode(F.array_append("runs", F.struct(F.lit(None).cast("string").alias("run"), F.lit(0.0).alias("p")))).alias("x"))
    sums = each.groupBy(F.col("x.run").alias("run"), "label_id").agg(F.sum(F.col("x.p") * F.col("y")).alias("tp"), F.sum("x.p").alias("predicted"), F.sum("y").alias("positive"))
    # from here on a row for each run and label
    own, all_ = sums.where("run is not null").select("run", "label_id", "tp", "predicted"), sums.where("run is null").select("label_id", "positive")
    grid = y_pred.select(F.col("run").cast("string").alias("run")).distinct().crossJoin(F.broadcast(labels.select("label_id").distinct()))
    full = grid.join(own, ["run", "label_id"], "left").join(F.broadcast(all_), "label_id", "left").crossJoin(F.broadcast(instances.agg(F.count("*").alias("n"))))
    tp, predicted, positive = (F.coalesce(c, F.lit(0.0)) for c in ("tp", "predicted", "positive"))
    return full.select("run", "label_id", tp.alias("tp"), (predicted - tp).alias("fp"), (positive - tp).alias("fn"), (F.col("n") - predicted - positive + tp).alias("tn"))


def metrics_by_run(conf: DataFrame, metrics: dict[str, Metric]) -> DataFrame:
    """(run, metric, value) of a confusion matrix by run: all metrics in one pass over it."""
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    rates = conf.select("run", "label_id", *[(F.col(c) / n).alias(c) for c in ("tp", "fp", "fn", "tn")])
    wide = rates.groupBy("run").agg(*[m.column().alias(f"m{i}") for i, m in enumerate(metrics.values())])
    return wide.select("run", F.inline(F.array(*[F.struct(F.lit(name).alias("metric"), F.col(f"m{i}").alias("value")) for i, name in enumerate(metrics)])))


def summary(values: DataFrame, method: Column, digits: int = 9) -> DataFrame:
    """(metric, method, runs, mean, std, stderr, rank) of (run, metric, value): figures over a method's runs, and the rank of the rounded means within a metric."""
    stats = values.groupBy("metric", method.alias("method")).agg(F.count("*").alias("runs"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    stats = stats.select("metric", "method", "runs", F.round("mean", digits).alias("mean"), F.round("std", digits).alias("std"), F.round(F.col("std") / F.sqrt("runs"), digits).alias("stderr"))
    return stats.withColumn("rank", F.dense_rank().over(Window.partitionBy("metric").orderBy(F.desc("mean"))))  # a row for each method
