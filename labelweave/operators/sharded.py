"""Frank-Wolfe search for label spaces that are too wide for the driver.

Cells are written once, in blocks of labels; weights, confusion matrices and the classifiers found are tables
with a row for each label. An iteration joins weights to cells, takes the best k of each instance within each
block and then over blocks, and adds up by label. Gradients and the line search run where the labels' rows
are; the driver sees a thousand values of the line search and one probability for each classifier.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave.functions.metrics import Metric
from labelweave.operators.confusion import ENTRIES
from labelweave.operators.select import best
from labelweave.shared import Scratch

#: Labels whose weights are sent to all executors at once, at most; beyond, cells and weights meet by label.
SENT = 2_000_000
SCHEMA = "label_id int, tp double, fp double, fn double, tn double"


@dataclass
class ShardedClassifier:
    """weights (classifier_id, label_id, a, b) is a written table; p has a probability for each classifier."""

    k: int
    weights: DataFrame
    p: list[float]
    history: list[dict] = field(default_factory=list)

    def predict(self, eta: DataFrame, seed: int = 0, draw: Column | None = None) -> DataFrame:
        """Labels by a classifier that is drawn for each instance; cells and weights meet by classifier and label."""
        u = (F.pmod(F.xxhash64("instance_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)) if draw is None else draw
        high = np.cumsum(self.p) / sum(self.p)
        drawn = F.size(F.filter(F.array(*[F.lit(float(h)) for h in high[:-1]]), lambda h: F.col("u") >= h)) if len(high) > 1 else F.lit(0)
        cells = eta.withColumn("u", u).withColumn("classifier_id", drawn.cast("int"))
        gains = cells.join(self.weights, ["classifier_id", "label_id"]).withColumn("gain", F.col("a") * F.col("eta") + F.col("b"))
        return (best(gains, self.k) if self.k > 0 else gains.where("gain >= 0")).select("instance_id", "label_id", F.lit(1.0).alias("value"))


def _best_within_blocks(cells: DataFrame, weights: DataFrame, k: int, m: int) -> DataFrame:
    gains = cells.join(F.broadcast(weights) if m <= SENT else weights, "label_id").withColumn("gain", F.col("a") * F.col("eta") + F.col("b"))
    if k <= 0:
        return gains.where("gain >= 0")
    # the k best of a block can be the only ones of it among the k best of all
    order = F.sort_array(F.collect_list(F.struct((-F.col("gain")).alias("g"), "label_id", "y")))
    part = gains.groupBy("block", "instance_id").agg(F.slice(order, 1, k).alias("top"))
    merged = part.groupBy("instance_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
    return merged.select("instance_id", F.inline("top"))


def _per_label(table: DataFrame, work, schema: str) -> DataFrame:
    """`work` on the arrays of each batch of a table with a row for each label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from work(batch)

    return table.mapInArrow(run, schema)


def weights_at(conf: DataFrame, metric: Metric, m: int, sign: int) -> DataFrame:
    """(label_id, a, b): the linear classifier at the metric's gradient, each label by its own row."""
    constant = (1 - metric.mix) / metric.k

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        names, c = batch.column("label_id").to_numpy(), [batch.column(e).to_numpy() for e in ENTRIES]
        g = metric.gradient(*c, label=names)
        scale = len(names) / m if metric.average == "macro" else 1.0
        g = [(g[0] - constant) * scale + constant, *(x * scale for x in g[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("label_id"), pa.array(sign * (g[0] - g[1] - g[2] + g[3])), pa.array(sign * (g[1] - g[3]))], names=["label_id", "a", "b"])

    return _per_label(conf, work, "label_id int, a double, b double")


def values_between(old: DataFrame, new: DataFrame, metric: Metric, m: int, alphas: np.ndarray) -> np.ndarray:
    """The metric at each mixture (1 - alpha) old + alpha new: batches of labels add up their parts of all of them."""
    both = old.join(new.select("label_id", *[F.col(e).alias(f"new_{e}") for e in ENTRIES]), "label_id")

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        names = batch.column("label_id").to_numpy()
        c, d = (np.array([batch.column(p + e).to_numpy() for e in ENTRIES]) for p in ("", "new_"))
        found = []
        for x in alphas:
            mixed = (1 - x) * c + x * d
            own = float(np.sum(metric.at(*mixed, names)))
            found.append(metric.mix * own / (m if metric.average == "macro" else 1) + (1 - metric.mix) * float(mixed[0].sum()) / metric.k)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(alphas))), pa.array(found)], names=["step", "value"])

    rows = _per_label(both, work, "step bigint, value double").groupBy("step").agg(F.sum("value").alias("value")).orderBy("step").collect()  # one for each alpha
    return np.array([r.value for r in rows])


def find_classifier(y_true: DataFrame, eta: DataFrame, instances: DataFrame, labels: DataFrame, metric: Metric, k: int, *, max_iters: int = 100, maximize: bool = True, tolerance: float = 1e-6, alpha_tolerance: float = 1e-3, step: float = 1e-3, blocks: int = 64, init: DataFrame | None = None) -> ShardedClassifier:
    """What `frank_wolfe.find_classifier` finds by uniform search, for macro averages and sums, with tables in place of arrays.

    init is a table (label_id, a, b), by default top k. Each iteration's tables replace those of the one before; the
    classifiers found stay, as the result's weights.
    """
    if not isinstance(metric, Metric) or metric.average not in ("macro", "sum"):
        raise ValueError("labels can only be worked on apart for macro averages and sums")
    spark, kept, now = eta.sparkSession, Scratch(eta.sparkSession), Scratch(eta.sparkSession)
    n, sign, base = instances.count(), 1 if maximize else -1, Scratch(eta.sparkSession)
    names = base.save(labels.select(F.col("label_id").cast("int")).distinct())
    m = names.count()
    positive = base.save(y_true.groupBy("label_id").agg(F.sum("value").alias("positive")))
    y = y_true.select("instance_id", "label_id", F.col("value").cast("double").alias("y"))
    cells = eta.select("instance_id", F.col("label_id").cast("int"), F.col("eta").cast("double")).join(y, ["instance_id", "label_id"], "left").withColumn("y", F.coalesce("y", F.lit(0.0)))
    block = F.pmod(F.xxhash64("label_id"), F.lit(blocks)).cast("int")
    cells = base.save(cells.withColumn("block", block).repartition("block").sortWithinPartitions("block", "instance_id"))

    def count(weights: DataFrame) -> DataFrame:
        sums = _best_within_blocks(cells, weights, k, m).groupBy("label_id").agg(F.sum("y").alias("hit"), F.count("*").alias("all"))
        full = names.join(sums, "label_id", "left").join(positive, "label_id", "left")
        hit, all_, pos = (F.coalesce(c, F.lit(0.0)) / n for c in ("hit", "all", "positive"))
        return full.select("label_id", hit.alias("tp"), (all_ - hit).alias("fp"), (pos - hit).alias("fn"), (1 - pos - all_ + hit).alias("tn"))

    first = names.select("label_id", F.lit(1.0).alias("a"), F.lit(-0.5).alias("b")) if init is None else init.select(F.col("label_id").cast("int"), "a", "b")
    found = [kept.save(first)]
    c = now.save(count(found[0]))
    history, p = [{"utility": float(values_between(c, c, metric, m, np.zeros(1))[0]), "alpha": 1.0}], [1.0]
    for _ in range(max_iters):
        weights = kept.save(weights_at(c, metric, m, sign))
        new = now.save(count(weights))
        alphas = np.arange(0, 1, step)
        values = values_between(c, new, metric, m, alphas)
        at = int(np.argmax(sign * values))
        gain = sign * (values[at] - history[-1]["utility"])
        if alphas[at] < alpha_tolerance or gain < tolerance:
            break
        x = float(alphas[at])
        mixed = c.join(new.select("label_id", *[F.col(e).alias(f"new_{e}") for e in ENTRIES]), "label_id").select("label_id", *[((1 - x) * F.col(e) + x * F.col(f"new_{e}")).alias(e) for e in ENTRIES])
        c = now.save(mixed)
        now.drop(keep=1)
        found.append(weights)
        p = [q * (1 - x) for q in p] + [x]
        history.append({"utility": float(values[at]), "alpha": x})
    base.drop(), now.drop()
    every = spark.createDataFrame([], "classifier_id int, label_id int, a double, b double")
    for i, w in enumerate(found):
        every = every.unionByName(w.select(F.lit(i).alias("classifier_id"), "label_id", "a", "b"))
    return ShardedClassifier(k, every, p, history)
