"""Population-level optimisation by Frank-Wolfe steps over linear classifiers.

Each iteration is one distributed query over a fixed table of scores and labels (choose labels by the
current weights, sum up hits by label); only two numbers for each label come to the driver, where the
gradient and the line search are vector arithmetic.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelweave.functions.metrics import Combined, Metric
from labelweave.operators.batches import largest, lists, placed, totals
from labelweave.operators.packed import chosen, label_ids, label_sums, packed, with_labels
from labelweave.operators.select import predict
from labelweave.shared import Scratch


@dataclass
class RandomizedClassifier:
    """Linear classifiers (rows of a and b, one column for each label of `labels`) and their probabilities p.

    confusion is the mixture's expected matrix (tp, fp, fn and tn by label, as shares) over the n rows that it was
    found on; `extend` goes on from there.
    """

    k: int
    labels: np.ndarray
    a: np.ndarray
    b: np.ndarray
    p: np.ndarray
    history: list[dict] = field(default_factory=list)
    n: int = 0
    confusion: np.ndarray | None = None

    def __post_init__(self):
        if self.a.shape != self.b.shape or len(self.a) != len(self.p) or self.a.shape[1] != len(self.labels):
            raise ValueError("a, b, p and labels don't fit together")

    def weights(self, spark: SparkSession) -> DataFrame:
        """(classifier_id, label_id, a, b): as many rows as classifiers times labels."""
        rows = [(c, int(j), float(self.a[c, i]), float(self.b[c, i])) for c in range(len(self.p)) for i, j in enumerate(self.labels)]
        return spark.createDataFrame(rows, "classifier_id int, label_id int, a double, b double")

    def mixture(self, spark: SparkSession) -> DataFrame:
        """(classifier_id, p, cum_lo, cum_hi)."""
        high = np.cumsum(self.p) / self.p.sum()
        high[-1] = 1.0
        rows = [(c, float(self.p[c]), float(high[c - 1]) if c else 0.0, float(high[c])) for c in range(len(self.p))]
        return spark.createDataFrame(rows, "classifier_id int, p double, cum_lo double, cum_hi double")

    def predict(self, eta: DataFrame, seed: int = 0, draw: Column | None = None) -> DataFrame:
        """Labels by a classifier that is drawn for each instance; draw is uniform on [0, 1), by default from a hash."""
        spark = eta.sparkSession
        u = (F.pmod(F.xxhash64("instance_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)) if draw is None else draw
        return predict_randomized(eta, self.weights(spark), self.mixture(spark), self.k, u)

    def last(self, eta: DataFrame) -> DataFrame:
        """Labels by the classifier that was found last."""
        return self._fixed(eta, self.a[-1], self.b[-1])

    def averaged(self, eta: DataFrame) -> DataFrame:
        """Labels by one classifier with the mean weights, each classifier's by its probability."""
        p = self.p / self.p.sum()
        return self._fixed(eta, p @ self.a, p @ self.b)

    def _fixed(self, eta: DataFrame, a: np.ndarray, b: np.ndarray) -> DataFrame:
        weights = eta.sparkSession.createDataFrame([(int(j), float(x), float(y)) for j, x, y in zip(self.labels, a, b, strict=True)], "label_id int, a double, b double")
        return predict(eta, self.k, th=0.0, weights=F.broadcast(weights))  # a row for each label

    def expected(self, eta: DataFrame) -> DataFrame:
        """(instance_id, label_id, value): the probability with which each label is chosen."""
        return expected_predictions(eta, self.weights(eta.sparkSession), self.mixture(eta.sparkSession), self.k)


def _side_by_side(eta: DataFrame, weights: DataFrame, mixture: DataFrame) -> tuple[DataFrame, int, list]:
    """(rows, m, mixture's rows): packed rows with all classifiers' weights in two arrays, those of a classifier after another's.

    Weights come from the driver, where a classifier is made, and are sent once: classifiers x labels numbers.
    """
    names, parts = label_ids(weights.select("label_id").distinct()), mixture.orderBy("classifier_id").collect()
    m, place = len(names), {r.classifier_id: i for i, r in enumerate(parts)}
    a, b = np.full((len(parts), m), np.nan), np.full((len(parts), m), np.nan)
    at = {int(j): i for i, j in enumerate(names)}
    for r in weights.select("classifier_id", "label_id", "a", "b").collect():
        if r.classifier_id in place:
            a[place[r.classifier_id], at[r.label_id]], b[place[r.classifier_id], at[r.label_id]] = r.a, r.b
    if np.isnan(a).any() or np.isnan(b).any():
        raise ValueError("each classifier needs the weights of all labels")
    return with_labels(packed(eta, names), a=a.ravel(), b=b.ravel()), m, parts


def _gain(x: Column, classifier: Column, m: int) -> Column:
    at = classifier * m + x["at"]
    return F.get("a", at) * x["eta"] + F.get("b", at)


def predict_randomized(eta: DataFrame, weights: DataFrame, mixture: DataFrame, k: int, draw: Column) -> DataFrame:
    """Labels by the classifier in whose stretch [cum_lo, cum_hi) an instance's draw lies; none where it lies in no stretch."""
    rows, m, parts = _side_by_side(eta, weights, mixture)
    hit = F.array(*[(F.col("u") >= float(r.cum_lo)) & (F.col("u") < float(r.cum_hi)) for r in parts]) if parts else F.array().cast("array<boolean>")
    drawn = rows.withColumn("u", draw).withColumn("classifier", (F.array_position(hit, True) - 1).cast("int")).where("classifier >= 0")
    picked = drawn.select("instance_id", F.inline(chosen(lambda x: _gain(x, F.col("classifier"), m), k)))
    return picked.select("instance_id", "label_id", F.lit(1.0).alias("value"))


def expected_predictions(eta: DataFrame, weights: DataFrame, mixture: DataFrame, k: int) -> DataFrame:
    """(instance_id, label_id, value): the sum of the probabilities of those classifiers that choose a label."""
    rows, m, parts = _side_by_side(eta, weights, mixture)
    each = F.array(*[F.lit(i) for i in range(len(parts))]).cast("array<int>")
    p = F.array(*[F.lit(float(r.p)) for r in parts]).cast("array<double>")
    picked = F.transform(each, lambda c: F.transform(chosen(lambda x: _gain(x, c, m), k), lambda x: x["at"]))
    rows = rows.select("instance_id", "cells", picked.alias("picked"))
    share = lambda x: F.aggregate(each, F.lit(0.0), lambda s, c: s + F.when(F.array_contains(F.get("picked", c), x["at"]), F.get(p, c)).otherwise(0.0))
    cells = F.filter(F.transform("cells", lambda x: F.struct(x["label_id"].alias("label_id"), share(x).alias("value"))), lambda x: x["value"] > 0)
    return rows.select("instance_id", F.inline(cells))


def alpha_values(metric: Metric | Combined, c: np.ndarray, new: np.ndarray, alphas: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The metric at each mixture (1 - alpha) c + alpha new of two confusion matrices."""
    return np.array([metric.value(*((1 - x) * c + x * new), label=label) for x in alphas])


def best_alpha(metric: Metric | Combined, c: np.ndarray, new: np.ndarray, *, maximize: bool = True, algorithm: str = "uniform", step: float = 1e-3, tolerance: float = 1e-3, label: np.ndarray | None = None) -> float:
    """The step towards new in [0, 1) with the best value: a grid (the first of equals), or a ternary search."""
    value = lambda alphas: (1 if maximize else -1) * alpha_values(metric, c, new, alphas, label)
    if algorithm == "uniform":
        grid = np.arange(0, 1, step)
        return float(grid[int(np.argmax(value(grid)))])
    if algorithm != "ternary":
        raise ValueError("algorithm has to be uniform or ternary")
    low, high = 0.0, 1.0
    while high - low > tolerance:
        a, b = low + (high - low) / 3, high - (high - low) / 3
        left, right = value(np.array([a, b]))
        low, high = (a, high) if left < right else (low, b)
    return (low + high) / 2


def linear_weights(metric: Metric | Combined, c: np.ndarray, *, maximize: bool = True, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of the linear classifier a * eta + b that follows the metric's gradient at the confusion matrix c."""
    g, sign = metric.gradient(*c, label=label), 1 if maximize else -1
    return sign * (g[0] - g[1] - g[2] + g[3]), sign * (g[1] - g[3])


def find_classifier(y_true: DataFrame, eta: DataFrame, instances: DataFrame, labels: DataFrame, metric: Metric | Combined, k: int, *, max_iters: int = 100, init: str | tuple[np.ndarray, np.ndarray] = "top", maximize: bool = True, tolerance: float = 1e-6, alpha_tolerance: float = 1e-3, algorithm: str = "uniform", step: float = 1e-3, seed: int = 0) -> RandomizedClassifier:
    """A randomized classifier whose expected confusion matrix is (nearly) optimal for the metric.

    init: top, random, prior, or a pair (a, b). Stops when a step or an improvement is too small. Scores and
    labels are written once, a row for each instance; an iteration is one pass over them, without a shuffle
    but for sums by label.
    """
    scratch, names, n = Scratch(eta.sparkSession), label_ids(labels), instances.count()
    rows = scratch.save(packed(eta, names, y=y_true))
    count = _counter(rows, y_true, names, n, k)

    m = len(names)
    if init == "top":
        a, b = np.ones(m), np.full(m, -0.5)
    elif init == "random":
        rng = np.random.default_rng(seed)
        a, b = rng.random(m), rng.random(m) - 0.5
    elif init == "prior":
        c0 = count(np.ones(m), np.zeros(m))
        a, b = 1 / (c0[0] + c0[2] + 0.1 / n), np.zeros(m)
    else:
        a, b = (np.asarray(x, dtype=float) for x in init)
    c = count(a, b)
    found = RandomizedClassifier(k, names, a[None], b[None], np.ones(1), [{"utility": metric.value(*c, label=names), "alpha": 1.0}], n, c)
    found = _climb(found, count, metric, max_iters=max_iters, maximize=maximize, tolerance=tolerance, alpha_tolerance=alpha_tolerance, algorithm=algorithm, step=step)
    scratch.drop()
    return found


def _counter(rows: DataFrame, y_true: DataFrame, names: np.ndarray, n: int, k: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function that gives a linear classifier's confusion matrix, as shares of n rows, by one pass over packed rows."""
    place, positive = {int(j): i for i, j in enumerate(names)}, np.zeros(len(names))
    for r in y_true.groupBy("label_id").agg(F.sum("value").alias("s")).collect():  # a row for each label
        if r.label_id in place:
            positive[place[r.label_id]] = r.s / n

    def count(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        picked = chosen(lambda x: F.get("a", x["at"]) * x["eta"] + F.get("b", x["at"]), k)
        hit, all_ = label_sums(with_labels(rows, a=a, b=b).select(F.inline(picked)), len(names), F.col("y"), F.lit(1.0)).get(0, np.zeros((2, len(names)))) / n
        return np.array([hit, all_ - hit, positive - hit, 1 - positive - all_ + hit])

    count.positive = positive
    return count


def _climb(found: RandomizedClassifier, count: Callable[[np.ndarray, np.ndarray], np.ndarray], metric: Metric | Combined, *, max_iters: int, maximize: bool, tolerance: float, alpha_tolerance: float, algorithm: str, step: float) -> RandomizedClassifier:
    """Frank-Wolfe steps from a mixture and its confusion matrix, until a step or an improvement is too small."""
    names, c, sign = found.labels, found.confusion, 1 if maximize else -1
    kept_a, kept_b, p, history = list(found.a), list(found.b), list(found.p / found.p.sum()), list(found.history)
    for _ in range(max_iters):
        a, b = linear_weights(metric, c, maximize=maximize, label=names)
        new = count(a, b)
        alpha = best_alpha(metric, c, new, maximize=maximize, algorithm=algorithm, step=step, label=names)
        mixed = (1 - alpha) * c + alpha * new
        gain = sign * (metric.value(*mixed, label=names) - history[-1]["utility"])
        if alpha < alpha_tolerance or gain < tolerance:
            break
        c, p = mixed, [x * (1 - alpha) for x in p] + [alpha]
        kept_a.append(a), kept_b.append(b)
        history.append({"utility": metric.value(*c, label=names), "alpha": alpha})
    return RandomizedClassifier(found.k, names, np.array(kept_a), np.array(kept_b), np.array(p), history, found.n, c)


def extend(found: RandomizedClassifier, y_true: DataFrame, eta: DataFrame, instances: DataFrame, metric: Metric | Combined, *, max_iters: int = 100, maximize: bool = True, tolerance: float = 1e-6, alpha_tolerance: float = 1e-3, algorithm: str = "uniform", step: float = 1e-3, least: float = 1e-4) -> RandomizedClassifier:
    """The mixture carried on over new rows alone; the rows that it was found on are not read again.

    Its expected confusion matrix on the new rows is added to the carried one, weighted by numbers of rows, and
    Frank-Wolfe steps go on from there, with the new rows as the sample on which further classifiers are counted.
    Classifiers whose probability has fallen below `least` are left out. Without new rows nothing changes.
    """
    n, names, k = instances.count(), found.labels, found.k
    if not n:
        return found
    m, keep, scratch = len(names), found.p >= least * found.p.max(), Scratch(eta.sparkSession)
    a, b, p = found.a[keep], found.b[keep], found.p[keep] / found.p[keep].sum()
    rows = scratch.save(packed(eta, names, y=y_true))
    count = _counter(rows, y_true, names, n, k)
    shares = F.array(*[F.lit(float(x)) for x in p])
    each = F.array(*[F.lit(i) for i in range(len(p))])
    picks = F.transform(each, lambda c: F.transform(chosen(lambda x: _gain(x, c, m), k), lambda x: F.struct(x["at"].alias("at"), (x["y"] * F.get(shares, c)).alias("hit"), F.get(shares, c).alias("p"))))
    cells = with_labels(rows, a=a.ravel(), b=b.ravel()).select(F.inline(F.flatten(picks)))
    hit, all_ = label_sums(cells, m, F.col("hit"), F.col("p")).get(0, np.zeros((2, m))) / n
    new = np.array([hit, all_ - hit, count.positive - hit, 1 - count.positive - all_ + hit])
    c = (found.n * found.confusion + n * new) / (found.n + n)
    start = RandomizedClassifier(k, names, a, b, p, [{"utility": metric.value(*c, label=names), "alpha": 1.0}], found.n + n, c)
    out = _climb(start, count, metric, max_iters=max_iters, maximize=maximize, tolerance=tolerance, alpha_tolerance=alpha_tolerance, algorithm=algorithm, step=step)
    scratch.drop()
    return out


def carry_on(found: RandomizedClassifier | None, rows: DataFrame, names: np.ndarray, metric: Metric | Combined, k: int, *, max_iters: int, least: float = 1e-4) -> RandomizedClassifier | None:
    """What `extend` finds, or without a mixture yet `find_classifier`, on stored rows of arrays (label_id, eta, y).

    An iteration is one pass of arrays over the rows given, and the mixture's own matrix one more.
    """
    m = len(names)
    if found is None:
        a, b, p = np.ones((1, m)), np.full((1, m), -0.5), np.ones(1)
    else:
        keep = found.p >= least * found.p.max()
        a, b, p = found.a[keep], found.b[keep], found.p[keep] / found.p[keep].sum()

    def passed(a: np.ndarray, b: np.ndarray, p: np.ndarray) -> tuple[int, np.ndarray]:
        def sums(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
            size, at, eta, y = placed(names, *lists(batch, "label_id", "eta", "y"))
            share, y = np.zeros(len(at)), np.fmax(y, 0)
            for w, x in enumerate(p):
                share += x * largest(a[w][at] * eta + b[w][at], size, k)
            return at, share * y, share, y

        n, (hit, all_, positive) = totals(rows, m, 3, sums).get(0, (0, np.zeros((3, m))))
        hit, all_, positive = (x / max(1, n) for x in (hit, all_, positive))
        return n, np.array([hit, all_ - hit, positive - hit, 1 - positive - all_ + hit])

    n, c = passed(a, b, p)
    if not n:
        return found
    before = 0 if found is None else found.n
    c = c if found is None else (before * found.confusion + n * c) / (before + n)
    start = RandomizedClassifier(k, names, a, b, p, [{"utility": metric.value(*c, label=names), "alpha": 1.0}], before + n, c)
    return _climb(start, lambda a, b: passed(a[None], b[None], np.ones(1))[1], metric, max_iters=max_iters, maximize=True, tolerance=1e-6, alpha_tolerance=1e-3, algorithm="uniform", step=1e-3)


def drawn_labels(found: RandomizedClassifier | None, rows: DataFrame, names: np.ndarray, k: int) -> DataFrame:
    """What `predict` gives, on rows of arrays (instance_id, u, label_id, eta) with u the draw; without a mixture top k, or scores of 0.5 and more."""
    if found is not None:
        a, b, high = found.a, found.b, np.append((np.cumsum(found.p) / found.p.sum())[:-1], 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, label, eta = lists(batch, "label_id", "eta")
            if found is None:
                gain = eta if k > 0 else eta - 0.5
            else:
                size, at, eta, label = placed(names, size, label, eta, label)
                drawn = np.repeat(np.searchsorted(high, batch.column("u").to_numpy(), side="right"), size)
                gain = a[drawn, at] * eta + b[drawn, at]
            taken = largest(gain, size, k)
            row = np.repeat(np.arange(len(size)), size)[taken]
            yield pa.RecordBatch.from_arrays([batch.column("instance_id").take(pa.array(row)), pa.array(label[taken].astype(np.int32)), pa.array(np.ones(len(row)))], names=["instance_id", "label_id", "value"])

    return rows.mapInArrow(run, f"instance_id {rows.schema['instance_id'].dataType.simpleString()}, label_id int, value double")


def systematic_sample(cells: DataFrame, k: int, seed: int = 0, start: Column | None = None, order: Column | None = None) -> DataFrame:
    """(instance_id, label_id, value): k labels of each instance, each with its probability `value`, drawn by one uniform start.

    The probabilities of an instance sum to k. They are laid end to end in the order of a hash, and a label is
    taken if its stretch holds start, start + 1, ... (start in [0, 1) for each instance). `order` is a column that takes
    the hash's place; ties go to smaller labels.
    """
    u = (F.pmod(F.xxhash64("instance_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)) if start is None else start
    order = Window.partitionBy("instance_id").orderBy(F.xxhash64("instance_id", "label_id", F.lit(seed + 1)) if order is None else order, "label_id")
    laid = cells.withColumn("_end", F.sum("value").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_u", u)
    ends = laid.withColumn("_before", F.coalesce(F.lag("_end").over(order), F.lit(0.0)))
    return ends.where(F.ceil(F.round(F.col("_end") - F.col("_u"), 12)) > F.ceil(F.round(F.col("_before") - F.col("_u"), 12))).select("instance_id", "label_id", F.lit(1.0).alias("value"))
