"""Metrics of confusion counts, their gradients, and the four ways to average them.

A binary metric is a function of (tp, fp, fn, tn) written with operators that Spark columns and NumPy
arrays share, so one body gives a native expression in queries and fast vectors in kernels.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EPSILON = 1e-9
#: Step of differences where a closed-form gradient isn't finite.
STEP = 1e-4


def _ratio(a, b):
    """a / b, and 0 where both are 0."""
    if isinstance(b, Column):
        return F.when(b != 0, a / b).otherwise(F.lit(0.0))
    b = np.asarray(b, dtype=float)
    return np.divide(a, b, out=np.zeros(np.broadcast(a, b).shape), where=b != 0)


def accuracy(tp, fp, fn, tn, normalize=True):
    return (tp + tn) / (tp + fp + fn + tn) if normalize else tp + tn


def zero_one_loss(tp, fp, fn, tn, normalize=True):
    return (fp + fn) / (tp + fp + fn + tn) if normalize else fp + fn


def precision(tp, fp, fn, tn, epsilon=EPSILON):
    return tp / (tp + fp + epsilon)


def recall(tp, fp, fn, tn, epsilon=EPSILON):
    return tp / (tp + fn + epsilon)


def fbeta(tp, fp, fn, tn, beta=1.0, epsilon=EPSILON):
    b = beta * beta
    return (1 + b) * tp / (b * (tp + fp) + tp + fn + epsilon)


def f1(tp, fp, fn, tn, epsilon=EPSILON):
    return fbeta(tp, fp, fn, tn, 1.0, epsilon)


def jaccard(tp, fp, fn, tn, epsilon=EPSILON):
    return tp / (tp + fp + fn + epsilon)


def _rates(tp, fp, fn, tn, epsilon):
    return tp / (tp + fn + epsilon), tn / (tn + fp + epsilon)


def balanced_accuracy(tp, fp, fn, tn, epsilon=EPSILON):
    r, s = _rates(tp, fp, fn, tn, epsilon)
    return (r + s) / 2


def gmean(tp, fp, fn, tn, epsilon=EPSILON):
    r, s = _rates(tp, fp, fn, tn, epsilon)
    return (r * s) ** 0.5


def hmean(tp, fp, fn, tn, epsilon=EPSILON):
    r, s = _rates(tp, fp, fn, tn, epsilon)
    return _ratio(2 * r * s, r + s)


def min_tp_tn(tp, fp, fn, tn):
    return F.least(tp, tn) if isinstance(tp, Column) else np.minimum(tp, tn)


def precision_at_k(tp, fp, fn, tn, k=1):
    return tp / k


def weighted_precision_at_k(tp, fp, fn, tn, k=1, w=1.0):
    return w * tp / k


#: Binary metrics by name, and those that read tn.
BINARY: dict[str, Callable] = {"accuracy": accuracy, "zero_one_loss": zero_one_loss, "precision": precision, "recall": recall, "fbeta": fbeta, "f1": f1, "jaccard": jaccard, "balanced_accuracy": balanced_accuracy, "gmean": gmean, "hmean": hmean, "min_tp_tn": min_tp_tn}
NEEDS_TN = {"accuracy", "zero_one_loss", "balanced_accuracy", "gmean", "hmean", "min_tp_tn"}


def gradient(name: str, tp, fp, fn, tn, *, epsilon=EPSILON, beta=1.0, k=1):
    """Partial derivatives of a binary metric by tp, fp, fn and tn (arrays).

    Where one isn't finite (a root at 0, 0 / 0), the slope over a step of STEP takes its place, so a label
    without a true positive is still drawn towards one.
    """
    tp, fp, fn, tn = (np.asarray(x, dtype=float) for x in (tp, fp, fn, tn))
    zero = np.zeros_like(tp)
    with np.errstate(all="ignore"):
        p, n = tp + fn + epsilon, tn + fp + epsilon
        r, s = tp / p, tn / n
        if name == "precision":
            d = tp + fp + epsilon
            out = (fp + epsilon) / d**2, -tp / d**2, zero, zero
        elif name == "recall":
            out = (fn + epsilon) / p**2, zero, -tp / p**2, zero
        elif name in ("f1", "fbeta"):
            b = 1.0 if name == "f1" else beta * beta
            d = b * (tp + fp) + tp + fn + epsilon
            out = (1 + b) * (b * fp + fn + epsilon) / d**2, -(1 + b) * b * tp / d**2, -(1 + b) * tp / d**2, zero
        elif name == "jaccard":
            d = tp + fp + fn + epsilon
            out = (fp + fn + epsilon) / d**2, -tp / d**2, -tp / d**2, zero
        elif name == "balanced_accuracy":
            out = (fn + epsilon) / p**2 / 2, -tn / n**2 / 2, -tp / p**2 / 2, (fp + epsilon) / n**2 / 2
        elif name == "gmean":
            a, b = np.sqrt(s / r) / 2, np.sqrt(r / s) / 2
            out = a * (fn + epsilon) / p**2, -b * tn / n**2, -a * tp / p**2, b * (fp + epsilon) / n**2
        elif name == "hmean":
            u, v = 2 * s**2 / (r + s) ** 2, 2 * r**2 / (r + s) ** 2
            out = u * (fn + epsilon) / p**2, -v * tn / n**2, -u * tp / p**2, v * (fp + epsilon) / n**2
        elif name == "precision_at_k":
            out = zero + 1 / k, zero, zero, zero
        else:
            raise KeyError(f"no closed-form gradient of {name}")
    out = [np.array(np.broadcast_to(g, tp.shape), dtype=float) for g in out]
    if not all(np.isfinite(g).all() for g in out):
        options = {"epsilon": epsilon} | ({"beta": beta} if name == "fbeta" else {})
        for i, g in enumerate(out):
            moved = [tp, fp, fn, tn]
            moved[i] = moved[i] + STEP
            slope = (BINARY[name](*moved, **options) - BINARY[name](tp, fp, fn, tn, **options)) / STEP
            out[i] = np.where(np.isfinite(g), g, np.where(np.isfinite(slope), slope, 0.0))
    return tuple(out)


@dataclass(frozen=True)
class Metric:
    """A metric of a whole label-wise confusion matrix: macro or micro average, or sum, of a binary one, or a mix with precision at k.

    value = (1 - mix) * sum(tp) / k + mix * average; mix 1 is the average alone. name is one of BINARY, or a
    function of (tp, fp, fn, tn) that works on columns and on arrays, or a dict {label_id: function} with a
    metric of its own for each label (macro or sum only).
    """

    name: str | Callable | dict[int, Callable]
    average: str = "macro"
    mix: float = 1.0
    k: int = 1
    epsilon: float = EPSILON
    beta: float = 1.0

    @property
    def psi(self) -> Callable:
        if callable(self.name):
            return self.name
        options = {"epsilon": self.epsilon} if self.name not in ("accuracy", "zero_one_loss", "min_tp_tn") else {}
        return functools.partial(BINARY[self.name], **options | ({"beta": self.beta} if self.name == "fbeta" else {}))

    def at(self, tp, fp, fn, tn, label=None):
        """The binary metric of each label; label holds their ids (a column or an array), which only a dict of metrics reads."""
        if not isinstance(self.name, dict):
            return self.psi(tp, fp, fn, tn)
        if isinstance(tp, Column):
            out = None
            for f in dict.fromkeys(self.name.values()):  # a branch for each metric, whatever the number of labels
                own, value = label.isin([j for j, g in self.name.items() if g is f]), f(tp, fp, fn, tn)
                out = F.when(own, value) if out is None else out.when(own, value)
            return out
        c, label = [np.broadcast_to(np.asarray(x, dtype=float), np.shape(label)) for x in (tp, fp, fn, tn)], np.asarray(label)
        out = np.full(label.shape, np.nan)
        for f in set(self.name.values()):
            own = np.isin(label, [j for j, g in self.name.items() if g is f])
            out[own] = f(*(x[own] for x in c))
        return out

    @property
    def needs_tn(self) -> bool:
        return not isinstance(self.name, str) or self.name in NEEDS_TN

    def value(self, tp, fp, fn, tn, label=None) -> float:
        c = [np.asarray(x, dtype=float) for x in (tp, fp, fn, tn)]
        own = float(self.psi(*(x.sum() for x in c))) if self.average == "micro" else float((np.mean if self.average == "macro" else np.sum)(self.at(*c, label)))
        return self.mix * own + ((1 - self.mix) * float(c[0].sum()) / self.k if self.mix != 1 else 0.0)

    def gradient(self, tp, fp, fn, tn, label=None):
        c = [np.asarray(x, dtype=float) for x in (tp, fp, fn, tn)]
        at = [x.sum() for x in c] if self.average == "micro" else c
        try:
            own = gradient(self.name, *at, epsilon=self.epsilon, beta=self.beta) if isinstance(self.name, str) else self._differences(at, label)
        except KeyError:
            own = self._differences(at, label)
        scale = 1 / len(c[0]) if self.average == "macro" else 1.0
        out = [self.mix * scale * np.broadcast_to(g, c[0].shape) for g in own]
        return [out[0] + (1 - self.mix) / self.k, *out[1:]]

    def _differences(self, c, label=None, h=1e-6):
        """Central differences, one-sided at 0."""
        out = []
        for i in range(4):
            up, down = list(c), list(c)
            up[i], down[i] = c[i] + h, np.maximum(c[i] - h, 0)
            out.append((self.at(*up, label) - self.at(*down, label)) / (up[i] - down[i]))
        return out

    def column(self) -> Column:
        """The metric as an aggregate over a table with label_id, tp, fp, fn and tn."""
        c = [F.col(x) for x in ("tp", "fp", "fn", "tn")]
        own = self.psi(*(F.sum(x) for x in c)) if self.average == "micro" else (F.avg if self.average == "macro" else F.sum)(self.at(*c, F.col("label_id")))
        return own if self.mix == 1 else self.mix * own + (1 - self.mix) * F.sum("tp") / self.k


@dataclass(frozen=True)
class Combined:
    """A weighted sum of metrics, such as macro recall and macro precision together."""

    parts: tuple[tuple[float, Metric], ...]

    def value(self, *c, label=None) -> float:
        return sum(w * x.value(*c, label) for w, x in self.parts)

    def gradient(self, *c, label=None):
        each = [[w * g for g in x.gradient(*c, label)] for w, x in self.parts]
        return [sum(g) for g in zip(*each, strict=True)]

    def column(self) -> Column:
        return functools.reduce(lambda a, b: a + b, [w * x.column() for w, x in self.parts])


def averaged(conf: DataFrame, psi: Callable, average: str = "macro", **options) -> DataFrame:
    """One row with `value`: macro (mean of a metric over rows), sum, or micro (metric of the sums)."""
    c = [F.col(x) for x in ("tp", "fp", "fn", "tn")]
    value = {"macro": lambda: F.avg(psi(*c, **options)), "sum": lambda: F.sum(psi(*c, **options)), "micro": lambda: psi(*(F.sum(x) for x in c), **options)}[average]()
    return conf.agg(value.alias("value"))


def per_row(conf: DataFrame, psi: Callable, **options) -> DataFrame:
    """The confusion matrix's key and the metric of each row."""
    key = conf.columns[0]
    return conf.select(key, psi(*(F.col(x) for x in ("tp", "fp", "fn", "tn")), **options).alias("value"))


def hits(conf: DataFrame) -> DataFrame:
    """Share of rows with a true positive: coverage of labels, or of instances (abandonment)."""
    return conf.agg(F.avg((F.col("tp") > 0).cast("double")).alias("value"))


def across_labels(conf: DataFrame, kind: str, epsilon: float = EPSILON) -> DataFrame:
    """One row with `value`, of the labels' recalls r: hmean (m / sum(1 / r)), gmean (exp of the mean logarithm), log_gmean, qmean (1 - root of the mean squared 1 - r)."""
    r = (F.col("tp") + epsilon) / (F.col("tp") + F.col("fn") + epsilon)
    value = {"hmean": F.count("*") / F.sum(1 / r), "gmean": F.exp(F.avg(F.log(r))), "log_gmean": F.avg(F.log(r)), "qmean": 1 - F.sqrt(F.avg(F.pow(1 - r, 2)))}[kind]
    return conf.agg(value.alias("value"))


def of_sums(t: Column, q: Column, p: Column, kind: str, epsilon: float = EPSILON, beta: float = 1.0) -> Column:
    """Metrics of the shares t of true, q of predicted and p of actual positives; q and p count as epsilon at least."""
    q, p = F.greatest(q, F.lit(epsilon)), F.greatest(p, F.lit(epsilon))
    return {"precision": lambda: t / q, "recall": lambda: t / p, "fbeta": lambda: (1 + beta**2) * t / (beta**2 * q + p), "abandonment": lambda: (t > 0).cast("double"), "balanced_accuracy": lambda: (t / p + (1 - q - p + t) / F.greatest(1 - p, F.lit(epsilon))) / 2}[kind]()


def log_loss(grid: DataFrame, epsilon: float = 1e-6) -> DataFrame:
    """One row with `value`: mean logarithmic loss of scores eta, cut to [epsilon, 1 - epsilon], for labels y."""
    p = clipped(F.col("eta"), epsilon)
    return grid.agg(F.avg(-(F.col("y") * F.log(p) + (1 - F.col("y")) * F.log(1 - p))).alias("value"))


def clipped(eta: Column, epsilon: float = 1e-6) -> Column:
    return F.greatest(F.least(eta, F.lit(1 - epsilon)), F.lit(epsilon))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def summarize(results: DataFrame, digits: int = 9) -> DataFrame:
    """(method, mean, std, stderr, rank) of results (method, seed, v): figures over seeds, and the rank of the rounded means."""
    stats = results.groupBy("method").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), (F.stddev_pop("v") / F.sqrt(F.count("*"))).alias("stderr"))
    stats = stats.select("method", *[F.round(c, digits).alias(c) for c in ("mean", "std", "stderr")])
    return stats.withColumn("rank", F.dense_rank().over(Window.orderBy(F.desc("mean"))))  # a row for each method
