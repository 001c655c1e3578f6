"""Statistics of labels: counts, priors, propensities; and the masks of rare labels."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.functions.metrics import averaged, recall
from labelweave.operators.confusion import confusion
from labelweave.operators.places import placed
from labelweave.operators.select import top_k


def label_counts(y: DataFrame, labels: DataFrame) -> DataFrame:
    """(label_id, count) with a row for every label."""
    return labels.select("label_id").join(y.groupBy("label_id").agg(F.sum("value").alias("count")), "label_id", "left").select("label_id", F.coalesce("count", F.lit(0.0)).alias("count"))


def label_priors(y: DataFrame, labels: DataFrame, instances: DataFrame) -> DataFrame:
    n = instances.agg(F.count("*").cast("double").alias("n"))
    return label_counts(y, labels).crossJoin(F.broadcast(n)).select("label_id", (F.col("count") / F.col("n")).alias("prior"))


def inverse_label_priors(y: DataFrame, labels: DataFrame, instances: DataFrame) -> DataFrame:
    """1 / prior; infinity for labels that are never seen."""
    return label_priors(y, labels, instances).select("label_id", F.when(F.col("prior") > 0, 1 / F.col("prior")).otherwise(float("inf")).alias("inverse_prior"))


def inverse_propensities(y: DataFrame, labels: DataFrame, instances: DataFrame, a: float = 0.55, b: float = 1.5) -> DataFrame:
    """1 + (ln n - 1) (b + 1)^a (count + b)^-a."""
    n = instances.agg(F.count("*").cast("double").alias("n"))
    scale = (F.log("n") - 1) * math.pow(b + 1, a)
    return label_counts(y, labels).crossJoin(F.broadcast(n)).select("label_id", (1 + scale * F.pow(F.col("count") + b, F.lit(-a))).alias("inverse_propensity"))


def propensities(y: DataFrame, labels: DataFrame, instances: DataFrame, a: float = 0.55, b: float = 1.5) -> DataFrame:
    return inverse_propensities(y, labels, instances, a, b).select("label_id", (1 / F.col("inverse_propensity")).alias("propensity"))


def rare_by_prior(priors: DataFrame, percentile: float = 0.5) -> DataFrame:
    """Labels whose prior is at most the given percentile (linear interpolation) of all priors."""
    bound = priors.agg(F.percentile("prior", F.lit(percentile)).alias("bound"))
    return priors.crossJoin(F.broadcast(bound)).where("prior <= bound").select("label_id")


def rare_by_weight(weights: DataFrame, percentile: float = 0.5, column: str = "inverse_propensity") -> DataFrame:
    """Labels whose weight (large for rare labels) is at least the given percentile of all weights."""
    bound = weights.agg(F.percentile(column, F.lit(percentile)).alias("bound"))
    return weights.crossJoin(F.broadcast(bound)).where(F.col(column) >= F.col("bound")).select("label_id")


def most_frequent(priors: DataFrame, share: float) -> DataFrame:
    """The int(share * m) labels with the largest priors, ties to smaller labels."""
    most = int(priors.count() * share)
    return placed(priors.select("label_id", "prior"), F.desc("prior"), F.asc("label_id")).where(F.col("pos") < most).select("label_id")


def restrict(y: DataFrame, labels: DataFrame) -> DataFrame:
    return y.join(labels.select("label_id"), "label_id", "left_semi")


def tail_metric(y_true: DataFrame, y_pred: DataFrame, instances: DataFrame, labels: DataFrame, weights: DataFrame, psi: Callable, *, percentile: float = 0.5, column: str = "inverse_propensity", **options) -> DataFrame:
    """One row with `value`: the mean over instances of a binary metric on each one's counts, where only labels with a weight of
    at least the percentile of all weights count as true; predictions are as they are."""
    tail = restrict(y_true, rare_by_weight(weights, percentile, column))
    return averaged(confusion(tail, y_pred, instances, labels, by="instance_id"), psi, **options)


def tail_recall_at_k(y_true: DataFrame, eta: DataFrame, instances: DataFrame, labels: DataFrame, weights: DataFrame, k: int, *, percentile: float = 0.5) -> DataFrame:
    """One row with `value`: mean recall of the tail's labels by each instance's k largest scores."""
    return tail_metric(y_true, top_k(eta, k), instances, labels, weights, recall, percentile=percentile)


def label_map(*columns: DataFrame) -> DataFrame:
    """(label, label_id): distinct strings of all tables in order, numbered from 0."""
    union = columns[0].select("label")
    for c in columns[1:]:
        union = union.unionByName(c.select("label"))
    return placed(union.distinct(), "label").select("label", F.col("pos").cast("int").alias("label_id"))
