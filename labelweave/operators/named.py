"""The optimizers by the name of what they optimize.

`BLOCK_COORDINATE[name](eta, instances, labels, k, alpha=..., **options)` gives a prediction and its
utilities, `FRANK_WOLFE[name](y_true, eta, instances, labels, k, alpha=..., **options)` a randomized
classifier; `alpha` is the share of the macro part in mixed objectives. `predict_with` finds and predicts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from labelweave.functions.metrics import Combined, Metric
from labelweave.operators import block_coordinate, frank_wolfe

MACRO = ("precision", "recall", "f1", "jaccard", "balanced_accuracy", "hmean", "gmean")
MIXED = "mixed_instance_precision_macro_"


def objective(name: str, k: int, alpha: float = 0.5) -> Metric | Combined:
    """macro_x, micro_x, instance_precision, mixed_instance_precision_macro_x, mixed_macro_recall_macro_precision."""
    if name == "instance_precision":
        return Metric("f1", mix=0.0, k=k)
    if name == "mixed_macro_recall_macro_precision":  # sums over labels, not means
        return Combined(((1 - alpha, Metric("recall", "sum")), (alpha, Metric("precision", "sum"))))
    if name.startswith(MIXED):
        return Metric(name.removeprefix(MIXED), mix=alpha, k=k)
    average, metric = name.split("_", 1)
    return Metric(metric, average)


def _block_coordinate(name: str) -> Callable[..., tuple[DataFrame, list[float]]]:
    def run(eta: DataFrame, instances: DataFrame, labels: DataFrame, k: int, *, alpha: float = 0.5, **options) -> tuple[DataFrame, list[float]]:
        if name == "coverage":
            return block_coordinate.coverage(eta, labels, k, alpha=alpha, **options)
        return block_coordinate.minibatch(eta, instances, labels, objective(name, k, alpha), k, **options)

    run.__name__ = f"block_coordinate_{name}"
    return run


def _frank_wolfe(name: str) -> Callable[..., frank_wolfe.RandomizedClassifier]:
    def run(y_true: DataFrame, eta: DataFrame, instances: DataFrame, labels: DataFrame, k: int, *, alpha: float = 0.5, **options) -> frank_wolfe.RandomizedClassifier:
        return frank_wolfe.find_classifier(y_true, eta, instances, labels, objective(name, k, alpha), k, **options)

    run.__name__ = f"frank_wolfe_{name}"
    return run


BLOCK_COORDINATE = {x: _block_coordinate(x) for x in (*(f"macro_{m}" for m in MACRO), "instance_precision", *(MIXED + m for m in MACRO), "coverage")}
FRANK_WOLFE = {x: _frank_wolfe(x) for x in (*(f"{average}_{m}" for average in ("macro", "micro") for m in MACRO), *(MIXED + m for m in ("precision", "f1", "recall")), "mixed_macro_recall_macro_precision")}


def predict_with(name: str, y_true: DataFrame, eta: DataFrame, new_eta: DataFrame, instances: DataFrame, labels: DataFrame, k: int, *, strategy: str = "randomized", seed: int = 0, **options) -> DataFrame:
    """Find a classifier on (y_true, eta) and predict new_eta: randomized, by the last classifier, or by averaged weights.

    For expected utility, without labels, give eta as y_true: fractions count as labels.
    """
    found = FRANK_WOLFE[name](y_true, eta, instances, labels, k, **options)
    return {"randomized": lambda: found.predict(new_eta, seed), "last": lambda: found.last(new_eta), "averaged": lambda: found.averaged(new_eta)}[strategy]()
