"""Score tables with one row for each instance, for algorithms that choose labels again and again.

A row holds its cells as an array, so choosing the best labels is an expression within the row and needs
no shuffle; what is known of each label comes as one broadcast row of arrays.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label_ids(labels: DataFrame) -> np.ndarray:
    """All labels in order: a number for each label on the driver."""
    return np.array([r.label_id for r in labels.select("label_id").orderBy("label_id").collect()], dtype=np.int64)


def cells_in_rows(eta: DataFrame) -> DataFrame:
    """(instance_id, cells): scores with a row for each instance, cells (label_id, eta) in the order of labels; such rows stay as they are."""
    if "cells" in eta.columns:
        return eta
    cells = F.struct("label_id", F.col("eta").cast("double").alias("eta"))
    return eta.groupBy("instance_id").agg(F.sort_array(F.collect_list(cells)).alias("cells"))


def packed(eta: DataFrame, names: np.ndarray, **more: DataFrame) -> DataFrame:
    """(instance_id, cells): cells is an array of (label_id, at, eta, ...) in the order of labels; at is the label's place in names.

    Each of `more` is a table (instance_id, label_id, value) that gives one more number of a cell, 0 if absent.
    """
    places = eta.sparkSession.createDataFrame([(int(j), i) for i, j in enumerate(names)], "label_id int, at int")
    rows = eta.select("instance_id", "label_id", F.col("eta").cast("double").alias("eta")).join(F.broadcast(places), "label_id")  # a row for each label
    for name, table in more.items():
        rows = rows.join(table.select("instance_id", "label_id", F.col("value").cast("double").alias(name)), ["instance_id", "label_id"], "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
    return rows.groupBy("instance_id").agg(F.sort_array(F.collect_list(F.struct("label_id", "at", "eta", *more))).alias("cells"))


def with_labels(rows: DataFrame, **known: np.ndarray) -> DataFrame:
    """Add array columns, the same in each row: one number for each label."""
    one = rows.sparkSession.createDataFrame([tuple(x.tolist() for x in known.values())], ", ".join(f"{k} array<double>" for k in known))
    return rows.crossJoin(F.broadcast(one))  # one row


def chosen(gain: Callable[[Column], Column], k: int) -> Column:
    """The cells with the k largest gains (ties to smaller labels), or with k = 0 those with gain >= 0."""
    if k <= 0:
        return F.filter("cells", lambda c: gain(c) >= 0)
    ordered = F.sort_array(F.transform("cells", lambda c: F.struct((-gain(c)).alias("g"), c["label_id"].alias("label_id"), c.alias("cell"))))
    return F.transform(F.slice(ordered, 1, k), lambda x: x["cell"])


def label_sums(cells: DataFrame, m: int, *sums: Column, by: str | None = None) -> dict[int, np.ndarray]:
    """Sums over exploded cells (at, ...) for each label, as arrays [sums, m]; one for each value of `by`."""
    keys = ["at"] if by is None else [by, "at"]
    out: dict[int, np.ndarray] = {}
    for r in cells.groupBy(*keys).agg(*[F.sum(x).alias(f"s{i}") for i, x in enumerate(sums)]).collect():  # a row for each label
        own = out.setdefault(r[by] if by else 0, np.zeros((len(sums), m)))
        own[:, r["at"]] = [r[f"s{i}"] for i in range(len(sums))]
    return out
