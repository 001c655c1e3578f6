"""Confusion matrices of sparse (instance_id, label_id, value) tables, by label or by instance."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTRIES = ("tp", "fp", "fn", "tn")


def confusion(y_true: DataFrame, y_pred: DataFrame, instances: DataFrame, labels: DataFrame, *, by: str = "label_id", normalize: bool = False, skip_tn: bool = False) -> DataFrame:
    """(by, tp, fp, fn, tn) for every row of the dimension, all-zero ones included.

    Values may be fractions. One union and two aggregations, both with partial sums before the shuffle:
    fp and fn follow from the sums. tn is what is left of the other dimension's size, by which
    normalize divides; with skip_tn it is -1.
    """
    if by not in ("label_id", "instance_id"):
        raise ValueError("by has to be label_id or instance_id")
    keys = ("instance_id", "label_id")
    both = y_true.select(*keys, F.col("value").cast("double").alias("t"), F.lit(0.0).alias("p")).unionByName(y_pred.select(*keys, F.lit(0.0).alias("t"), F.col("value").cast("double").alias("p")))
    cells = both.groupBy(*keys).agg(F.sum("t").alias("t"), F.sum("p").alias("p"))
    sums = cells.groupBy(by).agg(F.sum(F.col("t") * F.col("p")).alias("tp"), F.sum("t").alias("t"), F.sum("p").alias("p"))
    dimension, other = (labels, instances) if by == "label_id" else (instances, labels)
    size = other.agg(F.count("*").cast("double").alias("n"))
    full = dimension.select(by).join(sums, by, "left").crossJoin(F.broadcast(size))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    full = full.select(by, "n", zero("tp").alias("tp"), (zero("p") - zero("tp")).alias("fp"), (zero("t") - zero("tp")).alias("fn"))
    out = full.select(by, "n", "tp", "fp", "fn", (F.lit(-1.0) if skip_tn else F.col("n") - F.col("tp") - F.col("fp") - F.col("fn")).alias("tn"))
    scaled: dict[str, Column] = {c: F.col(c) / F.col("n") if normalize and not (skip_tn and c == "tn") else F.col(c) for c in ENTRIES}
    return out.select(by, *[x.alias(c) for c, x in scaled.items()])


@dataclass
class ConfusionMatrix:
    """Arithmetic on confusion tables that share a key."""

    df: DataFrame

    @property
    def key(self) -> str:
        return self.df.columns[0]

    def _with(self, other, f) -> ConfusionMatrix:
        if isinstance(other, ConfusionMatrix):
            right = other.df.select(self.key, *[F.col(c).alias(f"other_{c}") for c in ENTRIES])
            joined = self.df.join(right, self.key)
            return ConfusionMatrix(joined.select(self.key, *[f(F.col(c), F.col(f"other_{c}")).alias(c) for c in ENTRIES]))
        return ConfusionMatrix(self.df.select(self.key, *[f(F.col(c), F.lit(float(other))).alias(c) for c in ENTRIES]))

    def __add__(self, other):
        return self._with(other, lambda a, b: a + b)

    def __sub__(self, other):
        return self._with(other, lambda a, b: a - b)

    def __mul__(self, other):
        return self._with(other, lambda a, b: a * b)

    __rmul__ = __mul__

    def __truediv__(self, other):
        return self._with(other, lambda a, b: F.when(b != 0, a / b))

    def __floordiv__(self, other):
        return self._with(other, lambda a, b: F.when(b != 0, F.floor(a / b).cast("double")))

    def normalize(self) -> ConfusionMatrix:
        total = sum((F.col(c) for c in ENTRIES[1:]), F.col(ENTRIES[0]))
        return ConfusionMatrix(self.df.select(self.key, *[F.when(total != 0, F.col(c) / total).otherwise(0.0).alias(c) for c in ENTRIES]))

    def equals(self, other: ConfusionMatrix) -> bool:
        return self.df.exceptAll(other.df).isEmpty() and other.df.exceptAll(self.df).isEmpty()


def log_product(cells: DataFrame, by: str, value: Column, *, miss: bool = True) -> DataFrame:
    """(by, log_product): logarithm of the product over each group of 1 - value, or of value if miss is false; a factor of 0 counts as 1e-12."""
    factor = F.log1p(-F.least(value, F.lit(1 - 1e-12))) if miss else F.log(F.greatest(value, F.lit(1e-12)))
    return cells.groupBy(by).agg(F.sum(factor).alias("log_product"))


def product(cells: DataFrame, by: str, value: Column, *, miss: bool = True) -> DataFrame:
    """(by, product): the product of 1 - value, or of value, over each group."""
    return cells.groupBy(by).agg(F.product(1 - value if miss else value).alias("product"))


def constant(cells: DataFrame, value: float) -> DataFrame:
    """The same cells with one value: zeros or ones like a matrix."""
    return cells.select("instance_id", "label_id", F.lit(float(value)).alias("value"))


def nonzero(cells: DataFrame, column: str = "value") -> DataFrame:
    return cells.where(F.col(column) != 0)


def one_hot(classes: DataFrame, column: str = "class_id") -> DataFrame:
    """(instance_id, label_id, value) of rows with one class each; a null class gives no label."""
    return classes.where(F.col(column).isNotNull()).select("instance_id", F.col(column).cast("int").alias("label_id"), F.lit(1.0).alias("value"))


def aligned(*labels: DataFrame) -> DataFrame:
    """The label dimension that matrices of different widths share: every label of any of them."""
    return functools.reduce(DataFrame.unionByName, [x.select("label_id") for x in labels]).distinct()


def beside(first: DataFrame, second: DataFrame, offset: int) -> DataFrame:
    """Columns of both matrices for the same instances; labels of the second are numbered from `offset` on."""
    return first.unionByName(second.withColumn("label_id", (F.col("label_id") + offset).cast("int")))


def mean_positive_labels(y: DataFrame, instances: DataFrame) -> DataFrame:
    """One row with `value`: labels of an instance on average, those without any included."""
    n = instances.agg(F.count("*").cast("double").alias("n"))
    return y.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("s")).crossJoin(n).select((F.col("s") / F.col("n")).alias("value"))


def stack(first: DataFrame, second: DataFrame, offset: int) -> DataFrame:
    """Rows of both matrices; instances of the second are numbered from `offset` on."""
    return first.unionByName(second.withColumn("instance_id", F.col("instance_id") + offset))


def split(rows: DataFrame, share: float, seed: int = 0, draw: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of about `share` of all instances, and the rest, by a hash of the instance."""
    u = F.pmod(F.xxhash64("instance_id", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20) if draw is None else draw
    return rows.where(u < share), rows.where(u >= share)
