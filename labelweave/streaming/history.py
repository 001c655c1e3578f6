"""The value of a metric over time, as a prediction's confusion matrix grows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelweave.functions.metrics import Metric

COUNTS = ("tp", "fp", "fn", "tn")


def prequential_metric(cells: DataFrame, labels: DataFrame, metric: Metric, *, instances: DataFrame | None = None, by: str = "instance_id", every: int = 100, wide: int = 1000) -> DataFrame:
    """(position, n, value): the metric of all rows up to and with each block of `every`.

    cells are (instance_id, label_id, y, p): labels and predictions, from 0 to 1, of cells where either is not 0
    (others may be there). Rows of a block have one floor(by / every); `instances` (instance_id, by) lists rows
    that may have no cells, by default those that have some. Blocks without rows have no position.

    Sums of each label run over groups of `wide` blocks, then over the blocks of a group, and only then is the
    metric taken, so no window holds more than one label's groups or one group's blocks.
    """
    block = F.floor(F.col(by) / every).alias("block")
    y, p = F.col("y").cast("double"), F.col("p").cast("double")
    steps = cells.groupBy("label_id", block).agg(F.sum(y * p).alias("tp"), F.sum((1 - y) * p).alias("fp"), F.sum(y * (1 - p)).alias("fn"))
    rows = (cells if instances is None else instances).select(*dict.fromkeys(("instance_id", by))).distinct()
    sizes = rows.groupBy(block).agg(F.count("*").cast("double").alias("n"))
    group = F.floor(F.col("block") / wide)

    def running(found: DataFrame, keys: list[str], sums: tuple[str, ...]) -> DataFrame:
        """found with sums over all earlier blocks and its own; a group's total goes to later groups."""
        found = found.withColumn("group", group)
        totals = found.groupBy(*keys, "group").agg(*[F.sum(c).alias(c) for c in sums])
        earlier = Window.partitionBy(*keys).orderBy("group").rowsBetween(Window.unboundedPreceding, -1)  # at most one row for each group
        totals = totals.select(*keys, "group", *[F.coalesce(F.sum(c).over(earlier), F.lit(0.0)).alias(f"{c}_before") for c in sums])
        own = Window.partitionBy(*keys, "group").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
        return found.select(*keys, "group", "block", *[F.sum(c).over(own).alias(c) for c in sums]).join(totals, [*keys, "group"]).select(*keys, "block", *[(F.col(c) + F.col(f"{c}_before")).alias(c) for c in sums])

    blocks = running(sizes.withColumn("all", F.lit(0)), ["all"], ("n",)).select("block", "n")  # a row for each block
    grid = blocks.select("block").crossJoin(F.broadcast(labels.select("label_id")))  # labels: as many as the confusion matrix has
    dense = grid.join(steps, ["block", "label_id"], "left").select("label_id", "block", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in COUNTS[:3]])
    conf = running(dense, ["label_id"], COUNTS[:3]).join(blocks, "block")
    n = F.col("n")
    rates = conf.select("block", "label_id", "n", *[(F.col(c) / n).alias(c) for c in COUNTS[:3]], ((n - F.col("tp") - F.col("fp") - F.col("fn")) / n).alias("tn"))
    return rates.groupBy("block").agg(F.first("n").cast("bigint").alias("n"), metric.column().alias("value")).withColumnRenamed("block", "position")
