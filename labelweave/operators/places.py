"""Places in a total order, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave.shared import Scratch


def placed(rows: DataFrame, *order: Column | str, name: str = "pos") -> DataFrame:
    """rows with their place in the order, from 0; `order` has to tell all rows apart, else equal ones stand in any order.

    Rows are sorted over all partitions and written once; only the partitions' sizes are counted on the driver.
    """
    scratch = Scratch(rows.sparkSession)
    saved = scratch.save(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()))
    part, within = F.shiftright("_place", 33).cast("int"), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    before, starts = 0, []
    for r in saved.groupBy(part.alias("part")).count().orderBy("part").collect():  # a row for each partition
        starts.append((r.part, before))
        before += r["count"]
    known = rows.sparkSession.createDataFrame(starts, "_part int, _before bigint")
    return saved.withColumn("_part", part).join(F.broadcast(known), "_part").select(*rows.columns, (within + F.col("_before")).alias(name))
