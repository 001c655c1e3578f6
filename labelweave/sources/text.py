"""Readers and writers of multi-label text formats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _numbered(spark: SparkSession, path: str, header: bool) -> DataFrame:
    """(instance_id, line) of one text file in order: lines are numbered within partitions, and partitions' sizes added up."""
    rows = spark.read.text(path).withColumn("_id", F.monotonically_increasing_id())
    rows = rows.select(F.shiftrightunsigned("_id", 33).alias("part"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("at"), F.col("value").alias("line"))
    sizes = rows.groupBy("part").count().orderBy("part").collect()  # a row for each input partition
    starts, total = [], 0
    for r in sizes:
        starts.append((r.part, total))
        total += r["count"]
    offsets = spark.createDataFrame(starts or [(0, 0)], "part bigint, start bigint")
    out = rows.join(F.broadcast(offsets), "part").select((F.col("start") + F.col("at") - int(header)).alias("instance_id"), "line")
    return out.where("instance_id >= 0")


def read_labels(spark: SparkSession, path: str, *, header: bool = True, delimiter: str = ",", features_after: str = " ", label_map: DataFrame | None = None) -> DataFrame:
    """(instance_id, label_id, value) of lines `l1,l2,... f:v ...`; a line may have no labels. label_map (label, label_id) numbers strings."""
    first = F.split("line", features_after, 2)[0]
    labels = _numbered(spark, path, header).select("instance_id", F.explode(F.split(first, delimiter)).alias("label")).select("instance_id", F.trim("label").alias("label"))
    labels = labels.where((F.col("label") != "") & ~F.col("label").contains(":"))
    if label_map is not None:
        return labels.join(label_map, "label").select("instance_id", "label_id", F.lit(1.0).alias("value"))
    return labels.select("instance_id", F.col("label").cast("int").alias("label_id"), F.lit(1.0).alias("value"))


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """(instance_id, label_id, eta) of lines `label:score label:score ...`."""
    cells = _numbered(spark, path, False).select("instance_id", F.explode(F.split(F.trim("line"), r"\s+")).alias("cell")).where("cell <> ''")
    pair = F.split("cell", ":")
    return cells.select("instance_id", pair[0].cast("int").alias("label_id"), pair[1].cast("double").alias("eta"))


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """(label_id, a) of a file with one number a line."""
    return _numbered(spark, path, False).select(F.col("instance_id").cast("int").alias("label_id"), F.trim("line").cast("double").alias("a"))


def write_weights(weights: DataFrame, path: str, column: str = "a") -> None:
    """One number a line, in the order of labels; the largest is capped at the second largest."""
    top = [r[0] for r in weights.select(column).distinct().orderBy(F.desc(column)).limit(2).collect()]
    value = F.least(F.col(column), F.lit(top[-1])) if top else F.col(column)
    weights.repartitionByRange(1, "label_id").sortWithinPartitions("label_id").select(value.cast("string").alias("value")).write.text(path)


def from_arrays(rows: DataFrame, labels: str = "labels", scores: str = "scores") -> DataFrame:
    """(instance_id, label_id, eta) of rows with an array of labels and one of scores, side by side."""
    return rows.select("instance_id", F.inline(F.arrays_zip(F.col(labels).alias("label_id"), F.col(scores).alias("eta"))))


def from_dense(rows: DataFrame, column: str, k: int = 0) -> DataFrame:
    """(instance_id, label_id, eta) of an array of all scores; with k > 0 of its k largest."""
    cells = rows.select("instance_id", F.posexplode(column).alias("label_id", "eta"))
    if k <= 0:
        return cells
    from labelweave.operators.select import best

    return best(cells, k, by="eta").select("instance_id", "label_id", "eta")


def pack(cells: DataFrame, column: str = "value") -> DataFrame:
    """One row for each instance: its cells sorted by label."""
    return cells.groupBy("instance_id").agg(F.sort_array(F.collect_list(F.struct("label_id", F.col(column).alias("value")))).alias("cells"))


def unpack(rows: DataFrame) -> DataFrame:
    return rows.select("instance_id", F.inline("cells"))


def write_results(results: DataFrame, path: str) -> None:
    """One JSON object a line."""
    results.write.json(path)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def labels_from_arrays(rows: DataFrame, labels: str = "labels") -> DataFrame:
    """(instance_id, label_id, value) of rows with an array of labels; empty and null arrays give no labels."""
    return rows.select("instance_id", F.explode(F.col(labels).cast("array<int>")).alias("label_id"), F.lit(1.0).alias("value")).dropDuplicates(["instance_id", "label_id"])


def read_libsvm(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Labels (instance_id, label_id, value) and features (instance_id, feature_id, value) of lines `l1,l2 f:v f:v`; comments after # are left out."""
    lines = _numbered(spark, path, False).select("instance_id", F.trim(F.regexp_replace("line", "#.*", "")).alias("line")).where("line <> ''")
    words = F.split("line", r"\s+")
    first = F.when(words[0].contains(":"), F.array().cast("array<string>")).otherwise(F.split(words[0], ","))
    y = lines.select("instance_id", F.explode(first).alias("label")).where("label <> ''")
    cells = lines.select("instance_id", F.explode(F.filter(words, lambda w: w.contains(":"))).alias("cell"))
    pair = F.split("cell", ":")
    return y.select("instance_id", F.col("label").cast("double").cast("int").alias("label_id"), F.lit(1.0).alias("value")), cells.select("instance_id", pair[0].cast("int").alias("feature_id"), pair[1].cast("double").alias("value"))


def load_or_create(spark: SparkSession, path: str, create: Callable[[], DataFrame]) -> DataFrame:
    """The table at path; if there is none yet, what `create` gives is written there first."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        create().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
