"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.

    Where it is unset, a local session (tests, a laptop) gets a temporary folder; on a cluster that would
    be one machine's disk, so it is an error there.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (context.master.startswith("local") and not context.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="labelweave-"))
    return context.getCheckpointDir()


class Scratch:
    """Intermediate tables in the shared folder: they cut the lineage and outlive lost executors.

    Results are lazy and read these tables, so whoever has written a result drops them: each by its own
    `drop`, or all that were made since a `mark` by `drop_since`.
    """

    made: list[Scratch] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.kept = spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}", []
        Scratch.made.append(self)

    def save(self, df: DataFrame, partitions: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
        path = f"{self.root}/{len(self.kept)}"
        self.kept.append(path)
        (df.coalesce(partitions) if partitions else df).write.partitionBy(*by).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *, keep: int = 0) -> None:
        """Delete all tables but the last `keep` ones."""
        for path in self.kept[: len(self.kept) - keep]:
            if path:
                self._delete(path)
        self.kept = [None] * (len(self.kept) - keep) + self.kept[len(self.kept) - keep :]

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    @classmethod
    def mark(cls) -> int:
        return len(cls.made)

    @classmethod
    def drop_since(cls, mark: int, *, but: Scratch | None = None) -> None:
        """Delete the tables of every Scratch made since the mark, except one."""
        for own in [x for x in cls.made[mark:] if x is not but]:
            own.drop()
        cls.made[mark:] = [x for x in cls.made[mark:] if x is but]
