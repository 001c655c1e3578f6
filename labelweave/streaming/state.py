"""What a learner knows, kept by batch number in a folder that outlives the process."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

ENTRIES = ("tp", "fp", "fn", "tn")


class LearnerStore:
    """One table (label_id, n, tp, fp, fn, tn) for each batch, a row for each label.

    A batch reads the newest whole version below its own number and writes its own, so a batch that is
    played again after a crash starts from the same state and gives the same rows. The folder has to be on
    storage that all nodes share, such as the stream's checkpoint.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        self._folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._files = self._folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def _sub(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *names)))

    def versions(self) -> list[int]:
        """Numbers of the batches whose state is whole; one that was cut off in writing does not count."""
        if not self._files.exists(self._folder):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(self._folder)]
        return sorted(int(x) for x in names if x.isdigit() and self._files.exists(self._sub(x, "_SUCCESS")))

    def before(self, number: int) -> tuple[int, int, dict[int, list[float]]] | None:
        """(version, rows seen, {label: entries}) of the newest state below `number`."""
        old = [v for v in self.versions() if v < number]
        if not old:
            return None
        rows = self.spark.read.schema("label_id bigint, n bigint, tp double, fp double, fn double, tn double").parquet(f"{self.path}/{old[-1]}").collect()  # a row for each label
        return old[-1], max((r.n for r in rows), default=0), {r.label_id: [r[e] for e in ENTRIES] for r in rows}

    def save(self, number: int, n: int, names: np.ndarray, c: np.ndarray) -> None:
        rows = [(int(j), int(n), *map(float, c[:, i])) for i, j in enumerate(names)]
        self.spark.createDataFrame(rows, "label_id bigint, n bigint, tp double, fp double, fn double, tn double").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{number}")
        for old in [v for v in self.versions() if v < number][: -(self.keep - 1) or None]:
            self._files.delete(self._sub(str(old)), True)


def batches_to(path: str):
    """A sink that writes each batch's predictions to its own folder, over what an earlier try has left there."""

    def sink(found: DataFrame, number: int) -> None:
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return sink
