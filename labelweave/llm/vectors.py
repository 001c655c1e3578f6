"""What the operators on embeddings share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sound(vector: Column) -> Column:
    """True for vectors that have a direction: not null, without null or non-finite components, not zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector array<double>) of the rows with an id and a direction."""
    return rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & sound(F.col("vector")))


def dimensions(own: DataFrame) -> list[int]:
    """The numbers of components that vectors have; vectors of different dimensions have no cosine and are worked on apart."""
    return sorted(r.d for r in own.select(F.size("vector").alias("d")).distinct().collect())


def hashed_sample(rows: DataFrame, most: int, seed: int) -> np.ndarray:
    """At most about `most` vectors (all, if there are no more), chosen by a hash of the vector."""
    n = rows.count()
    part = rows if n <= most else rows.where(F.pmod(F.xxhash64("vector", F.lit(seed)), F.lit(1 << 20)) < int((1 << 20) * most / n))
    found = [r.vector for r in part.select("vector").limit(2 * most).toLocalIterator()]
    return np.array(sorted(found), dtype=np.float64) if found else np.zeros((0, 1))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths, as doubles."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; the largest component goes first so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with the same row of b; a function of the two vectors alone, whatever stands beside them."""
    a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
    return np.clip((a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1)), -1.0, 1.0)


def complete(vector: Column) -> Column:
    """True for vectors without gaps: not null, without null or non-finite components. Zeros and empty vectors are complete."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, finite), F.lit(False))


def steps(column: pa.Array, scale: float, shift: int, most: int) -> np.ndarray:
    """floor(scale * x) + shift for the components of list rows of equal lengths, as int64; beyond `most` either way it stays at `most`."""
    return np.clip(np.floor(matrix(column) * scale), -float(most), float(most)).astype(np.int64) + shift
