"""Whitening of embeddings from an exact covariance.

Components are integers, so sums of products are too. A partition multiplies its vectors modulo several
primes, where products of whole blocks stay exact in doubles and run as plain matrix products; residues are
added by a grouped shuffle, and Chinese remainders give the scatter matrix exactly. It is centred in
integers, and only then turned into doubles for the eigenvectors. What reaches the driver depends on the
number of dimensions alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.llm.common import table
from labelweave.llm.vectors import complete, steps

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Rows of a block: its sums of products of residues below 2**21 stay below 2**53.
BLOCK = 1 << 11
MOST = 1 << 60


def primes(product: int, below: int = 1 << 21) -> list[int]:
    """The largest primes under `below` whose product exceeds the given one."""
    out, total, n = [], 1, below
    while total <= product:
        n -= 1
        if all(n % k for k in range(2, math.isqrt(n) + 1)):
            out.append(n)
            total *= n
    return out


def from_residues(residues: np.ndarray, moduli: list[int]) -> np.ndarray:
    """Exact integers of either sign (as objects) from their residues, a row for each modulus."""
    whole, out = math.prod(moduli), 0
    for row, p in zip(residues, moduli, strict=True):
        rest = whole // p
        out = out + row.astype(object) * (rest * pow(rest, -1, p))
    out = out % whole
    return np.where(out > whole // 2, out - whole, out)


@dataclass
class Whitening:
    """n vectors, exact sums, eigenvalues (falling) and unit eigenvectors (a column each) of the covariance, and its trace."""

    d: int
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    scale: float
    shift: int

    def real(self) -> np.ndarray:
        """Components with a variance; the others have nothing to be scaled to."""
        return self.values > self.values.max(initial=0.0) * np.finfo(float).eps * self.d

    def apply(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(deviation, whitened) of list rows: deviation as objects, None beyond 64 bits; whitened is NaN where there is no variance."""
        x = steps(column, self.scale, self.shift, MOST)
        floors = np.array([s // self.n for s in self.sums], np.int64)
        centred = (x - floors).astype(np.float64) - np.array([s % self.n / self.n for s in self.sums])
        about = (centred * centred).sum(axis=1) * float(self.n) ** 2
        # arithmetic modulo 2**64 is exact wherever the result has 63 bits
        y = x.astype(np.uint64) * np.uint64(self.n % 2**64) - np.array([s % 2**64 for s in self.sums], np.uint64)
        exact = (y * y).sum(axis=1, dtype=np.uint64).astype(object)
        exact[about > 2.0**63] = None
        for i in np.flatnonzero(abs(about / 2.0**63 - 1) < 1e-6):
            total = sum((self.n * v - s) ** 2 for v, s in zip(x[i].tolist(), self.sums, strict=True))
            exact[i] = total if total < 2**63 else None
        real = self.real()
        out = np.full((len(x), len(self.values)), np.nan)
        out[:, real] = centred @ (self.vectors[:, real] / np.sqrt(self.values[real]))
        return exact, out


def _own(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(complete(F.col("vector")))


def scatter(own: DataFrame, d: int, n: int, largest: int, scale: float, shift: int) -> np.ndarray:
    """Exact sums of products of (x, 1) over all rows, as objects; the last row and column hold sums and the number of rows."""
    moduli = primes(2 * n * max(1, largest) ** 2 + 1)
    upper = np.triu_indices(d + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(moduli), d + 1, d + 1), np.int64)
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                x = steps(batch.column("vector").slice(low, BLOCK), scale, shift, MOST)
                x = np.concatenate([x, np.ones((len(x), 1), np.int64)], axis=1)
                for k, p in enumerate(moduli):
                    r = (x % p).astype(np.float64)
                    total[k] += (r.T @ r).astype(np.int64) % p
                total %= np.array(moduli)[:, None, None]
        if total.any():
            for k in range(len(moduli)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(upper[0]), k, np.int32)), pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)), pa.array(total[k][upper])], names=["prime", "i", "j", "residue"])

    parts = own.select("vector").mapInArrow(run, "prime int, i int, j int, residue bigint")
    found = parts.groupBy("prime", "i", "j").agg(F.sum("residue").alias("residue")).toPandas()  # primes x d x d / 2 rows
    residues = np.zeros((len(moduli), d + 1, d + 1), np.int64)
    residues[found.prime, found.i, found.j] = residues[found.prime, found.j, found.i] = found.residue % np.array(moduli)[found.prime]
    return from_residues(residues, moduli)


def fit(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: float = SCALE, shift: int = SHIFT) -> Whitening | None:
    """The whitening of all complete vectors of the commonest length; None if there are none."""
    own = _own(rows, id_col, vector_col)
    farthest = F.aggregate("vector", F.lit(0.0), lambda most, x: F.greatest(most, F.abs(x)))
    found = own.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n"), F.max(farthest).alias("largest")).where("d > 0").orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not found:
        return None
    d, n, largest = found[0].d, found[0].n, int(min(float(MOST), found[0].largest * abs(scale))) + abs(shift) + 1
    exact = scatter(own.where(F.size("vector") == d), d, n, largest, scale, shift)
    sums = exact[:d, d]
    centred = n * exact[:d, :d] - np.multiply.outer(sums, sums)
    covariance = (centred / n**2).astype(np.float64)  # quotients of integers, each rounded once
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    return Whitening(d, n, sums.tolist(), np.maximum(values[order], 0.0), vectors[:, order], sum(centred.diagonal().tolist()) / n**2, scale, shift)


def project(rows: DataFrame, found: Whitening, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, deviation, whitened): whitened is an array with a number for each component, null where it has no variance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                part = batch.slice(low, BLOCK)
                deviation, w = found.apply(part.column("vector"))
                cells = pa.array(w.ravel(), pa.float64(), mask=np.isnan(w.ravel()))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), cells)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([None if x is None else int(x) for x in deviation], pa.int64()), lists], names=["id", "deviation", "whitened"])

    own = _own(rows, id_col, vector_col).where(F.size("vector") == found.d)
    return own.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, deviation bigint, whitened array<double>")


def identity_error(whitened: DataFrame, found: Whitening) -> float:
    """Largest absolute entry of the whitened components' covariance minus the identity, over components with a variance."""
    real = np.flatnonzero(found.real()).tolist()
    pairs = [(i, j) for i in real for j in real if i <= j]
    if not pairs:
        return 0.0
    w = lambda i: F.get("whitened", F.lit(i))
    row = whitened.agg(*[F.covar_pop(w(i), w(j)).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(row, pairs, strict=True))


def whiten(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: float = SCALE, shift: int = SHIFT) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for each complete vector and component.

    Vectors that are null or hold null or non-finite components give no rows, nor do vectors of another length than
    the commonest (the longest of equals). There are as many components as dimensions, up to `components`. A
    component without variance (all vectors alike, fewer vectors than dimensions) has null in place of whitened;
    explained is null if no dimension varies; deviation is null beyond 64 bits. Components beyond 2**60 count as
    that. Equal and null ids stand each for their own row; an empty table gives no rows; other columns are not read.
    """
    found = fit(rows, id_col=id_col, vector_col=vector_col, components=components, scale=scale, shift=shift)
    schema = f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if found is None:
        return rows.sparkSession.createDataFrame([], schema)
    out = project(rows, found, id_col=id_col, vector_col=vector_col)
    error = identity_error(out, found)
    share = F.array([F.lit(float(v / found.trace) if found.trace else None).cast("double") for v in found.values])
    cells = out.select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return cells.select(F.col("id").alias(id_col), (F.col("at") + 1).cast("int").alias("component"), F.lit(found.n).cast("bigint").alias("n"), "deviation", "whitened", F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight whitened components of all embeddings."""
    return whiten(table(spark, sf_dir, "embeddings"))
