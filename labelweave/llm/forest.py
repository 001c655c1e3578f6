"""Embedding near-duplicates with a forest of random-projection trees.

Each tree halves a bounded sample again and again at the median of a random projection. All distinct
vectors run down all trees, and those near a threshold go down both sides (spill). Vectors that share a
leaf are compared in blocks, and a pair counts in the first leaf that it shares, so that links are
counted without being listed. Leaves return counts and a spanning forest, which is united at the end.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.llm.common import Scratch, table
from labelweave.llm.components import components
from labelweave.llm.vectors import cosines, dimensions, hashed_sample, matrix, unit, usable

THRESHOLD = 0.9
TREES = 6
#: Half the spill's width, in standard deviations of a random projection of the longest difference that links.
SPILL = 0.6
SAMPLE = 16_000
LEAF = 512
#: Vectors of a leaf that are compared at once.
BLOCK = 1024


@dataclass
class Forest:
    """Inner nodes in heap order for each tree: direction and threshold; NaN where a leaf has begun."""

    directions: list[np.ndarray]
    thresholds: list[np.ndarray]
    margin: float

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf of every tree that a unit vector gets to; leaves are numbered over all trees, in order."""
        rows, leaves, base = [], [], 0
        for direction, threshold in zip(self.directions, self.thresholds, strict=True):
            queue = [(0, np.arange(len(x)))]
            while queue:
                node, own = queue.pop()
                if node >= len(threshold) or np.isnan(threshold[node]):
                    rows.append(own), leaves.append(np.full(len(own), base + node))
                    continue
                p = x[own] @ direction[node]
                for kid, side in ((2 * node + 1, p <= threshold[node] + self.margin), (2 * node + 2, p >= threshold[node] - self.margin)):
                    if side.any():
                        queue.append((kid, own[side]))
            base += 2 * len(threshold) + 1
        return np.concatenate(rows), np.concatenate(leaves)


def plant(x: np.ndarray, n: int, *, trees: int, leaf: int, threshold: float, spill: float, seed: int = 11) -> Forest:
    """Trees over a sample x of n unit vectors; a node is split while its share of all vectors is above `leaf`."""
    rng, d = np.random.default_rng(seed), x.shape[1]
    margin = spill * np.sqrt(max(0.0, 2 - 2 * threshold)) / np.sqrt(d)
    depth = max(0, int(np.ceil(np.log2(max(1.0, n / leaf)))) + 2)
    depth = min(depth, int(np.log2(max(1, len(x)))))
    directions, thresholds = [], []
    for _ in range(trees):
        direction, cut = rng.normal(size=((1 << depth) - 1, d)), np.full((1 << depth) - 1, np.nan)
        direction /= np.sqrt((direction**2).sum(axis=1, keepdims=True))
        queue = [(0, np.arange(len(x)))]
        while queue:
            node, own = queue.pop()
            if node >= len(cut) or len(own) < 8 or len(own) * n <= leaf * len(x):
                continue
            p = x[own] @ direction[node]
            middle = np.median(p)
            left, right = own[p <= middle + margin], own[p >= middle - margin]
            if len(left) + len(right) > 1.7 * len(own):  # a dense group; splitting it would only copy it
                continue
            cut[node] = middle
            queue += [(2 * node + 1, left), (2 * node + 2, right)]
        directions.append(direction), thresholds.append(cut)
    return Forest(directions, thresholds, float(margin))


def leaf_links(v: np.ndarray, node: np.ndarray, weight: np.ndarray, side: np.ndarray, marks: list[np.ndarray], leaf: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For vectors with a link in this block: their position, the rows that they link with, and the smallest node of their local component.

    Pairs that share an earlier leaf are left to that leaf; side 0 and 1 are two blocks of a leaf, 2 a whole one.
    """
    u = unit(v)
    near = u @ u.T
    link = near >= threshold - 1e-9
    edge = np.argwhere(np.triu((near < threshold + 1e-9) & link, 1))
    if len(edge):  # rounding decides here, so the exact measure has to
        ok = cosines(v[edge[:, 0]], v[edge[:, 1]]) >= threshold
        link[edge[~ok, 0], edge[~ok, 1]] = link[edge[~ok, 1], edge[~ok, 0]] = False
    np.fill_diagonal(link, False)
    if (side != 2).any():
        link &= side[:, None] != side[None, :]
    rows = np.flatnonzero(link.any(axis=1))
    if not len(rows):
        return rows, rows, rows
    link = link[np.ix_(rows, rows)]
    earlier = [m[m < leaf] for m in (marks[i] for i in rows)]
    if len(flat := np.concatenate(earlier)):
        names, codes = np.unique(flat, return_inverse=True)
        member = np.zeros((len(rows), len(names)), np.float32)
        member[np.repeat(np.arange(len(rows)), [len(e) for e in earlier]), codes] = 1
        link &= member @ member.T == 0
    total, root = link @ weight[rows], node[rows].copy()
    while True:
        new = root.copy()
        for i in range(0, len(rows), 256):
            new[i : i + 256] = np.minimum(root[i : i + 256], np.where(link[i : i + 256], root[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (new == root).all():
            break
        root = new
    some = total > 0
    return rows[some], total[some], root[some]


def leaf_edges(reps: DataFrame, scratch: Scratch, threshold: float, trees: int, spill: float, sample: int, leaf: int, block: int) -> DataFrame:
    """(node, links, root) from all leaves, for distinct vectors (vector, node, weight) of one dimension: the rows that a node links with there, and its local component."""
    x = hashed_sample(reps, sample, 2)
    spark, n = reps.sparkSession, reps.count()
    forest = spark.sparkContext.broadcast(plant(unit(x), n, trees=trees, leaf=leaf, threshold=threshold, spill=spill) if len(x) else None)

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                row, leaves = forest.value.leaves(unit(matrix(batch.column("vector"))))
                order = np.lexsort((leaves, row))
                row, leaves = row[order], leaves[order]
                ends = np.cumsum(np.bincount(row, minlength=batch.num_rows))
                marks = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(leaves, pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("vector"), batch.column("node"), batch.column("weight"), marks], names=["vector", "node", "weight", "marks"])

    placed = scratch.save(reps.mapInArrow(descend, "vector array<double>, node bigint, weight bigint, marks array<bigint>"))
    spread = placed.withColumn("leaf", F.explode("marks"))
    large = spread.groupBy("leaf").count().where(F.col("count") > block).select("leaf", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    spread = spread.join(large, "leaf", "left").withColumn("mine", F.pmod(F.xxhash64("vector"), F.coalesce("blocks", F.lit(1))).cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    side = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1)
    dealt = spread.select("leaf", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), side.alias("side"), "vector", "node", "weight", "marks")

    def compare(key: tuple, t: pa.Table) -> pa.Table:
        marks = t["marks"].combine_chunks()
        own = np.split(marks.flatten().to_numpy(), marks.offsets.to_numpy()[1:-1] - marks.offsets[0].as_py())
        node = t["node"].to_numpy()
        at, total, root = leaf_links(matrix(t["vector"]), node, t["weight"].to_numpy(), t["side"].to_numpy(), own, key[0].as_py(), threshold)
        return pa.table([pa.array(node[at], pa.int64()), pa.array(total, pa.int64()), pa.array(root, pa.int64())], names=["node", "links", "root"])

    return scratch.save(dealt.groupBy("leaf", "i", "j").applyInArrow(compare, "node bigint, links bigint, root bigint"))


def near_duplicates(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, trees: int = TREES, spill: float = SPILL, sample: int = SAMPLE, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """(id, n_links, component_id, kept) for each row.

    Equal vectors are compared once, with their number. Vectors that are null, zero or hold null or
    non-finite components link with nothing and are kept, as is every row with a null id (its component is
    null). Vectors of each dimension have a forest of their own. Rows that share an id are one node: their vectors
    link with one another's links, and the id's links are those of all its vectors. An empty table gives
    no rows; other columns are not read.
    """
    scratch = Scratch(rows.sparkSession)
    own = usable(rows, id_col, vector_col)
    reps = scratch.save(own.groupBy("vector").agg(F.min("id").alias("node"), F.count("*").alias("weight")))
    parts = [leaf_edges(reps.where(F.size("vector") == d), scratch, threshold, trees, spill, sample, leaf, block) for d in dimensions(reps) or [0]]
    found = functools.reduce(DataFrame.unionByName, parts)
    graph = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), Scratch(rows.sparkSession))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    nodes = reps.groupBy("node").agg(F.sum(F.col("weight")).alias("rows")).join(links, "node", "left").join(graph, "node", "left")
    nodes = nodes.select("node", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component"))
    of = reps.join(nodes, "node").select("vector", (F.col("links") + F.col("weight") - 1).alias("n"), "component")
    all_rows = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    out = all_rows.join(of, "vector", "left")
    linked = F.col("id").isNotNull() & F.col("component").isNotNull()
    component = F.when(linked, F.col("component")).otherwise(F.col("id").cast("bigint"))
    return out.select(F.col("id").alias(id_col), F.when(linked, F.col("n")).otherwise(0).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def op4_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and representative of every vector."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
