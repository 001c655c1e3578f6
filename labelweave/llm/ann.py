"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree is fitted on a bounded sample; every distinct vector is put into one leaf. A query walks the
tree best bin first, through a priority queue, and visits leaves until the number that a calibration
on the sample found to reach the wanted recall. Vectors and queries that meet in a leaf are compared in
blocks of bounded size.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelweave.llm.common import Scratch, table
from labelweave.llm.vectors import cosines, dimensions, hashed_sample, matrix, unit, usable

#: Vectors in the sample that fits and calibrates the tree.
SAMPLE = 16_000
#: Vectors that a leaf has about, branches of a node, and rows and queries of a block.
LEAF, BRANCH, BLOCK = 512, 8, 2048
RECALL = 0.97


@dataclass
class Tree:
    """Centres of all nodes, children of inner nodes, the leaf number of leaves, and how many leaves to visit."""

    centres: np.ndarray
    children: list[list[int]]
    leaf: np.ndarray
    visits: int = 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each unit vector: the nearest child's, from the root on."""
        at, out = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        open_ = [0]
        while open_:
            node = open_.pop()
            rows = np.flatnonzero(at == node)
            if not len(rows):
                continue
            if kids := self.children[node]:
                at[rows] = np.array(kids)[(x[rows] @ self.centres[kids].T).argmax(axis=1)]
                open_ += kids
            else:
                out[rows] = self.leaf[node]
                at[rows] = -1
        return out

    def order(self, q: np.ndarray) -> Iterator[int]:
        """Leaves for one unit query, best bin first."""
        near, queue = self.centres @ q, [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if kids := self.children[node]:
                for kid in kids:
                    heapq.heappush(queue, (-float(near[kid]), kid))
            else:
                yield int(self.leaf[node])


def grow(x: np.ndarray, leaves: int, seed: int = 7) -> Tree:
    """Split the largest node by spherical k-means until there are about `leaves` leaves."""
    rng, centres, children = np.random.default_rng(seed), [x.mean(axis=0) if len(x) else np.zeros(x.shape[1])], [[]]
    queue, count = [(-len(x), 0, np.arange(len(x)))], 1
    while queue and count < leaves:
        _, node, rows = heapq.heappop(queue)
        k = min(BRANCH, leaves - count + 1, len(rows))
        if k < 2:
            break
        c = x[rows[rng.choice(len(rows), k, replace=False)]]
        for _ in range(10):
            own = (x[rows] @ c.T).argmax(axis=1)
            sums = np.array([x[rows[own == j]].sum(axis=0) for j in range(k)])
            size = np.sqrt((sums**2).sum(axis=1, keepdims=True))
            c = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), c)
        own = (x[rows] @ c.T).argmax(axis=1)
        full = [j for j in range(k) if (own == j).any()]
        if len(full) < 2:  # copies of one vector
            continue
        for j in full:
            centres.append(c[j]), children.append([])
            children[node].append(len(children) - 1)
            heapq.heappush(queue, (-int((own == j).sum()), len(children) - 1, rows[own == j]))
        count += len(full) - 1
    leaf, n = np.full(len(children), -1), 0
    for node, kids in enumerate(children):
        if not kids:
            leaf[node], n = n, n + 1
    return Tree(np.array(centres), children, leaf)


def calibrate(tree: Tree, x: np.ndarray, k: int, recall: float, probes: int = 300) -> int:
    """Leaves that probes from the sample have to visit so that `recall` of their k nearest are found."""
    if len(x) < 2:
        return 1
    leaf_of, depth = tree.assign(x), []
    for i in np.linspace(0, len(x) - 1, min(probes, len(x))).astype(int):
        near = x @ x[i]
        near[i] = -2
        top = np.argpartition(-near, min(k, len(x) - 1) - 1)[: min(k, len(x) - 1)]
        place = {leaf: j for j, leaf in enumerate(tree.order(x[i]))}
        depth += [place[leaf_of[j]] + 1 for j in top]
    return int(np.sort(depth)[min(len(depth) - 1, int(np.ceil(recall * len(depth))) - 1)])


def nearest(base: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, recall: float = RECALL, sample: int = SAMPLE, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of base with the largest cosine to each query, other than the query's own id.

    Ties go to the smaller vec_id; score is the cosine of the original vectors in double precision. Rows
    with a null id, and vectors that are null, zero or hold null or non-finite components take no part;
    vectors of each dimension are searched apart; equal rows count once; an empty table gives no rows;
    columns other than the two named are not read. Of equal vectors only the k + 1 smallest ids are kept,
    which is all that any answer can need.
    """
    scratch, own, asked = Scratch(base.sparkSession), usable(base, id_col, vector_col).distinct(), usable(queries, id_col, vector_col).distinct()
    found = [_nearest(own.where(F.size("vector") == d), asked.where(F.size("vector") == d), scratch, k, recall, sample, leaf, block) for d in dimensions(asked) or [0]]
    return functools.reduce(DataFrame.unionByName, found)


def _nearest(own: DataFrame, queries: DataFrame, scratch: Scratch, k: int, recall: float, sample: int, leaf: int, block: int) -> DataFrame:
    """nearest() of vectors of one dimension."""
    spark = own.sparkSession
    order = Window.partitionBy("vector").orderBy("id")
    few = own.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1)
    index = scratch.save(few.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    x = hashed_sample(index, sample, 1)
    x = unit(x) if len(x) else x
    n = index.count()
    tree = grow(x, max(1, min(-(-n // leaf), max(1, len(x) // 4))))
    tree.visits = calibrate(tree, x, k, recall)
    shared = spark.sparkContext.broadcast(tree)  # at most sample / 4 leaves

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(shared.value.assign(unit(matrix(batch.column("vector"))))), batch.column("vector"), batch.column("ids")], names=["leaf", "vector", "ids"])

    placed = scratch.save(index.mapInArrow(place, "leaf bigint, vector array<double>, ids array<bigint>"))
    held = dict(placed.groupBy("leaf").agg(F.count("*")).collect())  # a row for each leaf
    sizes = spark.sparkContext.broadcast(held)
    asked = scratch.save(queries)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = sizes.value
        for batch in batches:
            row, leaves = [], []
            for i, q in enumerate(unit(matrix(batch.column("vector"))) if batch.num_rows else ()):
                seen = found = 0
                for leaf in shared.value.order(q):
                    if seen >= shared.value.visits and found > k:
                        break
                    seen, found = seen + 1, found + size.get(leaf, 0)
                    if leaf in size:
                        row.append(i), leaves.append(leaf)
            yield pa.RecordBatch.from_arrays([pa.array(leaves, pa.int64()), batch.column("id").take(pa.array(row, pa.int64())), batch.column("vector").take(pa.array(row, pa.int64()))], names=["leaf", "id", "vector"])

    asks = scratch.save(asked.mapInArrow(visit, "leaf bigint, id bigint, vector array<double>"))
    # a leaf's rows and the queries that visit it are cut into as many parts and groups as the leaf itself needs;
    # only these meet, so a query's vector goes to the leaves that it visits and a row to its own leaf's groups
    shape = asks.groupBy("leaf").agg(F.ceil(F.count("*") / block).alias("groups")).join(placed.groupBy("leaf").agg(F.ceil(F.count("*") / block).alias("parts")), "leaf")
    shape = scratch.save(shape)
    below = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1))
    rows = placed.join(shape, "leaf").withColumn("part", F.pmod(F.xxhash64("vector"), F.col("parts"))).withColumn("group", below("groups")).select("leaf", "part", "group", "vector", "ids")
    asks = asks.join(shape, "leaf").withColumn("group", F.pmod(F.xxhash64("id"), F.col("groups"))).withColumn("part", below("parts")).select("leaf", "part", "group", "id", "vector")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], []]
        if len(left) and len(right):
            v, q = matrix(left["vector"]), matrix(right["vector"])
            ids, who = left["ids"].to_pylist(), right["id"].to_numpy()
            near = unit(q) @ unit(v).T
            for i in range(len(q)):
                take = min(k + 1, len(v))
                least = np.partition(near[i], len(v) - take)[len(v) - take]
                top = np.flatnonzero(near[i] >= least - 1e-9)
                exact = cosines(v[top], np.broadcast_to(q[i], (len(top), q.shape[1])))
                best = sorted((-s, vec) for s, j in zip(exact.tolist(), top, strict=True) for vec in ids[j] if vec != who[i])[:k]
                out[0] += [int(who[i])] * len(best)
                out[1] += [b[1] for b in best]
                out[2] += [-b[0] for b in best]
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    keys = ("leaf", "part", "group")
    found = rows.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInArrow(compare, "query_id bigint, vec_id bigint, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows of every fiftieth vector, among all rows."""
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where(F.col("vec_id") % 50 == 0))
