"""Compression of vectors to short codes: each part of a vector becomes the number of its nearest codebook entry.

All arithmetic is on integers, so every run and every partitioning gives the same codes. A round reads the
table once: Arrow batches compare their parts with the codebooks, a partition adds up what falls to each
entry, and a grouped shuffle merges these sums. Only codebooks, whose size the parameters fix, are on the
driver and sent to executors.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.llm.common import Scratch, small, table
from labelweave.llm.vectors import complete, steps

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors that are compared with a codebook at once.
BLOCK = 4096
#: Rows among which sums of one label are spread where labels are too many for a broadcast.
SALTS = 16


@dataclass
class Codebooks:
    """entries[p] holds the entries of part p, one a row; `most` bounds components so that no distance leaves 64 bits."""

    entries: list[np.ndarray]
    scale: float
    most: int

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for part in self.entries for row in part.tolist() for x in row).encode()).hexdigest()

    def nearest(self, x: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) for rows of one part's components; the first of equals."""
        book = self.entries[part]
        entry, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        norms = (book * book).sum(axis=1)
        for low in range(0, len(x), BLOCK):
            own = x[low : low + BLOCK]
            all_ = (own * own).sum(axis=1)[:, None] - 2 * (own @ book.T) + norms
            entry[low : low + BLOCK] = best = np.argmin(all_, axis=1)
            distance[low : low + BLOCK] = all_[np.arange(len(own)), best]
        return entry, distance

    def parts(self, column: pa.Array) -> list[np.ndarray]:
        return np.split(steps(column, self.scale, 0, self.most), len(self.entries), axis=1)


def _merged(own: DataFrame, books: Codebooks) -> Codebooks:
    """Entries replaced by the floor of their parts' means; an entry without parts stays."""
    width = [e.shape for e in books.entries]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = [np.zeros(s, np.int64) for s in width], [np.zeros(s[0], np.int64) for s in width]
        for batch in batches:
            if not batch.num_rows:
                continue
            for p, x in enumerate(books.parts(batch.column("vector"))):
                entry, _ = books.nearest(x, p)
                order = np.argsort(entry, kind="stable")
                used, first = np.unique(entry[order], return_index=True)
                total[p][used] += np.add.reduceat(x[order], first, axis=0)
                count[p] += np.bincount(entry, minlength=len(count[p]))
        for p, (t, c) in enumerate(zip(total, count, strict=True)):
            used = np.flatnonzero(c)
            e, at = np.repeat(used, t.shape[1]), np.tile(np.arange(t.shape[1]), len(used))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(e), p, np.int32)), pa.array(e.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(t[used].ravel()), pa.array(c[e])], names=["part", "entry", "at", "total", "n"])

    sums = own.select("vector").mapInArrow(run, "part int, entry int, at int, total bigint, n bigint")
    found = sums.groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toPandas()  # a row for each component of the codebooks
    fresh = [e.copy() for e in books.entries]
    for p, own_part in found.groupby("part"):
        fresh[p][own_part.entry.to_numpy(), own_part["at"].to_numpy()] = own_part.total.to_numpy() // own_part.n.to_numpy()
    return Codebooks(fresh, books.scale, books.most)


def train(own: DataFrame, d: int, *, parts: int, entries: int, rounds: int, scale: float) -> Codebooks:
    """Codebooks over all rows (id, vector of d components): they begin as the vectors of the smallest ids."""
    first = own.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector").toArrow()
    books = Codebooks([np.zeros((0, d // parts), np.int64)] * parts, scale, math.isqrt((2**63 - 1) // (4 * max(1, d))))
    books.entries = [np.ascontiguousarray(x) for x in books.parts(first["vector"].combine_chunks())]
    for _ in range(rounds):
        books = _merged(own, books)
    return books


def compress(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) for each row whose vector is complete.

    code has two hexadecimal digits a part, error is the squared distance to the entries in steps of 1 / scale,
    label_error its sum over the rows with an equal label (null labels together). Vectors that are null or hold
    null or non-finite components give no row. Codebooks are of the commonest length that `parts` divides (the
    longest of equals); vectors of other lengths have a null code and a null error. Components of more than 64
    bits allow (1.8e5 for 64 components) count as that bound. Equal and null ids stand each for their own row; null ids
    begin a codebook last. An empty table gives no rows; other columns are not read.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two digits a part, so there are 1 to 256 entries")
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession)
    own = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).alias("label")).where(complete(F.col("vector")))
    size = F.size("vector").alias("d")
    lengths = own.groupBy(size).agg(F.count("*").alias("n")).where((F.col("d") % parts == 0) & (F.col("d") > 0)).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    kinds = {f.name: f.dataType.simpleString() for f in own.schema}
    schema = f"id {kinds['id']}, label {kinds['label']}, code string, error bigint"
    if not lengths:
        coded, digest = own.select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error")), None
    else:
        d = lengths[0].d
        fit = own.where(F.size("vector") == d)
        books = train(fit, d, parts=parts, entries=entries, rounds=rounds, scale=scale)
        digest, sent = books.digest(), spark.sparkContext.broadcast(books)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [sent.value.nearest(x, p) for p, x in enumerate(sent.value.parts(batch.column("vector")))] if batch.num_rows else []
                codes = np.stack([e for e, _ in found], axis=1).astype(np.uint8).tobytes().hex() if found else ""
                error = sum((e for _, e in found), np.zeros(batch.num_rows, np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([codes[i : i + 2 * parts] for i in range(0, len(codes), 2 * parts)], pa.string()), pa.array(error)], names=["id", "label", "code", "error"])

        others = own.where(F.size("vector") != d).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"))
        coded = fit.mapInArrow(run, schema).unionByName(others)
    coded = scratch.save(coded)
    sums = scratch.save(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    light = small(sums)
    if light is sums:  # too many labels to send to all: rows of one label are spread over salts
        salt = F.pmod(F.xxhash64("id", "code", "error"), F.lit(SALTS)).cast("int")
        sums = sums.withColumn("salt", F.explode(F.array([F.lit(i) for i in range(SALTS)])))
        joined = coded.withColumn("own_salt", salt).join(sums, F.col("label").eqNullSafe(F.col("of")) & (F.col("own_salt") == F.col("salt")))
    else:
        joined = coded.join(light, F.col("label").eqNullSafe(F.col("of")))
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).cast("string").alias("codebooks_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings by four codebooks of 256 entries after four rounds."""
    return compress(table(spark, sf_dir, "embeddings"))


def codebook_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same in SQL, a few common table expressions for each round."""
    nearest = "SELECT vec_id, part, v, entry, dist FROM (SELECT x.vec_id, x.part, x.v, b.entry, list_dot_product(x.v, x.v) - 2 * list_dot_product(x.v, b.v) + list_dot_product(b.v, b.v) AS dist, row_number() OVER (PARTITION BY x.vec_id, x.part ORDER BY list_dot_product(x.v, x.v) - 2 * list_dot_product(x.v, b.v) + list_dot_product(b.v, b.v), b.entry) AS r FROM cut x JOIN book{i} b USING (part)) WHERE r = 1"
    out = f"""
WITH whole AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 1024)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
cut AS MATERIALIZED (SELECT vec_id, CAST(p AS INT) AS part, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS v FROM whole, range({parts}) t(p)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM whole QUALIFY entry < {entries}),
book0 AS MATERIALIZED (SELECT part, entry, v FROM first JOIN cut USING (vec_id))"""
    for i in range(rounds):
        out += f""",
near{i} AS MATERIALIZED ({nearest.format(i=i)}),
mean{i} AS MATERIALIZED (SELECT part, entry, list(CAST(floor(s / c) AS DOUBLE) ORDER BY place) AS v FROM (SELECT part, entry, place, sum(x) AS s, count(*) AS c FROM (SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM near{i}) GROUP BY ALL) GROUP BY ALL),
book{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.v, b.v) AS v FROM book{i} b LEFT JOIN mean{i} m USING (part, entry))"""
    return out + f""",
last AS MATERIALIZED ({nearest.format(i=rounds)}),
codes AS (SELECT vec_id, string_agg(lower(printf('%02x', CAST(entry AS INT))), '' ORDER BY part) AS code, CAST(sum(dist) AS BIGINT) AS error FROM last GROUP BY vec_id),
digest AS (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM book{rounds}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM codes JOIN whole USING (vec_id), digest
"""
