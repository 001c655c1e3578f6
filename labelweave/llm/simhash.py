"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint is cut into few segments, so that one of them differs by at most one bit between near
duplicates: it is then equal in one of its variants, in which one bit is deleted. Distinct fingerprints
are indexed under all variants of all segments, equal variants meet in a bucket, and every pair of a
bucket is verified by the distance of the whole fingerprints. A bucket returns a spanning forest of its
links, nearest links first, and not all pairs.

Two scales are in use. FINE has 64 bits in two segments of 32 and links up to three differing bits, for
which no link is missed. WIDE has 128 bits in eight segments of 16 and links up to 30 differing bits, which
is what texts with a similarity of 0.8 have; there a candidate is found with a probability (over 0.9 at a
similarity of 0.8, 0.97 at 0.85, 1 at 1) and links are verified by the shingles themselves. A link of a
forest that fails does not stand for the links that it left out: where one fails, all pairs between the
groups that the verified links have made are looked at, in blocks and where the texts lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.llm.common import Scratch, held, slices, small, table
from labelweave.llm.components import components

SEED = 42
#: Fingerprints of a bucket that are compared at once; larger buckets are compared block against block.
BLOCK = 2048
#: Links of buckets that are held at once before they are cut down to a forest.
MOST_PAIRS = 2_000_000
#: Texts of one side that are compared at once where candidates' groups are large, and members of small groups that go together.
TEXTS = 256
#: Large buckets are found from one fingerprint in so many; this deals work out and does not change results.
PROBE = 16


@dataclass(frozen=True)
class Scale:
    """Words of a shingle, 64-bit words of a fingerprint, segments in each of these words, bits of a segment, and the largest distance that links."""

    shingle: int
    words: int
    segments: int
    bits: int
    distance: int

    @property
    def columns(self) -> list[str]:
        return [f"f{k}" for k in range(self.words)]


FINE = Scale(3, 1, 2, 32, 3)
WIDE = Scale(5, 2, 4, 16, 30)
SIMILARITY = 0.8


def shingles(text: bytes, words: int) -> list[bytes]:
    """Word shingles of a UTF-8 text with A-Z in lower case, repeats included; the whole sequence if it has fewer words."""
    tokens = text.lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not tokens:
        return []
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    n = min(words, len(tokens))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(tokens) - n + 1].tolist()
    return [joined[a:b] for a, b in zip(starts, ends[n - 1 :].tolist(), strict=True)]


def majority(hashes: np.ndarray) -> np.ndarray:
    """Bits that are set in over half of the rows of big-endian words, as such words."""
    counts = np.zeros(64 * hashes.shape[1], np.int64)
    for at in range(0, len(hashes), 1 << 15):
        counts += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes)).view(">i8")


def fingerprint(text: bytes, scale: Scale = FINE, seed: int = SEED) -> list[int]:
    """SimHash of a text as signed 64-bit integers; 0 if it has no word. One word: over all shingles; two: over distinct ones."""
    found = shingles(text, scale.shingle)
    if not found:
        return [0] * scale.words
    if scale.words == 1:
        digest = xxhash.xxh64_intdigest
        return majority(np.array([digest(x, seed) for x in found], ">u8").reshape(-1, 1)).tolist()
    digest = xxhash.xxh3_128_digest
    return majority(np.frombuffer(b"".join(digest(x, seed) for x in set(found)), ">u8").reshape(-1, 2)).tolist()


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", scale: Scale = FINE) -> DataFrame:
    """(id, f0, ...) for each row, and the text's hash as version; a null text has no words and so fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("simhash", lambda: None)  # lets other operators' memory go
        for batch in (part for whole in batches for part in slices(whole, "text")):
            found = np.array([fingerprint(t or b"", scale) for t in batch.column("text").cast(pa.binary()).to_pylist()], np.int64).reshape(-1, scale.words)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("version"), *(pa.array(np.ascontiguousarray(x)) for x in found.T)], names=["id", "version", *scale.columns])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, version bigint, " + ", ".join(f"{c} bigint" for c in scale.columns))


def variants(scale: Scale) -> Column:
    """The keys of a fingerprint: number of the segment, deleted bit, and the segment without that bit in the low 32 bits."""
    keys, mask = [], (1 << scale.bits) - 1
    for k in range(scale.words * scale.segments):
        shift = 64 - scale.bits * (k % scale.segments + 1)
        value = F.shiftrightunsigned(F.col(f"f{k // scale.segments}"), shift).bitwiseAND(F.lit(mask))
        keys += [value.bitwiseAND(F.lit(mask & ~(1 << bit))).bitwiseOR(F.lit((k << 6 | bit) << 32)) for bit in range(scale.bits)]
    return F.array(*keys)


def segment(f: np.ndarray, k: int, scale: Scale) -> np.ndarray:
    return f[:, k // scale.segments] >> np.uint64(64 - scale.bits * (k % scale.segments + 1)) & np.uint64((1 << scale.bits) - 1)


def forest(a: np.ndarray, b: np.ndarray, far: np.ndarray, n: int) -> np.ndarray:
    """Positions of edges that span what the edges a, b connect; edges with a small `far` come first."""
    root, out = np.arange(n), []
    for level in np.unique(far):
        left = np.flatnonzero(far == level)
        while True:
            x, y = root[a[left]], root[b[left]]
            left, x, y = left[x != y], x[x != y], y[x != y]
            if not len(left):
                break
            high, first = np.unique(np.maximum(x, y), return_index=True)  # one edge for each root, to a smaller one
            root[high] = np.minimum(x, y)[first]
            out.append(left[first])
            while (root[root] != root).any():
                root = root[root]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def bucket_links(group: np.ndarray, keys: np.ndarray, f: np.ndarray, side: np.ndarray, scale: Scale) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of links that span all links within runs of equal `group`; f: fingerprints, a row for each.

    A pair counts only in the first bucket that it shares, and between sides only if they differ (side 0
    and 1 are two blocks of a large bucket, 2 a whole one).
    """
    n, u = len(group), f.astype(np.uint64)
    own, bit, left, right, far = keys >> 38, (keys >> 32 & 63).astype(np.uint64), [], [], []
    at, shift, waiting = np.arange(n), 1, 0
    while True:
        at = at[at + shift < n]
        at = at[group[at] == group[at + shift]]
        if not len(at):
            break
        pair = at[(side[at] == 2) | (side[at] != side[at + shift])]
        x = u[pair] ^ u[pair + shift]
        d = np.bitwise_count(x).sum(axis=1, dtype=np.int64)
        pair, x, d = pair[d <= scale.distance], x[d <= scale.distance], d[d <= scale.distance]
        if len(pair):
            first = np.ones(len(pair), bool)
            for k in range(scale.words * scale.segments):
                y = segment(x, k, scale)
                first &= (own[pair] <= k) | (np.bitwise_count(y) > 1)
                mine = own[pair] == k
                first[mine] &= (y[mine] == np.uint64(1) << bit[pair[mine]]) | ((y[mine] == 0) & (bit[pair[mine]] == 0))
            left.append(pair[first].astype(np.int32)), right.append((pair[first] + shift).astype(np.int32)), far.append(d[first].astype(np.int16))
            waiting += len(left[-1])
            if waiting > MOST_PAIRS:  # a forest of some links and the others spans what all of them do
                a, b, d = (np.concatenate(x) for x in (left, right, far))
                chosen = forest(a, b, d, n)
                left, right, far, waiting = [a[chosen]], [b[chosen]], [d[chosen]], 0
        shift += 1
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(left), np.concatenate(right)
    chosen = forest(a, b, np.concatenate(far), n)
    return a[chosen], b[chosen]


def links(reps: DataFrame, scale: Scale, scratch: Scratch, *, block: int = BLOCK) -> DataFrame:
    """Edges (a0, ..., b0, ...) between distinct fingerprints (f0, ...), enough to connect what the distance links.

    Buckets of more than about `block` fingerprints are dealt out as pairs of blocks, so no task compares
    more than two blocks at once.
    """
    words, f = scale.columns, F.xxhash64(*scale.columns)
    keyed = lambda df: df.select(F.explode(variants(scale)).alias("key"), *words)
    probe = keyed(reps.where(F.pmod(F.xxhash64(*words, F.lit(1)), F.lit(PROBE)) == 0)).groupBy("key").count()
    large = probe.where(F.col("count") * PROBE > block).select("key", F.ceil(F.col("count") * PROBE / block).cast("int").alias("blocks"))
    large = small(scratch.save(large))
    own = F.pmod(f, F.col("blocks")).cast("int")
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = keyed(reps).join(large, "key", "left").select("key", *words, F.coalesce(own, F.lit(-1)).alias("own"), other.alias("other"))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    low, high = F.least("own", "other").cast("bigint") + 1, F.greatest("own", "other").cast("bigint") + 1
    dealt = dealt.select("key", (F.shiftleft(low, 32) + F.shiftleft(high, 2) + side).alias("deal"), *words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            now = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            group = group_of(now)
            cut = int(np.flatnonzero(np.append(True, np.diff(group) != 0))[-1])
            rest = now.slice(cut).combine_chunks()
            if cut:
                yield from found(now.slice(0, cut), group[:cut])
        if rest is not None:
            yield from found(rest, group_of(rest))

    def group_of(t: pa.Table) -> np.ndarray:
        """Number of the run of equal key and pair of blocks."""
        key, pair, new = t["key"].to_numpy(), t["deal"].to_numpy() >> 2, np.zeros(len(t), bool)
        new[1:] = (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])
        return np.cumsum(new)

    def found(t: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        several = np.bincount(group)[group] > 1
        t, group = t.filter(pa.array(several)), group[several]
        if len(t):
            f = np.stack([t[c].to_numpy() for c in words], axis=1)
            a, b = bucket_links(group, t["key"].to_numpy(), f, t["deal"].to_numpy() & 3, scale)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(f[x, k])) for x in (a, b) for k in range(scale.words)], names=[f"{s}{k}" for s in "ab" for k in range(scale.words)])

    pair = F.shiftright("deal", 2)
    sorted_ = dealt.repartition(F.col("key"), pair).sortWithinPartitions("key", "deal", *words)
    return sorted_.mapInArrow(run, ", ".join(f"{s}{k} bigint" for s in "ab" for k in range(scale.words)))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(id, fp, component_id) for each row of docs on the FINE scale; component_id is the smallest id reachable by links.

    Null and empty texts have fingerprint 0 and link with one another; equal rows share a component;
    rows with a null id get their fingerprint's component, and null if no row with an id has it; an
    empty table gives no rows; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.save(fingerprints(docs, id_col=id_col, text_col=text_col).select("id", F.col("f0").alias("fp")))
    reps = scratch.save(rows.groupBy("fp").agg(F.min("id").alias("node")).where("node is not null"))
    edges = links(reps.select(F.col("fp").alias("f0")), FINE, scratch, block=block).select(F.col("a0").alias("a"), F.col("b0").alias("b"))
    found = components(edges, Scratch(docs.sparkSession))
    linked = scratch.save(reps.join(found, reps.fp == found.node).select("fp", "component", reps.node))
    least = linked.groupBy("component").agg(F.min("node").alias("least"))
    of = reps.join(linked.join(least, "component").select("fp", "least"), "fp", "left").select("fp", F.coalesce("least", "node").alias("component_id"))
    return rows.join(of, "fp", "left").select(F.col("id").alias(id_col), "fp", "component_id")


def in_blocks(reach: DataFrame, rows: DataFrame, docs: DataFrame, scratch: Scratch, *, id_col: str, text_col: str, scale: Scale, block: int = TEXTS) -> tuple[DataFrame, DataFrame]:
    """(place, texts) of the fingerprints of reach (f0, ..., reach and others), which tells what edges connect.

    place adds g and block to reach: small groups go together under one g in block -1, a large one has its own g and
    blocks of about `block` fingerprints. texts has a row (g, low, high, f0, ..., text) for each fingerprint in each
    pair of blocks that holds its own, so a text is copied once for each block of its group. Each fingerprint stands
    for the text with the smallest (id, version) that has it; other texts are not shuffled.
    """
    words = scale.columns
    sizes = scratch.save(reach.groupBy("reach").agg(F.count("*").alias("n")))
    together = sizes.where(F.col("n") <= block).agg(F.sum("n")).first()[0] or 0
    alone = F.col("n") <= block
    g = F.when(alone, F.pmod(F.xxhash64("reach"), F.lit(together // (2 * block) + 1))).otherwise(F.xxhash64("reach"))
    cut = F.when(alone, -1).otherwise(F.pmod(F.xxhash64(*words, F.lit(7)), F.ceil(F.col("n") / block))).cast("int")
    place = scratch.save(reach.join(sizes, "reach").select(*reach.columns, g.alias("g"), cut.alias("block"), F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    at = rows.join(small(place.select(*words)), words, "left_semi").groupBy(*words).agg(F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "version")).alias("at"))
    at = small(scratch.save(at.select(*words, F.col("at.id").alias("_id"), F.col("at.version").alias("_version"))))
    own = docs.select(F.col(id_col).alias("_own"), F.xxhash64(text_col).alias("_hash"), F.col(text_col).alias("text"))
    texts = own.join(at, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_version"))).groupBy(*words).agg(F.min("text").alias("text"))
    others = F.explode(F.when(F.col("block") < 0, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    texts = texts.join(small(place), words).select("*", others.alias("other"))
    return place, texts.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("blocks", "other")


def shingle_sets(texts: pa.ChunkedArray, scale: Scale) -> list[np.ndarray]:
    digest = xxhash.xxh3_64_intdigest
    return [np.unique(np.array([digest(x) for x in shingles(t.as_py() or b"", scale.shingle)], np.uint64)) for t in texts.cast(pa.binary())]


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets share at least `similarity` of what either has; empty sets are alike."""
    low, high = sorted((len(a), len(b)))
    common = len(np.intersect1d(a, b, assume_unique=True)) if low >= similarity * high else 0
    return common >= similarity * (low + high - common)


def similar(edges: DataFrame, reach: DataFrame, *, rows: DataFrame, docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, scale: Scale, similarity: float) -> DataFrame:
    """The edges whose texts have at least `similarity`: shared distinct shingles over all distinct shingles of both.

    reach (f0, ..., reach) tells which fingerprints the edges connect. A task has the edges between two blocks of a
    group, or those of several small groups, and the texts of these.
    """
    words = scale.columns
    place, texts = in_blocks(reach, rows, docs, scratch, id_col=id_col, text_col=text_col, scale=scale)
    side = lambda s: small(place).select(*[F.col(c).alias(f"{s}{k}") for k, c in enumerate(words)], F.col("g").alias(f"{s}g"), F.col("block").alias(f"{s}_block"))
    both = edges.join(side("a"), [f"a{k}" for k in range(scale.words)]).join(side("b"), [f"b{k}" for k in range(scale.words)])
    both = both.select(F.col("ag").alias("g"), F.least("a_block", "b_block").alias("low"), F.greatest("a_block", "b_block").alias("high"), *edges.columns)

    def run(own: pa.Table, texts: pa.Table) -> pa.Table:
        if not len(own) or not len(texts):
            return own.select(columns).slice(0, 0)
        place = {key: i for i, key in enumerate(zip(*(texts[c].to_pylist() for c in words), strict=True))}
        sets = shingle_sets(texts["text"], scale)
        a, b = ([place[key] for key in zip(*(own[f"{s}{k}"].to_pylist() for k in range(len(words))), strict=True)] for s in "ab")
        return own.select(columns).filter(pa.array([alike(sets[x], sets[y], similarity) for x, y in zip(a, b, strict=True)], pa.bool_()))

    columns, key = edges.columns, ["g", "low", "high"]
    return both.groupBy(*key).cogroup(texts.select(*key, *words, "text").groupBy(*key)).applyInArrow(run, ", ".join(f"{c} bigint" for c in columns))


def similar_between(labelled: DataFrame, *, rows: DataFrame, docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, scale: Scale, similarity: float) -> DataFrame:
    """Edges (a0, ..., b0, ...) that connect different labels of labelled (f0, ..., reach, label) within a reach, as far as texts of at least `similarity` do.

    All pairs within the scale's distance are looked at where their texts lie, two blocks of a group at a time, nearest
    first; a pair that those before have connected is left out, and only what connects comes out, so that a group of n
    gives n edges for each pair of blocks at most, and not n * n.
    """
    words = scale.columns
    _, texts = in_blocks(labelled, rows, docs, scratch, id_col=id_col, text_col=text_col, scale=scale)

    def run(t: pa.Table) -> pa.Table:
        f = np.stack([t[c].to_numpy() for c in words], axis=1).astype(np.uint64)
        group, label = (t[c].combine_chunks().dictionary_encode().indices.to_numpy() for c in ("reach", "label"))
        block, sets, root, out = t["block"].to_numpy(), shingle_sets(t["text"], scale), list(range(len(t))), []

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        first, second, far, two_blocks = [], [], [], block.min() != block.max()
        for i in range(len(t) - 1):
            rest = np.arange(i + 1, len(t))
            rest = rest[(group[rest] == group[i]) & (label[rest] != label[i])]
            if two_blocks:
                rest = rest[block[rest] != block[i]]
            d = np.bitwise_count(f[rest] ^ f[i]).sum(axis=1, dtype=np.int64)
            rest, d = rest[d <= scale.distance], d[d <= scale.distance]
            first.append(np.full(len(rest), i)), second.append(rest), far.append(d)
        if first and len(far := np.concatenate(far)):
            first, second = np.concatenate(first), np.concatenate(second)
            for k in np.argsort(far, kind="stable").tolist():
                i, j = int(first[k]), int(second[k])
                x, y = find(int(label[i])), find(int(label[j]))
                if x != y and alike(sets[i], sets[j], similarity):
                    root[max(x, y)] = min(x, y)
                    out.append((i, j))
        a, b = np.array([x for x, _ in out], np.int64), np.array([y for _, y in out], np.int64)
        signed = f.astype(np.int64)
        return pa.table([pa.array(np.ascontiguousarray(signed[x, k])) for x in (a, b) for k in range(scale.words)], names=columns)

    columns = [f"{s}{k}" for s in "ab" for k in range(scale.words)]
    return texts.groupBy("g", "low", "high").applyInArrow(run, ", ".join(f"{c} bigint" for c in columns))


def ordered(edges: DataFrame, scale: Scale) -> DataFrame:
    """Each edge once, with the smaller fingerprint as its a."""
    a, b = ([f"{s}{k}" for k in range(scale.words)] for s in "ab")
    swap = F.struct(*a) > F.struct(*b)
    return edges.select(*[F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in zip(a, b, strict=True)], *[F.when(swap, F.col(x)).otherwise(F.col(y)).alias(y) for x, y in zip(a, b, strict=True)]).distinct()


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, scale: Scale = WIDE) -> DataFrame:
    """The rows of docs, with all their columns, without near duplicates of rows that stay.

    Rows are linked if their fingerprints are within the scale's distance and their texts have at least
    `similarity` on distinct five-word shingles. Of each group that links connect one row stays: the one
    with the smallest id, then the smallest text hash; rows with a null id come last. Equal rows are one
    and stay once. Null and empty texts are equal texts. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch, words = Scratch(spark), scale.columns
    rows = scratch.save(fingerprints(docs, id_col=id_col, text_col=text_col, scale=scale))
    reps = rows.select(*words).distinct()
    name = lambda s: F.concat(*[F.lpad(F.hex(f"{s}{k}"), 16, "0") for k in range(scale.words)])
    named_edges = lambda df: df.select(name("a").alias("a"), name("b").alias("b"))
    edges = scratch.save(ordered(links(reps, scale, scratch), scale))
    reach = components(named_edges(edges), Scratch(spark)).select("node", F.col("component").alias("reach"))
    reach = scratch.save(reps.withColumn("node", name("f")).join(reach, "node"))
    options = {"rows": rows, "docs": docs, "scratch": scratch, "id_col": id_col, "text_col": text_col, "scale": scale, "similarity": similarity}
    kept = scratch.save(similar(edges, reach.select(*words, "reach"), **options))
    found = scratch.save(components(named_edges(kept), Scratch(spark)))
    failed = scratch.save(edges.join(kept, edges.columns, "left_anti"))
    if not failed.isEmpty():
        touched = small(scratch.save(failed.select(*[F.col(f"a{k}").alias(c) for k, c in enumerate(words)]).join(reach, words).select("reach").distinct()))
        again = reach.join(touched, "reach", "left_semi").join(found, "node", "left")
        again = scratch.save(again.select(*words, "reach", F.coalesce("component", "node").alias("label")))
        more = scratch.save(similar_between(again, **options))
        if not more.isEmpty():
            found = scratch.save(components(named_edges(kept.unionByName(more)), Scratch(spark)))
    named = rows.withColumn("node", name("f")).join(found, "node", "left").select("id", "version", F.coalesce("component", "node").alias("component"))
    named = scratch.save(named.groupBy("id", "version", "component").agg(F.count("*").alias("n")))
    # of a group's rows the first by id and version; min() is summed up before the shuffle, so a large group is no burden
    place = F.struct(F.col("id").isNull().alias("nameless"), "id", "version")
    first = scratch.save(named.groupBy("component").agg(F.min(place).alias("stays"), F.count("*").alias("size")).where("size > 1").select("component", "stays"))
    goes = scratch.save(named.join(first, "component").where(place != F.col("stays")).select(F.col("id").alias("_id"), F.col("version").alias("_version")))
    own = docs.select(*[F.col(c).alias(f"own_{k}") for k, c in enumerate(docs.columns)])
    of = lambda c: F.col(f"own_{docs.columns.index(c)}")
    kept = own.withColumn("_hash", F.xxhash64(of(text_col))).join(small(goes), of(id_col).eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_version")), "left_anti")
    if not named.where("n > 1").isEmpty():  # rows that share id and text
        kept = kept.dropDuplicates([f"own_{docs.columns.index(id_col)}", "_hash"])
    return kept.select(*[of(c).alias(c) for c in docs.columns])


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
