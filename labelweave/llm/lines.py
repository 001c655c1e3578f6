"""Line dedup by pairwise alignment.

A document loses every run of consecutive lines with enough words that an earlier document holds as
consecutive lines too. Overlapping documents are found through hashes of lines (where lines are short, of
the shortest runs of lines with enough words). A rare hash, of which few documents are holders, pairs each
of them with every earlier one. A common one pairs each later holder with the first holder alone, which is
enough, as that one holds these very lines; so a line that a third of all documents share proposes one
partner for each of them and not all pairs.

A pair is aligned by patience diff over the lines that both hold: lines that are unique in both are anchors,
the longest increasing sequence of anchors stays, stretches between anchors are aligned in turn, and matches
extend over equal neighbours. Common blocks of the alignment go from the later document. What is left is
aligned again: runs that the earlier document holds in another place are cut into stretches within which both
documents have the same order, and each stretch is aligned for itself.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.llm.common import Scratch, held, slices, table

#: Words that a block has at least. Shorter ones are common phrases.
LEAST_WORDS = 5
#: Documents that hold a rare hash, at most; more only adds pairs, and results don't depend on it.
RARE = 4


def line_rows(text: str) -> list[tuple[int, bytes, int]]:
    """(line, key, words) for each line with words; outer white space doesn't count."""
    stripped = ((at, line.strip()) for at, line in enumerate(text.split("\n")))
    return [(at, xxhash.xxh3_128_digest(line.encode("utf-8", "replace")), len(line.split())) for at, line in stripped if line]


def runs(words: list[int], least_words: int) -> list[tuple[int, int]]:
    """(first, last) of the shortest runs of lines with `least_words` words that start or end at a line."""
    sums = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    ends = np.searchsorted(sums, sums[:-1] + least_words) - 1
    starts = np.searchsorted(sums, sums[1:] - least_words, "right") - 1
    return sorted({(k, b) for k, b in enumerate(ends.tolist()) if b < len(words)} | {(a, k) for k, a in enumerate(starts.tolist()) if a >= 0})


def version(text: Column) -> Column:
    """Tells rows with one id and different texts apart."""
    return F.xxhash64(text)


def single_texts(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """(doc, version, text) of the rows with an id and a text, each once; only rows that are repeated are shuffled."""
    texts = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc"), version(F.col(text_col)).alias("version"), F.col(text_col).alias("text"))
    again = scratch.save(texts.groupBy("doc", "version").count().where("count > 1").select("doc", "version"))
    if again.isEmpty():
        return texts
    key = ["doc", "version"]
    return texts.join(again, key, "left_anti").unionByName(texts.join(again, key, "left_semi").dropDuplicates(key))


def keyed_lines(texts: DataFrame, least_words: int) -> DataFrame:
    """(doc, version, run, k1, k2, at, lines, words) of texts (doc, version, text).

    A row with run = false is a distinct line of the document: k1 and k2 are its hash's 128 bits, `at` lists
    its places among the lines with words and `lines` those in the text. A row with run = true is a distinct
    shortest run, with the hash of its lines.
    """
    kind = texts.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("lines", lambda: None)  # lets other operators' memory go
        for batch in (part for whole in batches for part in slices(whole, "text")):
            row, is_run, keys, at, lines, words = [], [], [], [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                own, places = line_rows(text), {}
                for n, (_, key, _) in enumerate(own):
                    places.setdefault(key, []).append(n)
                spans = {b"".join(x[1] for x in own[a : b + 1]) for a, b in runs([x[2] for x in own], least_words)}
                row += [k] * (len(places) + len(spans))
                is_run += [False] * len(places) + [True] * len(spans)
                keys += [*places, *map(xxhash.xxh3_128_digest, spans)]
                at += [*places.values(), *([] for _ in spans)]
                lines += [*([own[n][0] for n in p] for p in places.values()), *([] for _ in spans)]
                words += [*(own[p[0]][2] for p in places.values()), *(0 for _ in spans)]
            bits, take = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2), pa.array(row, pa.int64())
            columns = [batch.column("doc").take(take), batch.column("version").take(take), pa.array(is_run, pa.bool_()), pa.array(bits[:, 0]), pa.array(bits[:, 1])]
            numbers = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(at, numbers), pa.array(lines, numbers), pa.array(words, pa.int32())], names=["doc", "version", "run", "k1", "k2", "at", "lines", "words"])

    return texts.mapInArrow(run, f"doc {kind}, version bigint, run boolean, k1 bigint, k2 bigint, at array<int>, lines array<int>, words int")


def increasing(second: list[int]) -> list[int]:
    """Indices of a longest increasing sequence, by patience sorting."""
    tops, piles, back = [], [], []
    for k, b in enumerate(second):
        at = bisect_left(tops, b)
        back.append(piles[at - 1] if at else -1)
        tops[at : at + 1], piles[at : at + 1] = [b], [k]
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched places (i, j) of two sequences, both increasing: anchors are values that are unique in both."""
    out, stretches = [], [(0, len(a), 0, len(b))]
    while stretches:
        i, i_end, j, j_end = stretches.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            out.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        once_a, once_b = Counter(a[i:i_end]), Counter(b[j:j_end])
        place = {b[q]: q for q in range(j, j_end) if once_b[b[q]] == 1}
        both = [(p, place[a[p]]) for p in range(i, i_end) if once_a[a[p]] == 1 and a[p] in place]
        chosen = [both[k] for k in increasing([q for _, q in both])]
        for p, q in chosen:
            out.append((p, q))
            stretches.append((i, p, j, q))
            i, j = p + 1, q + 1
        if chosen:
            stretches.append((i, i_end, j, j_end))
    return sorted(out)


def blocks(shared: list[dict], least_words: int) -> list[int]:
    """Lines of the text that a document loses to an earlier one.

    shared: the distinct lines of both, as (at, there, lines, words): the places in either document, in order.
    """
    own = sorted((n, k, line) for k, x in enumerate(shared) for n, line in zip(x["at"], x["lines"], strict=True))
    other = sorted((n, k) for k, x in enumerate(shared) for n in x["there"])
    words, gone, block = [shared[k]["words"] for _, k, _ in own], set(), []
    for i, j in [*patience([x[1] for x in own], [x[1] for x in other]), (-1, -1)]:
        if block and (i < 0 or own[i][0] != own[block[-1][0]][0] + 1 or other[j][0] != other[block[-1][1]][0] + 1):
            if sum(words[p] for p, _ in block) >= least_words:
                gone.update(p for p, _ in block)
            block = []
        block.append((i, j))
    if len(gone) < len(own):
        for spans in moved(shared, own, other, gone, least_words):
            for k, _ in patience(list(range(len(spans))), [k for k, _ in sorted(enumerate(spans), key=lambda x: x[1][0])]):
                for a, b in spans[k][1]:
                    gone.update(range(a, b + 1))
    return sorted(own[p][2] for p in gone)


def moved(shared: list[dict], own: list[tuple], other: list[tuple], gone: set[int], least_words: int) -> Iterator[list[tuple[int, list[tuple[int, int]]]]]:
    """Stretches of what is left, of the distinct shortest runs with a line that has not gone and that the other document holds.

    A run comes as its first place there and all its spans (first, last) here; within a stretch the places there increase.
    """

    def spans(places: list[int], codes: list[int]) -> list[tuple[int, int]]:
        cut = [0, *(p for p in range(1, len(places)) if places[p] != places[p - 1] + 1), len(places)]
        return [(s + a, s + b) for s, e in zip(cut, cut[1:]) for a, b in runs([shared[c]["words"] for c in codes[s:e]], least_words)]

    codes, there = [x[1] for x in other], {}
    for a, b in spans([x[0] for x in other], codes):
        there.setdefault(tuple(codes[a : b + 1]), a)
    codes, left = [x[1] for x in own], {}
    for a, b in spans([x[0] for x in own], codes):
        if (key := tuple(codes[a : b + 1])) in there and not gone.issuperset(range(a, b + 1)):
            left.setdefault(key, []).append((a, b))
    stretch: list[tuple[int, list[tuple[int, int]]]] = []
    for key, here in left.items():
        if stretch and there[key] < stretch[-1][0]:
            yield stretch
            stretch = []
        stretch.append((there[key], here))
    if stretch:
        yield stretch


def removals(docs: DataFrame, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc, version, gone): for documents that lose lines, whether each line goes, up to the last that does."""
    least_words = max(1, least_words)
    rows = scratch.save(keyed_lines(single_texts(docs, id_col, text_col, scratch), least_words))
    spans = rows.where("run").select("doc", "version", "k1", "k2")
    first = spans.groupBy("k1", "k2").agg(F.min(F.struct("doc", "version")).alias("tried"), F.max("doc").alias("latest"), F.count("*").alias("holders")).where("latest > tried.doc").select("k1", "k2", "tried", "holders")
    held_ = scratch.save(spans.join(scratch.save(first), ["k1", "k2"]))
    common = held_.where(F.col("holders") > RARE).select("doc", "version", F.col("tried").alias("to"))
    holder = F.struct("doc", "version")
    rare = held_.where(F.col("holders") <= RARE).groupBy("k1", "k2").agg(F.collect_list(holder).alias("own"))  # at most RARE holders
    rare = rare.select("own", F.explode("own").alias("to")).select(F.explode("own").alias("later"), "to").select("later.doc", "later.version", "to")
    pairs = common.unionByName(rare).where("doc > to.doc").select("doc", "version", F.col("to.doc").alias("there"), F.col("to.version").alias("at_version")).distinct()
    own = rows.where("not run")
    there = own.select(F.col("doc").alias("there"), F.col("version").alias("at_version"), "k1", "k2", F.col("at").alias("places"))
    both = own.join(scratch.save(pairs), ["doc", "version"]).join(there, ["there", "at_version", "k1", "k2"])
    listed = both.groupBy("doc", "version", "there", "at_version").agg(F.collect_list(F.struct("at", F.col("places").alias("there"), "lines", "words")).alias("shared"))
    kind = docs.schema[id_col].dataType.simpleString()

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [blocks(shared.as_py(), least_words) for shared in batch.column("shared")]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("version"), pa.array(found, pa.list_(pa.int32()))], names=["doc", "version", "gone"])

    def masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for numbers in batch.column("gone").to_pylist():
                mask = np.zeros(max(numbers) + 1, bool)
                mask[numbers] = True
                found.append(mask)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("version"), pa.array(found, pa.list_(pa.bool_()))], names=["doc", "version", "gone"])

    aligned = listed.mapInArrow(align, f"doc {kind}, version bigint, gone array<int>").where("size(gone) > 0")
    merged = aligned.groupBy("doc", "version").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))
    return merged.mapInArrow(masks, f"doc {kind}, version bigint, gone array<boolean>")


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None, least_words: int = LEAST_WORDS, drop_emptied: bool = False, counts: bool = False) -> DataFrame:
    """The rows of docs without the runs of lines that any document with a smaller id holds as well.

    Rows that share an id are one document in several versions: they don't lose lines to one another, and
    equal rows get equal texts. Rows with a null id or a null text stay as they are; empty texts have no
    lines to lose; lines without words stay. `count_col` names a column to hold the new number of
    characters. `counts` adds n_lines and n_removed. With `drop_emptied`, documents that had words and
    lose all of them go. An empty table gives no rows; other columns are carried along.
    """
    scratch = Scratch(docs.sparkSession)
    gone = removals(docs, scratch, id_col=id_col, text_col=text_col, least_words=least_words)
    gone = scratch.save(gone).select(F.col("doc").alias("_doc"), F.col("version").alias("_version"), F.col("gone").alias("_gone"))
    own = docs.select(*[F.col(c).alias(f"own_{k}") for k, c in enumerate(docs.columns)])
    of = lambda c: F.col(f"own_{docs.columns.index(c)}")
    joined = own.withColumn("_version", version(of(text_col))).withColumnRenamed(f"own_{docs.columns.index(id_col)}", "_doc").join(gone, ["_doc", "_version"], "left")
    joined = joined.withColumnRenamed("_doc", f"own_{docs.columns.index(id_col)}")
    split = F.split(of(text_col), "\n", -1)
    kept = F.when(F.col("_gone").isNull(), of(text_col)).otherwise(F.array_join(F.filter(split, lambda x, i: ~F.coalesce(F.get("_gone", i), F.lit(False))), "\n"))
    joined = joined.withColumn("_text", kept)
    if drop_emptied:
        joined = joined.where(F.col("_gone").isNull() | F.col("_text").rlike(r"\S"))
    out = [F.col("_text").alias(c) if c == text_col else F.length("_text").cast(docs.schema[c].dataType).alias(c) if c == count_col else of(c).alias(c) for c in docs.columns]
    if counts:
        out += [F.coalesce(F.size(split), F.lit(0)).alias("n_lines"), F.coalesce(F.size(F.filter("_gone", lambda x: x)), F.lit(0)).alias("n_removed")]
    return joined.select(*out)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the lines that are left of it."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True).select("doc_id", "n_lines", "n_removed", "text")
