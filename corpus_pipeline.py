"""A corpus from documents to packed sequences, as five stages; each works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.llm import lines, packing, secrets, simhash, toxicity
from labelweave.llm.common import Scratch, table

#: No SQL can express the first stage's classifier, so the rows are tested against a brute-force version.
ORACLE_SQL = None
#: Chunks that the last stage remembers: fewer than packing alone does, as the executors' heaps are full by then.
REMEMBERED = 250_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose whole text scores under 0.5; the tagger learns from labelled rows of docs outside the held-out fold.
    Null and empty texts score as texts without tokens and stay; equal rows share their fate; an empty table stays empty."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of lines that one with a smaller doc_id holds; those that have no words left go.
    Rows with a null doc_id or text stay as they are, equal rows stay equal, an empty table stays empty."""
    return lines.dedup_lines(docs, count_col="n_chars", drop_emptied=True)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: five-word shingles, a similarity of 0.8 or more. The smallest
    doc_id stays, rows without one go first, equal rows stay once, null and empty texts are equal; an empty table stays empty."""
    return simhash.drop_near_duplicates(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of every secret. Null texts stay null and n_chars follows the text;
    equal rows stay equal; an empty table stays empty."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two sequences of all documents. A null or empty text is one piece with the end id alone; equal
    rows are packed each for itself; an empty table gives no rows."""
    return packing.pack(docs, remembered=REMEMBERED).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("near_duplicates", drop_near_duplicates), ("secrets", redact_secrets), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for k, (_, stage) in enumerate(STAGES):
        mark = Scratch.mark()
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.save(docs)
            scratch.drop(keep=1)
            Scratch.drop_since(mark)  # what the stage itself had written
    return docs
