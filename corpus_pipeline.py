"""Training-data pipeline over ``documents``: each stage works on all that the stage before it kept.

1. quality: documents that the positive-unlabelled classifier scores below 0.7 go.
2. lines: boilerplate lines that stand on many sites go from the texts.
3. near_duplicates: one document of each group of near-duplicates stays (5 words, similarity 0.8).
4. repeats: strings of at least 250 bytes (some 40 words) that stand more than once go from the texts.
5. packing: the remaining texts, tokenized, in windows of 1024 tokens.

Every stage but the last returns the columns of its input, extra ones with their values whatever their
names (but ``n_lines`` and ``n_lines_removed``, which the line stage counts anew); ``n_chars`` follows the
text.  Null texts count as empty; texts of any length are read whole, in Arrow batches bounded by bytes.
Of near-duplicates the row with the smallest id stays; rows whose id is null are never taken for
duplicates of others, but rows equal in id and text are, and one of them stays.  An empty table passes
through.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmetrics.llm import line_dedup, minhash, packing, pu_quality, suffix_dedup
from postmetrics.llm.q_packing import vocabulary
from postmetrics.llm.registry import prepare
from postmetrics.llm.staging import stage

QUALITY_THRESHOLD = 0.7
MIN_SITES = 10
SIMILARITY_PERCENT = 80
REPEAT_BYTES = 250


def _with_text(columns: list, text: Column, of) -> list:
    """``columns`` with ``text`` as the text and its length as n_chars; ``of`` gives any other column."""
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return [new[c].alias(c) if c in new else of(c).alias(c) for c in columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    labels = spark.read.parquet(os.path.join(sf_dir, "labels.parquet"))
    scored = pu_quality.score(docs, pu_quality.train(docs, labels), keep=docs.columns)
    return scored.where(F.col("score") >= QUALITY_THRESHOLD).select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    cleaned = line_dedup.remove_boilerplate(docs, MIN_SITES)
    return cleaned.select(*_with_text(docs.columns, F.col("text"), F.col))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    judged = minhash.near_duplicates(docs, 5, SIMILARITY_PERCENT, text_hash=True)
    gone = judged.where(~F.col("kept")).select(F.col("doc_id").alias("own_id"), F.col("text_hash").alias("own_text")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_text"))
    return rows.join(gone, ["own_id", "own_text"], "left_anti").dropDuplicates(["own_id", "own_text"]).select("row.*")


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    cut = suffix_dedup.remove_repeats(docs, REPEAT_BYTES, keep=docs.columns)
    return cut.select(*_with_text(docs.columns, F.col("kept_text"), lambda c: F.col("row")[c]))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.pack_documents(docs, vocabulary())


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("repeats", repeats), ("packing", pack)]

#: Scores, signatures and token ids have no SQL form; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as a table and read again by the next."""
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
