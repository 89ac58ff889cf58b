"""The document pipeline: each stage is one of the operators, and its decisions take effect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, jaccard, line_dedup, pieces, toxicity
from ledgerloom.llm.scratch import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with row_id, a number of the row by which the stages filter and replace rows: its doc_id if all are distinct and not null, else its place.

    Places follow doc_id, rows without one last, then a hash of the row, and are written once. Exact repeats get different ones.
    """
    if "row_id" in docs.columns:
        return docs
    docs = docs.select(*COLUMNS)
    repeated = docs.groupBy("doc_id").count().where("doc_id is null or count > 1")
    if repeated.isEmpty():
        return docs.withColumn("row_id", F.col("doc_id").cast("long"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("hash"), F.col("scan")]
    dealt = docs.withColumn("hash", F.xxhash64("text", "lang", "source", "n_chars")).withColumn("scan", F.monotonically_increasing_id())
    return table(dealt.repartitionByRange(*order).sortWithinPartitions(*order).select(*COLUMNS, F.monotonically_increasing_id().alias("row_id")))


def by_row(docs: DataFrame) -> DataFrame:
    """What the operators read: the row's number is their doc_id."""
    return docs.select(F.col("row_id").alias("doc_id"), "text", "lang", "source", "n_chars")


def without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose row_id isn't a doc_id of ``rejected``."""
    return docs.join(rejected.select(F.col("doc_id").alias("row_id")), "row_id", "left_anti").select(*COLUMNS, "row_id")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows that the classifier predicts toxic. Each row is judged by its own text, null ones as empty; repeats share their verdict, and an empty table stays empty."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = numbered(docs)
    return without(docs, toxicity.classify(by_row(docs), labels, docs).where("predicted = 1"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, their texts without lines of windows that stood before, in order of row_id; n_chars is counted anew, null for a null text. No row goes, even if its text becomes empty."""
    docs = numbered(docs)
    kept = line_dedup.dedup(by_row(docs)).select(F.col("doc_id").alias("row_id"), "kept_text")
    out = docs.join(kept, "row_id")
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"), "row_id")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the row of the smallest row_id; rows without words are classes of their own and stay."""
    docs = numbered(docs)
    return without(docs, jaccard.classes(by_row(docs)).where("not kept"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows that overlap an item of the benchmark; null and empty texts stay, and so does everything if the benchmark is empty."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    docs = numbered(docs)
    return without(docs, decontaminate.decontaminate(by_row(docs), benchmark).where("contaminated"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each row that is left, encoded and decoded, as ``pieces.round_trip`` tells."""
    return pieces.round_trip(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("jaccard_join", one_of_each_group), ("decontaminate", drop_benchmark), ("sentencepiece", encode)]

#: The classifier, MinHash and Viterbi stages aren't SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; between stages the rows are a written table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = docs if k == len(STAGES) - 1 else table(docs)
    return docs
