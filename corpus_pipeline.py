"""From raw documents to packed training sequences.

Stages, in order: weak-label quality, MinHash near-dedup, benchmark
decontamination, personal-data masking, packing. Each is written as Parquet in
the cluster's shared folder and read back as the next one's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from termloom.llm import common, decontam, neardup, packing, pii, quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier takes for neither junk nor abuse."""
    judged = quality.classify(spark, docs.select(*COLUMNS), common.read(spark, sf_dir, "labels"))
    return judged.where("keep").select(*COLUMNS)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group, the one of least doc_id. Rows that share a
    doc_id or have none are told apart by their texts, and count after all others."""
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias("odd_id"), F.lit(True).alias("odd")).checkpoint()
    if ids.isEmpty():
        gone = neardup.near_duplicates(spark, docs).where(~F.col("kept")).select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)
    by_text = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2)
    rows = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("odd_id")), "left")
    rows = rows.withColumn("node", F.when(F.col("odd"), by_text).otherwise(F.col("doc_id")))
    gone = neardup.near_duplicates(spark, rows.select(F.col("node").alias("doc_id"), "text")).where(~F.col("kept")).select(F.col("doc_id").alias("node"))
    left = rows.join(gone, "node", "left_anti")
    return left.where("odd is null").union(left.where("odd").dropDuplicates(["node"])).select(*COLUMNS)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontam.uncontaminated(spark, docs.select(*COLUMNS), common.read(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by the kind's name."""
    common.prepare(spark)
    masked = docs.withColumn("text", pii.redacted(F.col("text").cast("string")))
    return masked.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of each document, with its place in the packed sequences."""
    return packing.pack(spark, docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", keep_quality),
    ("near_dedup", keep_distinct),
    ("benchmark_decontamination", keep_uncontaminated),
    ("personal_data", mask_personal_data),
    ("best_fit_packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    common.prepare(spark)
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.table(spark, stage(spark, docs, sf_dir), name)
    return docs
