"""Corpus pipeline over ``documents``: each stage's result is written as Parquet and read again as the next one's input.

Null or repeated doc_ids, null and empty texts and empty tables are handled as the operators define. Extra columns pass
through the first four stages, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solvara.llm.contamination import without_leaks
from solvara.llm.joins import with_small
from solvara.llm.near_dups import near_duplicates
from solvara.llm.packing import pack_documents
from solvara.llm.quality import fit, scored
from solvara.llm.substrings import without_repeats
from solvara.llm.textkit import column, unused
from solvara.storage import shared_dir, staged


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose label 1 is the likelier one."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = unused(docs, "score")
    return scored(docs, model, score).where(F.col(score) >= 0.5).select(*map(column, docs.columns))


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that of the least doc_id."""
    own, mark = unused(docs, "gone_id"), unused(docs, "gone_hash")
    gone = staged(near_duplicates(docs).where("not kept").select(F.col("doc_id").alias(own), F.col("text_hash").alias(mark)).distinct())
    return with_small(docs, gone, F.col("doc_id").cast("long").eqNullSafe(F.col(own)) & (F.xxhash64("text") == F.col(mark)), "left_anti")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 13 words that an earlier document has; a text of such passages alone goes."""
    words, removed = unused(docs, "n_words"), unused(docs, "n_removed")
    cut = without_repeats(docs, tidy=False, n_words=words, n_removed=removed).where((F.col(removed) == 0) | (F.col(removed) < F.col(words)))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cut.select(*map(column, docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 2048 token ids: a row for each piece, with its ids as little-endian unsigned 32-bit integers."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicate_filter),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL has no learned scores and no tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
