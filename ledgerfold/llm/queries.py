"""Queries of the operators on texts (p6 to p8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import leak, quality
from .tokenize import encoded


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(documents(spark, sf_dir))


def eval_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/eval_items.parquet")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak.copies(documents(spark, sf_dir), eval_items(spark, sf_dir))


def p7_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold an item's passage with other numbers, names or units."""
    return leak.same_questions(documents(spark, sf_dir), eval_items(spark, sf_dir))


def text_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.counts_by_words(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/common_words.parquet").select("word"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_counts(spark, sf_dir).where(quality.is_prose()).select("doc_id")


def p8_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and ratios of every document."""
    ratios = ["mean_word_length", "words_per_line", "symbol_ratio", "ended_ratio", "common_ratio"]
    stats = quality.with_ratios(text_counts(spark, sf_dir))
    return stats.select("doc_id", *quality.COUNTS, *[F.round(r, 6).alias(r) for r in ratios], quality.is_prose().alias("is_prose"))


QUERIES = {"p6_ids": p6_ids, "p7_found": p7_found, "p7_changed": p7_changed, "p8_found": p8_found, "p8_stats": p8_stats}
