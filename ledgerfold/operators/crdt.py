"""Conflict-free merges: last-writer-wins registers and grow-only counters. Order, repeats and grouping don't matter."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def lww(updates: DataFrame, keys: list[str], timestamp: str, replica: str, value: str) -> DataFrame:
    """(keys, value, timestamp, replica): the value with the greatest timestamp, of equal ones that of the greatest replica."""
    best = updates.groupBy(*keys).agg(F.max(F.struct(F.col(timestamp).alias("t"), F.col(replica).alias("r"), F.col(value).alias("v"))).alias("b"))
    return best.select(*keys, F.col("b.v").alias(value), F.col("b.t").alias(timestamp), F.col("b.r").alias(replica))


def gcounter(updates: DataFrame, keys: list[str], replica: str, count: str) -> DataFrame:
    """(keys, count): the sum over replicas of the greatest count that each has told."""
    best = updates.groupBy(*keys, replica).agg(F.max(count).alias(count))
    return best.groupBy(*keys).agg(F.sum(count).alias(count))


REGISTER = "value string, timestamp bigint, replica string"
COUNTER = "replica string, count bigint"


def parsed(rows: DataFrame, value: str) -> DataFrame:
    """rows with reg and ctr: a register or counter update read from JSON bytes, null where the value is no such update."""
    text = F.col(value).cast("string")
    reg, ctr = F.from_json(text, REGISTER), F.from_json(text, COUNTER)
    is_json = text.startswith("{")
    return rows.withColumn("reg", F.when(is_json & reg["timestamp"].isNotNull() & reg["replica"].isNotNull(), reg)).withColumn(
        "ctr", F.when(is_json & ctr["count"].isNotNull() & ctr["replica"].isNotNull(), ctr)
    )
