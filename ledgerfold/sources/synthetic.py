"""Keys, values and operations to load a log with, the same for the same seed on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def _hash(column: Column, *salt) -> Column:
    """A number from 0 to 1 that depends on the row's number and the salt only."""
    return F.pmod(F.xxhash64(column, *[F.lit(s) for s in salt]), F.lit(1 << 52)) / float(1 << 52)


def keys(spark: SparkSession, n: int, seed: int = 0, least: int = 5, most: int = 256) -> DataFrame:
    """(key_no, key): n keys of least to most characters."""
    own = spark.range(n).withColumnRenamed("id", "key_no")
    length = (F.lit(least) + F.floor(_hash(F.col("key_no"), seed, "length") * (most - least + 1))).cast("int")
    text = F.repeat(F.sha2(F.concat_ws("-", F.lit(str(seed)), "key_no"), 256), most // 64 + 1)
    return own.select("key_no", F.substring(text, F.lit(1), length).cast("binary").alias("key"))


def values(spark: SparkSession, n: int, seed: int = 0, small: int = 2048, large: int = 102_400, share: float = 0.9) -> DataFrame:
    """(value_no, value): n values, of which a share has 100 to small bytes and the rest up to large."""
    own = spark.range(n).withColumnRenamed("id", "value_no")
    is_small, at = _hash(F.col("value_no"), seed, "class") < share, _hash(F.col("value_no"), seed, "size")
    size = F.when(is_small, 100 + F.floor(at * (small - 99))).otherwise(small + 1 + F.floor(at * (large - small))).cast("int")
    text = F.repeat(F.md5(F.concat_ws("-", F.lit(str(seed)), "value_no")), large // 32 + 1)
    return own.select("value_no", F.substring(text, F.lit(1), size).cast("binary").alias("value"))


def picks(spark: SparkSession, n: int, pool: int, seed: int = 0) -> DataFrame:
    """(pick_no, key_no): n picks from a pool of keys, with replacement."""
    own = spark.range(n).withColumnRenamed("id", "pick_no")
    return own.select("pick_no", F.floor(_hash(F.col("pick_no"), seed, "pick") * pool).cast("bigint").alias("key_no"))


def mutated(keys_: DataFrame, round_no: int, seed: int = 0, duplicates: float = 0.05, replacements: float = 0.05) -> DataFrame:
    """(key_no, key): a pool of keys in which a share of the places has another place's key, and a share a new one."""
    n = keys_.count()
    own = keys_.withColumn("_p", _hash(F.col("key_no"), seed, round_no, "what"))
    other = F.floor(_hash(F.col("key_no"), seed, round_no, "other") * n).cast("bigint")
    source = keys_.select(F.col("key_no").alias("_from"), F.col("key").alias("_key"))
    fresh = F.sha2(F.concat_ws("-", F.lit(str(seed)), F.lit(str(round_no)), "key_no"), 256).cast("binary")
    joined = own.withColumn("_from", F.when(F.col("_p") < duplicates, other)).join(source, "_from", "left")
    return joined.select("key_no", F.when(F.col("_p") < duplicates, F.col("_key")).when(F.col("_p") < duplicates + replacements, fresh).otherwise(F.col("key")).alias("key"))


def operations(spark: SparkSession, n: int, weights: dict[str, float], seed: int = 0) -> DataFrame:
    """(op_no, op): n operations drawn by weight."""
    total, upto, op = sum(weights.values()), 0.0, None
    at = _hash(F.col("op_no"), seed, "op")
    for name, weight in weights.items():
        upto += weight / total
        op = F.when(at < upto, name) if op is None else op.when(at < upto, name)
    return spark.range(n).withColumnRenamed("id", "op_no").withColumn("op", op.otherwise(list(weights)[-1]))
