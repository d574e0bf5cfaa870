"""Queries of the general data-processing operators (p1 to p5)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import compare, skew
from ..operators.change_feed import FeedTable, live_values
from ..operators.dedup import DedupStore
from ..operators.incremental import IncrementalStore, literal, outstanding_step
from ..session import staged, table, work_folder


def middle_of(log: DataFrame, column: str):
    """Half way between the lowest and the highest value of a column; None if there is none."""
    lo, hi = log.agg(F.min(column), F.max(column)).first()
    return None if lo is None else lo + (hi - lo) / 2


def arrival_halves(log: DataFrame) -> list[DataFrame]:
    """The log as two batches, cut in the middle of its time of arrival; rows without that time are in the first."""
    middle = middle_of(log, "ingested_at")
    if middle is None:
        return [log]
    # compared as it is stored, so that the scan skips row groups of the other half
    late = F.col("ingested_at") > literal(middle, log.schema["ingested_at"].dataType)
    return [log.where(~late | F.col("ingested_at").isNull()), log.where(late)]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = FeedTable(spark, work_folder(spark, "p1").path)
    for batch in arrival_halves(table(spark, sf_dir, "log_records")):
        feed.apply(batch)
    return live_values(feed.read())


def key_rows(spark: SparkSession, sf_dir: str, value: Callable[[str], Column]) -> DataFrame:
    """(rec_kind, ns_name, key, value, entry_no) with places: a row for each put, and for each entry of the log."""
    place = [skew.FILE, skew.BLOCK, skew.POS]
    puts = skew.positioned(table(spark, sf_dir, "put_requests"), "ns_name", F.col("put_key").alias("key"), value("put_value").alias("value"))
    log = skew.positioned(table(spark, sf_dir, "log_records"), "ns_name", "entries")
    log = log.select("ns_name", *place, F.posexplode("entries").alias("entry_no", "e"))
    return puts.select(F.lit("put_requests").alias("rec_kind"), "ns_name", "key", "value", F.lit(0).alias("entry_no"), *place).unionByName(
        log.select(F.lit("log_records").alias("rec_kind"), "ns_name", F.col("e.entry_key").alias("key"), value("e.entry_value").alias("value"), "entry_no", *place)
    )


KEYS = ["rec_kind", "ns_name", "key"]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = key_rows(spark, sf_dir, lambda v: F.xxhash64(v))
    # one row per key, written once: the totals and the keys' own counts are both taken from it
    results = staged(skew.per_key(rows, KEYS, "value", ["entry_no"]), work_folder(spark, "p2"), "keys")
    return skew.heavy(results, 50, ["rec_kind"]).where("key IS NOT NULL").select("rec_kind", "ns_name", F.hex("key").alias("key_hex"))


def p2_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every key, null ones too: its rows, null values, and the changes of its value in order of arrival."""
    results = skew.per_key(key_rows(spark, sf_dir, F.col), KEYS, "value", ["entry_no"])
    return results.select("rec_kind", "ns_name", F.hex("key").alias("key_hex"), "n", "nulls", "changes")


FIELDS = ["put_value", "put_ts", "crc32_checksum"]


def kv_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.differences(table(spark, sf_dir, "primary_kv"), table(spark, sf_dir, "replica_kv"), ["ns_name", "put_key"], FIELDS)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.when(~F.col("in_left"), F.array(F.lit("missing_in_primary"))).when(~F.col("in_right"), F.array(F.lit("missing_in_replica")))
    fields = found.otherwise(F.transform("diffs", lambda d: d["field"]))
    return kv_differences(spark, sf_dir).select("ns_name", F.hex("put_key").alias("key_hex"), F.explode(fields).alias("diff_field"))


def p3_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each field that differs, with the value of either side as text."""
    return (
        kv_differences(spark, sf_dir)
        .select("ns_name", "put_key", F.explode("diffs").alias("d"))
        .select("ns_name", F.hex("put_key").alias("key_hex"), F.col("d.field").alias("diff_field"), "d.left_value", "d.right_value")
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over the log as it arrived: to the middle of its time of arrival, and from the first run's watermarks on.
    A record is new when it arrives first, which is the sequence of the watermarks; its LSN may be lower than others' before."""
    log = table(spark, sf_dir, "log_records").select("ns_name", "lsn", "ingested_at")
    store = IncrementalStore(spark, work_folder(spark, "p4").path)
    step = outstanding_step(store, table(spark, sf_dir, "stream_requests"))
    for upto in (middle_of(log, "ingested_at"), None):
        store.run(log, "ingested_at", ["ns_name"], step, upto=upto, first_takes_unordered=True)
    return store.output().select("consumer_id", "ns_name", "lsn")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = table(spark, sf_dir, "stream_batches")
    store = DedupStore(spark, work_folder(spark, "p5").path)
    lo, hi = batches.agg(F.min("batch_id"), F.max("batch_id")).first()
    if lo is None:
        store.ingest(batches)
    else:  # two runs, so that messages repeat within runs and between them
        store.ingest(batches.where(F.col("batch_id") <= (lo + hi) // 2))
        store.ingest(batches.where(F.col("batch_id") > (lo + hi) // 2))
    return store.dropped(batches)


QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_keys": p2_keys,
    "p3_found": p3_found,
    "p3_values": p3_values,
    "p4_found": p4_found,
    "p5_found": p5_found,
}
