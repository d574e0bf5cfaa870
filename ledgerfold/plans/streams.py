"""Queries that run as streams until their input ends, and give what they left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.change_feed import FeedTable, live_values
from ..session import Folder, ship, table, work_folder
from ..sources import log as log_source
from ..streaming import folds

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return log_source.follow_files(spark, f"{sf_dir}/{name}.parquet", table(spark, sf_dir, name).schema, 8)


def latest_of(rows: DataFrame, folder: Folder, keys: list[str], order: list[str], carry: list[str], mode: str = "append") -> DataFrame:
    """The last row of each key of a stream that ends, kept in a table batch by batch."""
    latest = folds.LatestTable(rows.sparkSession, folder / "latest", rows.schema, keys, order, carry)
    rows.writeStream.outputMode(mode).foreachBatch(latest.apply).option("checkpointLocation", folder / "checkpoint").trigger(availableNow=True).start().awaitTermination()
    return latest.read()


@query
def stream_kv_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each user, merged batch by batch into a table."""
    rows = latest_of(stream(spark, sf_dir, "events"), work_folder(spark, "stream"), ["user_id"], ["event_id"], ["event_type", "value"])
    return rows.where("event_type <> 'error'").select("user_id", "event_id", "event_type", "value")


@query
def stream_log_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live values that a streamed log leaves in a table with delete vectors."""
    folder = work_folder(spark, "stream")
    feed = FeedTable(spark, folder / "table")
    folds.into_table(log_source.follow(spark, f"{sf_dir}/log_records.parquet"), feed, folder / "checkpoint").awaitTermination()
    return live_values(feed.read())


@query
def stream_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log streamed to files by namespace and stretch, and read back from them."""
    folder = work_folder(spark, "stream")
    folds.to_objects(log_source.follow(spark, f"{sf_dir}/log_records.parquet"), folder / "out", folder / "checkpoint", 1024).awaitTermination()
    back = spark.read.schema("ns_name string, lsn bigint, stretch bigint").parquet(folder / "out").select("ns_name", "stretch", "lsn").distinct()
    return back.groupBy("ns_name", "stretch").agg(F.count("*").alias("n_records"), F.max("lsn").alias("last_lsn"))


@query
def stream_notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change messages of all entries that change something, those of transactions at their commit, each once, by topic and operation."""
    folder = work_folder(spark, "stream")
    feed = FeedTable(spark, folder / "table")
    step = folds.notifying(feed, folder / "out")
    log_source.follow(spark, f"{sf_dir}/log_records.parquet").writeStream.foreachBatch(step).option("checkpointLocation", folder / "checkpoint").trigger(availableNow=True).start().awaitTermination()
    sent = spark.read.schema("message string, topic string").json(folder / "out").distinct()
    return sent.groupBy("topic", F.get_json_object("message", "$.operation").alias("operation")).agg(F.count("*").alias("n"))


@query
def stream_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day and type in tumbling windows, each with its last count when the input ends, open ones too."""
    rows = folds.windowed(stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day", "100 years", ["event_type"], [F.count("*").alias("n")])
    flat = rows.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")
    return latest_of(flat, work_folder(spark, "stream"), ["day", "event_type"], ["n"], ["n"], "update")


@query
def stream_aborts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions that a reaper ends while the log streams by, by the time of arrival."""
    ship(spark)
    folder = work_folder(spark, "stream")
    out = folds.aborted(stream(spark, sf_dir, "log_records"), "ingested_at", "1 hour")
    out.writeStream.format("parquet").option("path", folder / "out").option("checkpointLocation", folder / "checkpoint").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(out.schema).parquet(folder / "out")
    return found.select("ns_name", F.hex("txn_id").alias("txn_id"), "first_lsn", "n_records")
