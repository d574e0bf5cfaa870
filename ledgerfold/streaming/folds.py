"""Folds, sinks and timers over a log that grows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import replication, txn
from ..operators.change_feed import FeedTable
from ..operators.parts import PartStore, bucket_of, numbers_of
from ..session import Folder, attempt


def into_table(log: DataFrame, feed: FeedTable, checkpoint: str) -> StreamingQuery:
    """Apply each micro-batch of a streamed log to a table with delete vectors, until no more is there.

    A micro-batch that is run again after a failure changes nothing, since repeated records change nothing.
    """
    return log.writeStream.foreachBatch(lambda batch, _: feed.apply(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once(checkpoint_folder: Folder, step: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """step for foreachBatch, skipped for batches whose commit file is there. The file is written after the step, so a step that
    was done just before a crash is done again: at least once, and exactly once only for steps whose repetition changes nothing."""

    def run(batch: DataFrame, number: int) -> None:
        if not checkpoint_folder.exists(f"batches/{number}.json"):
            step(batch, number)
            checkpoint_folder.commit_json(f"batches/{number}.json", {"batch": number})

    return run


def latest(rows: DataFrame, keys: list[str], order: list[str], carry: list[str]) -> DataFrame:
    """The last row of each key so far, as a streaming aggregation for complete or update mode. State has one row per key."""
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*carry), F.struct(*order)).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in carry])


class LatestTable(PartStore):
    """For foreachBatch: the last row of each key, kept in a table, so that its size is no limit of the executors' memory.

    The table is cut into buckets by key; a micro-batch reads and rewrites those it touches, in a folder of its own, and commits.
    A batch that was committed before and is run again changes nothing. vacuum() removes what is no longer named.
    """

    HELD = {"state"}

    def __init__(self, spark: SparkSession, path: str, rows: T.StructType, keys: list[str], order: list[str], carry: list[str], buckets: int = 16):
        super().__init__(spark, path, buckets=buckets)
        self.keys, self.order, self.columns = keys, order, list(dict.fromkeys([*keys, *order, *carry]))
        fields = ", ".join(f"`{c}` {rows[c].dataType.simpleString()}" for c in self.columns)
        self.PARTS, self.SORTED = {"state": f"{fields}, bucket int"}, {"state": keys}

    def apply(self, batch: DataFrame, number: int) -> None:
        before = self.manifest()
        if number < before.get("next_batch", 0):
            return
        name, bucket = attempt(before["epoch"] + 1), bucket_of(self.keys, before)
        rows = batch.select(*self.columns).withColumn("bucket", bucket)
        touched = numbers_of(rows.agg(F.bitmap_construct_agg(F.col("bucket").cast("bigint"))).first()[0])
        rows = rows.unionByName(self.read_held("state", before, touched))
        rest = [c for c in self.columns if c not in self.keys]
        best = rows.groupBy(*self.keys, "bucket").agg(F.max_by(F.struct(*rest), F.struct(*self.order)).alias("_b")).select(*self.keys, *[F.col(f"_b.{c}").alias(c) for c in rest], "bucket")
        self.write_part(best, "state", name)
        self.commit(before | {"epoch": before["epoch"] + 1, "next_batch": number + 1, "state": self.held_after(before["state"], touched, name, touched)})
        self.vacuum()

    def read(self) -> DataFrame:
        return self.read_held("state", self.manifest()).drop("bucket")


def to_objects(log: DataFrame, path: str, checkpoint: str, per_folder: int = 1 << 16) -> StreamingQuery:
    """The log as files, in a folder for each namespace and stretch of LSNs, from which a follower reads ranges."""
    out = log.withColumn("stretch", F.floor(F.col("lsn") / per_folder))
    return out.writeStream.partitionBy("ns_name", "stretch").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def notifications(log: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """JSON messages for changes outside transactions only, as they come, in a folder for each topic: a stream without a table.
    notifying() tells those of transactions too."""
    plain = txn.plain(txn.entries(log)).where("entry_key IS NOT NULL")
    sent = replication.notifications(plain, F.col("entry_key"))
    return sent.writeStream.partitionBy("topic").format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def notifying(feed: FeedTable, path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: apply a micro-batch to a table, then write JSON messages of what it made effective, by topic. Entries of a
    transaction are told when its commit has come. A batch that is run again tells the same messages again: at least once."""

    def step(batch: DataFrame, _: int) -> None:
        changes = feed.changes(feed.apply(batch))
        replication.notifications(changes, F.col("entry_key")).write.mode("append").partitionBy("topic").json(path)

    return step


def sessions(rows: DataFrame, by: list[str], ts: str, gap: str, late: str) -> DataFrame:
    """Runs of rows without a pause of gap, given out once the watermark, late behind the newest row, has passed them."""
    found = rows.withWatermark(ts, late).groupBy(*by, F.session_window(F.col(ts), gap).alias("w"))
    return found.agg(F.min(ts).alias("started_at"), F.max(ts).alias("ended_at"), F.count("*").alias("n")).drop("w")


def windowed(rows: DataFrame, ts: str, width: str, late: str, by: list[str], what: list[Column]) -> DataFrame:
    """Aggregates by tumbling windows with a watermark."""
    return rows.withWatermark(ts, late).groupBy(F.window(ts, width), *by).agg(*what)


ABORTS = "ns_name string, txn_id binary, first_lsn bigint, n_records bigint"
OPEN = "first_lsn bigint, n_records bigint, first_us bigint"


def aborted(log: DataFrame, ts: str, late: str = "0 seconds", idle_ms: int = 120_000, age_ms: int = 900_000) -> DataFrame:
    """ABORTS of transactions without a commit that were idle for idle_ms, or older than age_ms, in event time.

    State is one row per open transaction; a commit or an abort ends it. Append mode.
    """

    def step(key: tuple, batches: Iterator, state) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            first, n, _ = state.get
            state.remove()
            yield pd.DataFrame({"ns_name": [key[0]], "txn_id": [key[1]], "first_lsn": [first], "n_records": [n]})
            return
        first, n, began = state.get if state.exists else (None, 0, None)
        newest, done = None, False
        for pdf in batches:
            done |= bool((pdf["txn_state"] == txn.COMMIT).any())
            us = pdf["us"].dropna()
            if len(us):
                newest = max(newest or 0, int(us.max()))
                began = min(began if began is not None else int(us.min()), int(us.min()))
            first = int(pdf["lsn"].min()) if first is None else min(first, int(pdf["lsn"].min()))
            n += int(pdf["lsn"].nunique())
        if done:
            if state.exists:
                state.remove()
            return
        state.update((first, n, began or 0))
        due = min((newest or 0) // 1000 + idle_ms, (began or 0) // 1000 + age_ms)
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))

    rows = log.where("txn_id IS NOT NULL").withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    keyed = rows.select("ns_name", "txn_id", "lsn", "txn_state", F.unix_micros("_ts").alias("us"), "_ts").groupBy("ns_name", "txn_id")
    return keyed.applyInPandasWithState(step, ABORTS, OPEN, "append", "EventTimeTimeout")
