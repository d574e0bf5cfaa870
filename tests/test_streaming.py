"""Streams against the batch results, through restarts."""

import datetime

from logs import LOG, fold, random_log, rec
from pyspark.sql import functions as F

from ledgerfold.operators.change_feed import FeedTable, live_values
from ledgerfold.session import Folder, ship, work_folder
from ledgerfold.sources import log as log_source
from ledgerfold.streaming import folds


def add(spark, path, records):
    spark.createDataFrame(records, LOG).coalesce(1).write.mode("append").parquet(path)


def test_log_into_table_through_restarts(spark, tmp_path):
    records, path = random_log(11), str(tmp_path / "log")
    folder = work_folder(spark, "t")
    for part in (records[:50], records[50:]):
        add(spark, path, part)
        feed = FeedTable(spark, folder / "table")
        folds.into_table(log_source.follow(spark, path, 1), feed, folder / "checkpoint").awaitTermination()
    got = {(r.ns_name, r.entry_type, bytes.fromhex(r.key_hex), r.cell_name): (r.lsn, r.entry_no) for r in live_values(feed.read()).collect()}
    assert got == fold(records)[0]


def test_latest_in_a_table(spark):
    schema = "k string, o int, v string, bucket string"
    df = lambda rows: spark.createDataFrame([(*r, "x") for r in rows], schema)
    t = folds.LatestTable(spark, work_folder(spark, "t").path, df([]).schema, ["k"], ["o"], ["v"], buckets=3)
    assert t.read().count() == 0
    t.apply(df([("a", 1, "x"), ("b", 5, "y"), (None, 1, "n")]), 0)
    t.apply(df([("a", 2, "z"), ("b", 4, "late")]), 1)
    t.apply(df([("a", 9, "twice")]), 1)  # a batch that was done already
    t.apply(df([]), 2)
    assert {(r.k, r.o, r.v) for r in t.read().collect()} == {("a", 2, "z"), ("b", 5, "y"), (None, 1, "n")}
    assert len(t.folder.names("state")) == len(set(t.manifest()["state"].values()))


def test_messages_at_their_commit(spark, tmp_path):
    """Entries of a transaction are told once its commit is there, those of an aborted one never."""
    import json

    from logs import kv, txn

    feed, path = FeedTable(spark, work_folder(spark, "t").path), str(tmp_path / "out")
    step = folds.notifying(feed, path)
    told = lambda: sorted((m["operation"], m["seq_num"]) for m in (json.loads(r.message) for r in spark.read.json(path).distinct().collect()))
    step(spark.createDataFrame([kv(1, b"k", b"v"), *txn(b"t", "KV", ("B", 2), ("P", 3, (b"k", None))), *txn(b"lost", "KV", ("P", 4, (b"x", None)))], LOG), 0)
    assert told() == [("put", 1)]
    step(spark.createDataFrame([*txn(b"t", "KV", ("C", 5), op="Delete"), rec(6, "DeleteRowByKey", kind="Row", entries=[(b"r", None)])], LOG), 1)
    assert told() == [("delete", 5), ("delete_row", 6), ("put", 1)]


def test_once(spark):
    seen = []
    step = folds.once(Folder(spark, work_folder(spark, "t").path), lambda df, n: seen.append(n))
    for n in (0, 0, 1):
        step(None, n)
    assert seen == [0, 1]


def test_latest_in_memory(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, None)], "k string, o int, v string").write.parquet(path)
    rows = spark.readStream.schema("k string, o int, v string").parquet(path)
    q = folds.latest(rows, ["k"], ["o"], ["v"]).writeStream.outputMode("complete").format("memory").queryName("latest_t").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.k, r.v) for r in spark.table("latest_t").collect()} == {("a", "y"), ("b", None)}


def test_reaper(spark, tmp_path):
    """An idle transaction and one that goes on too long are ended; a committed one and a busy one aren't."""
    ship(spark)
    path, folder = str(tmp_path / "log"), work_folder(spark, "t")
    step = lambda lsn, state, name, at: rec(lsn, "Insert", state, "KV", [], name, at=at)
    first = [step(1, "Begin", b"idle", 0), step(2, "Begin", b"done", 0), step(3, "Commit", b"done", 10), step(4, "Begin", b"old", 0)]
    then = [[step(10 + i, "Prepare", b"old", 60 * i), step(30 + i, "Begin" if i == 0 else "Prepare", b"busy", 600 + 60 * i)] for i in range(10)]
    add(spark, path, first)
    out = folds.aborted(log_source.follow(spark, path, 1), "ingested_at")
    for part in [[rec(99, "RaftInternal", at=1)], *then, [step(90, "Begin", b"late", 1300)], [step(91, "Begin", b"last", 1300)]]:
        add(spark, path, part)
        q = out.writeStream.format("parquet").option("path", folder / "out").option("checkpointLocation", folder / "checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        ended = {bytes(r.txn_id) for r in spark.read.schema(folds.ABORTS).parquet(folder / "out").collect()}
    assert b"idle" in ended and b"old" in ended
    assert not ended & {b"done", b"late", b"last"}


def test_objects_and_notifications(spark, tmp_path):
    path, folder = str(tmp_path / "log"), work_folder(spark, "t")
    add(spark, path, [rec(1, entries=[(b"k", b"v")]), rec(2, "Delete", entries=[(b"k", None)]), rec(3, kind="Event", entries=[(b"e", b"")]), rec(5000, "DeleteRowByKey", kind="Row", entries=[(b"r", None)])])
    log = lambda: log_source.follow(spark, path)
    folds.to_objects(log(), folder / "o", folder / "c1", 1000).awaitTermination()
    assert {(r.stretch, r.lsn) for r in spark.read.parquet(folder / "o").collect()} == {(0, 1), (0, 2), (0, 3), (5, 5000)}
    folds.notifications(log(), folder / "n", folder / "c2").awaitTermination()
    sent = spark.read.json(folder / "n").select("topic", F.get_json_object("message", "$.operation"), F.get_json_object("message", "$.seq_num")).collect()
    assert {tuple(r) for r in sent} == {("n.kv", "put", "1"), ("n.kv", "delete", "2"), ("n.row", "delete_row", "5000")}


def test_sessions_and_windows(spark, tmp_path):
    path, folder = str(tmp_path / "in"), work_folder(spark, "t")
    at = lambda m: datetime.datetime(2025, 1, 1) + datetime.timedelta(minutes=m)
    spark.createDataFrame([("a", at(0)), ("a", at(4)), ("a", at(20)), ("b", at(500)), ("b", None)], "k string, ts timestamp").write.parquet(path)
    rows = lambda: spark.readStream.schema("k string, ts timestamp").parquet(path)
    for i, (df, wanted) in enumerate([
        (folds.sessions(rows(), ["k"], "ts", "5 minutes", "1 minute").select("k", "n"), {("a", 2), ("a", 1)}),
        (folds.windowed(rows(), "ts", "10 minutes", "1 minute", ["k"], [F.count("*").alias("n")]).select("k", "n"), {("a", 2), ("a", 1)}),
    ]):
        df.writeStream.format("parquet").option("path", folder / f"o{i}").option("checkpointLocation", folder / f"c{i}").trigger(availableNow=True).start().awaitTermination()
        assert {tuple(r) for r in spark.read.schema(df.schema).parquet(folder / f"o{i}").collect()} == wanted
