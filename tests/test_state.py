"""Golden small logs, and random ones against a fold in plain Python, for the batch fold and the table with delete vectors."""

import pytest
from logs import LOG, fold, kv, random_log, rec, txn

from ledgerfold.operators import snapshot, state
from ledgerfold.operators.change_feed import FeedTable, live_values
from ledgerfold.session import work_folder

K, R, O = b"k", b"r", b"lob"


def row(lsn, cells, op="Insert"):
    return rec(lsn, op, kind="Row", entries=[(R, None, cells)])


GOLDEN = {
    "older commit wins": (txn(b"1", "KV", ("B", 1), ("P", 2, (K, b"old")), ("C", 6)) + txn(b"2", "KV", ("B", 3), ("P", 4, (K, b"new")), ("C", 5)), {("KV", K, "", b"old")}),
    "transaction over plain write": (txn(b"1", "KV", ("B", 1), ("P", 2, (K, b"old")), ("C", 4)) + [kv(3, K, b"newer")], {("KV", K, "", b"old")}),
    "object commit order": (txn(b"1", "Chunked", ("B", 1), ("P", 2, (O, b"old")), ("C", 6, (O,))) + txn(b"2", "Chunked", ("B", 3), ("P", 4, (O, b"new")), ("C", 5, (O,))), {("Chunked", O, "", b"old")}),
    "row commit order": (
        txn(b"1", "Row", ("B", 1), ("P", 2, (R, None, {"c": b"old"})), ("C", 6)) + txn(b"2", "Row", ("B", 3), ("P", 4, (R, None, {"c": b"new"})), ("C", 5)),
        {("Row", R, "c", b"old")},
    ),
    "row transaction over plain": (txn(b"1", "Row", ("B", 1), ("P", 2, (R, None, {"c": b"old"})), ("C", 4)) + [row(3, {"c": b"newer"})], {("Row", R, "c", b"old")}),
    "abort": (txn(b"1", "KV", ("B", 1), ("P", 2, (K, b"v"))), set()),
    "barrier and revival": ([row(1, {"a": b"1", "b": b"2"}), rec(2, "DeleteRowByKey", kind="Row", entries=[(R, None)]), row(3, {"b": b"3"})], {("Row", R, "b", b"3")}),
    "column delete": ([row(1, {"a": b"1", "b": b"2"}), row(2, {"a": None}, "Delete"), row(3, {"c": b"4"})], {("Row", R, "b", b"2"), ("Row", R, "c", b"4")}),
    "all columns gone": ([row(1, {"a": b"1"}), row(2, {"a": b"x"}, "Delete")], set()),
    "tombstone and empty value": ([kv(1, K, b"v"), rec(2, "Delete", entries=[(K, None)]), kv(3, b"j", b"")], {("KV", b"j", "", b"")}),
    "delete of a missing key": ([rec(1, "Delete", entries=[(K, None)])], set()),
    "one key, three views": (
        [kv(1, K, b"v"), rec(2, kind="Row", entries=[(K, None, {"a": b"1"})])] + txn(b"1", "Chunked", ("B", 3), ("P", 4, (K, b"x")), ("P", 5, (K, b"y")), ("C", 6, (K,))),
        {("KV", K, "", b"v"), ("Row", K, "a", b"1"), ("Chunked", K, "", b"xy")},
    ),
    "batch with a repeated key": ([rec(1, entries=[(K, b"1"), (K, b"2")])], {("KV", K, "", b"2")}),
    "event and placeholder": ([kv(1, K, b"1"), rec(2, kind="Event", entries=[(b"e", b"p")]), rec(3, "RaftInternal"), kv(4, K, b"2")], {("KV", K, "", b"2")}),
    "delete transaction": ([kv(1, K, b"v")] + txn(b"1", "KV", ("B", 2), ("P", 3, (K, None)), ("C", 4), op="Delete"), set()),
    "object replaced": (
        txn(b"1", "Chunked", ("B", 1), ("P", 2, (O, b"a")), ("P", 3, (O, b"b")), ("P", 4, (O, b"c")), ("C", 5, (O,)))
        + txn(b"2", "Chunked", ("B", 6), ("P", 7, (O, b"d")), ("P", 8, (O, b"e")), ("C", 9, (O,))),
        {("Chunked", O, "", b"de")},
    ),
    "null key": ([rec(1, entries=[(None, b"v")]), rec(2, kind="Row", entries=[(None, None, {"a": b"1"})])], set()),
    "null value is a value": ([kv(1, K, None)], {("KV", K, "", None)}),
    "empty and null lists": ([rec(1, entries=[]), rec(2, entries=None)], set()),
    "insert of a row without cells": ([rec(1, kind="Row", entries=[(R, None, {}), (R, None, None)])], set()),
}


def values(found):
    single = {(r.entry_type, bytes(r.entry_key), r.part, None if r.value is None else bytes(r.value)) for r in found.collect() if r.entry_type != "Chunked"}
    objects = {("Chunked", bytes(r.entry_key), "", bytes(r.data)) for r in state.objects(found).collect()}
    return single | objects


def test_golden(spark):
    """All golden logs at once, each in its own namespace."""
    records, wanted = [], {}
    for name, (log, result) in GOLDEN.items():
        records += [(name, *r[1:]) for r in log]
        wanted[name] = result
    found = state.state(spark.createDataFrame(records[::-1], LOG))
    got = {name: set() for name in wanted}
    for r in found.where("entry_type <> 'Chunked'").collect():
        got[r.ns_name].add((r.entry_type, bytes(r.entry_key), r.part, None if r.value is None else bytes(r.value)))
    for r in state.objects(found).collect():
        got[r.ns_name].add(("Chunked", bytes(r.entry_key), "", bytes(r.data)))
    assert got == wanted


def places(found):
    return {(r.ns_name, r.entry_type, bytes.fromhex(r.key_hex), r.cell_name): (r.lsn, r.entry_no) for r in found.collect()}


@pytest.mark.parametrize("seed", [2, 3])
def test_random_logs_in_batches(spark, seed):
    """The table with delete vectors, fed in batches of any order and compacted between, equals the fold in Python and the batch fold."""
    records = random_log(seed)
    wanted, objects = fold(records)
    feed = FeedTable(spark, work_folder(spark, "t").path, broadcast_bytes=0 if seed == 2 else 1 << 20)
    third = len(records) // 3
    for part in [records[:third], records[third : 2 * third], records[2 * third :]] if seed == 2 else [records[: 2 * third], records[2 * third :]]:
        feed.apply(spark.createDataFrame(part, LOG))
        if seed == 3 and len(feed.epochs()) == 1:
            feed.compact()
            feed.vacuum()
    rows = live_values(feed.read()).collect()
    assert len(rows) == len({r[:4] for r in rows})
    assert places(live_values(feed.read())) == wanted
    whole = state.state(spark.createDataFrame(records, LOG))
    assert places(live_values(whole.select("ns_name", "entry_type", "entry_key", "part", "value", "commit_lsn", "lsn", "entry_no"))) == wanted
    assert {(r.ns_name, bytes(r.entry_key)): bytes(r.data) for r in state.objects(whole).collect()} == objects
    assert feed.vectors().count() > 0


def test_feed_of_nothing_and_of_repeats(spark):
    feed = FeedTable(spark, work_folder(spark, "t").path)
    assert feed.read().count() == 0
    assert feed.apply(spark.createDataFrame([], LOG)) == 1
    log = spark.createDataFrame([kv(1, K, b"v"), kv(1, K, b"v")], LOG)
    feed.apply(log)
    feed.apply(log)
    assert places(live_values(feed.read())) == {("n", "KV", K, ""): (1, 0)}
    feed.apply(spark.createDataFrame([rec(0, "Delete", entries=[(K, None)])], LOG))  # late, and older than the live write
    assert feed.read().count() == 1


@pytest.mark.parametrize("last", [1, 2, None])
def test_compaction_of_some_folders(spark, last):
    """Folding the newest folders, or all, changes nothing that is read, then or after more batches."""
    records = random_log(21)
    feed = FeedTable(spark, work_folder(spark, "t").path, buckets=4)
    quarter = len(records) // 4
    for i in range(4):
        feed.apply(spark.createDataFrame(records[i * quarter : (i + 1) * quarter if i < 3 else None], LOG))
        if i in (1, 2):
            before = places(live_values(feed.read()))
            feed.compact(last)
            feed.vacuum()
            assert places(live_values(feed.read())) == before
    assert places(live_values(feed.read())) == fold(records)[0]


def test_a_second_commit_changes_nothing(spark):
    """A transaction ends at its first commit, in one batch and over batches alike."""
    log = [*txn(b"t", "KV", ("B", 1), ("P", 2, (K, b"old"))), *txn(b"t", "KV", ("C", 3)), kv(4, K, b"new"), *txn(b"t", "KV", ("P", 5, (b"late", b"x"))), *txn(b"t", "KV", ("C", 6))]
    for cut in (0, 3, 4, 5):
        feed = FeedTable(spark, work_folder(spark, "t").path)
        for part in (log[:cut], log[cut:]):
            feed.apply(spark.createDataFrame(part, LOG))
        assert places(live_values(feed.read())) == {("n", "KV", K, ""): (4, 0)}
    assert places(live_values(state.state(spark.createDataFrame(log, LOG)))) == {("n", "KV", K, ""): (4, 0)}


def test_abandoned_transactions(spark):
    feed = FeedTable(spark, work_folder(spark, "t").path)
    feed.apply(spark.createDataFrame([*txn(b"t", "KV", ("B", 1), ("P", 2, (K, b"x"))), *txn(b"u", "KV", ("B", 3), ("P", 4, (b"u", b"y")))], LOG))
    feed.abandon(spark.createDataFrame([("n", bytearray(b"t"))], "ns_name string, txn_id binary"))
    feed.apply(spark.createDataFrame([*txn(b"t", "KV", ("P", 5, (K, b"z")), ("C", 6)), *txn(b"u", "KV", ("C", 7))], LOG))
    assert places(live_values(feed.read())) == {("n", "KV", b"u", ""): (4, 0)}


def test_the_loser_leaves_the_winners_table(spark):
    path = work_folder(spark, "t").path
    one, two = FeedTable(spark, path), FeedTable(spark, path)
    commit = two.folder.commit_json

    def second(name, value):
        one.apply(spark.createDataFrame([kv(1, K, b"first")], LOG))
        commit(name, value)

    two.folder.commit_json = second
    with pytest.raises(FileExistsError):
        two.apply(spark.createDataFrame([kv(2, b"other", b"second")], LOG))
    assert places(live_values(one.read())) == {("n", "KV", K, ""): (1, 0)}
    one.vacuum()
    assert places(live_values(one.read())) == {("n", "KV", K, ""): (1, 0)}


def test_a_batch_reads_only_the_buckets_it_touches(spark):
    from pyspark.sql import functions as F

    from ledgerfold.operators.parts import bucket_of

    feed = FeedTable(spark, work_folder(spark, "t").path, buckets=64)
    feed.apply(spark.createDataFrame([kv(i + 1, b"k%d" % i, b"v") for i in range(500)], LOG))
    read, part = [], feed.read_part
    feed.read_part = lambda name, folders, buckets=None: read.append((name, buckets)) or part(name, folders, buckets)
    feed.apply(spark.createDataFrame([kv(1000, b"k7", b"w")], LOG))
    (buckets,) = [b for n, b in read if n == "index"]
    assert len(buckets) == 1
    files = lambda df: {r.f for r in df.select(F.input_file_name().alias("f")).distinct().collect()}
    now = feed.manifest()
    assert len(files(part("index", now["index"][:1]))) > 50 and len(files(part("index", now["index"][:1], buckets))) == 1
    own = spark.createDataFrame([("n", "KV", bytearray(b"k7"))], "ns_name string, entry_type string, entry_key binary")
    assert own.select(bucket_of(["ns_name", "entry_type", "entry_key"], now)).first()[0] == buckets[0]
    assert places(live_values(feed.read()))[("n", "KV", b"k7", "")] == (1000, 0)


def test_feed_ignores_what_was_not_committed(spark):
    feed = FeedTable(spark, work_folder(spark, "t").path)
    feed.apply(spark.createDataFrame([kv(1, K, b"v")], LOG))
    commit = feed.folder.commit_json
    feed.folder.commit_json = lambda *a: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        feed.apply(spark.createDataFrame([kv(2, K, b"w")], LOG))
    assert places(live_values(feed.read())) == {("n", "KV", K, ""): (1, 0)}
    feed.folder.commit_json = commit
    feed.apply(spark.createDataFrame([kv(2, K, b"w")], LOG))
    assert places(live_values(feed.read())) == {("n", "KV", K, ""): (2, 0)}


def test_feed_with_extra_columns(spark):
    """Columns of the caller with the names that the operator uses inside don't matter."""
    from pyspark.sql import functions as F

    log = spark.createDataFrame([kv(1, K, b"v")], LOG)
    log = log.withColumns({c: F.lit("x") for c in ("commit_lsn", "e", "kind", "part", "bar", "live", "file_no")})
    feed = FeedTable(spark, work_folder(spark, "t").path)
    feed.apply(log)
    assert feed.read().count() == 1
    assert state.state(log).count() == 1


@pytest.mark.parametrize("at", [0, 37, 80, 200])
def test_recovery_equals_full_replay(spark, at):
    records = random_log(9)
    log = spark.createDataFrame(records, LOG)
    back = snapshot.recover(snapshot.snapshot_changes(log, at), snapshot.tail_changes(log, at))
    assert places(live_values(back)) == fold(records)[0]


def test_columns_and_rows(spark):
    found = state.state(spark.createDataFrame(GOLDEN["column delete"][0], LOG))
    assert [r.cell_name for r in state.row_cells(found, ["b", "zz"]).collect()] == ["b"]
    (only,) = state.rows(found).collect()
    assert {k: bytes(v) for k, v in only.cells.items()} == {"b": b"2", "c": b"4"}
    assert state.events(spark.createDataFrame(GOLDEN["event and placeholder"][0] * 2, LOG)).count() == 1


def test_latest_and_versions(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (None, 3, "b"), (2, 4, "gone")], "k int, o int, v string")
    out = state.latest(df, ["k"], ["o"], ["v"], F.col("v") == "gone")
    assert sorted(map(tuple, out.collect()), key=str) == [(1, None), (None, "b")]
    assert state.latest(df.limit(0), ["k"], ["o"], ["v"]).count() == 0
    assert state.versions(df, ["k"], "o", F.col("v") == "gone").where("k = 2").first() == (2, 1, 1, 4)
