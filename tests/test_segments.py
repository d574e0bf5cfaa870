"""Segments, gaps, positions and replication."""

import random

import pytest
from logs import LOG, kv, random_log, rec, txn

from ledgerfold.operators import replication, segments
from ledgerfold.operators.txn import effective
from pyspark.sql import functions as F

HEADERS = "ns_name string, segment_id bigint, last_modified_at int, write_offset bigint, entry_count bigint, flags bigint, first_log_index bigint"


@pytest.mark.parametrize("stretch", [3, 16, 1 << 16])
def test_gaps(spark, stretch):
    r = random.Random(stretch)
    rows = [(s, n) for s in ("a", None) for n in range(-5, 80) if r.random() < 0.6]
    wanted = set()
    for s in ("a", None):
        own = sorted(n for x, n in rows if x == s)
        wanted |= {(s, a + 1, b - 1) for a, b in zip(own, own[1:]) if b > a + 1}
    df = spark.createDataFrame(rows * 2 + [("a", None)], "ns_name string, lsn bigint")
    assert {tuple(x) for x in segments.gaps(df, stretch=stretch).collect()} == wanted
    assert segments.gaps(df.limit(0)).count() == 0


def test_gap_of_a_short_log(spark):
    df = spark.createDataFrame([kv(1, b"k", b""), kv(2, b"k", b""), kv(4, b"k", b"")], LOG)
    assert [tuple(x) for x in segments.gaps(df).collect()] == [("n", 3, 3)]


def test_headers_and_retention(spark):
    rows = [("a", i, 1, 100 * i, 10, 2, 10 * i) for i in range(1, 6)] + [("a", 6, 1, 64, 0, 8, 0), ("a", 6, 2, 164, 3, 8, 60), ("a", 6, None, 1, 1, 2, 1), ("b", 1, 1, 64, 0, 8, 0)]
    h = spark.createDataFrame(rows + rows[:2], HEADERS)
    (six,) = segments.current_headers(h).where("segment_id = 6").collect()
    assert (six.entry_count, six.flags) == (3, 8)
    totals = {x.ns_name: x for x in segments.totals(h).collect()}
    assert tuple(totals["a"])[1:] == (6, 5, 1, 53, 1664, 10, 62)
    assert tuple(totals["b"])[1:] == (1, 0, 1, 0, 64, None, None)
    old = lambda *a: sorted(tuple(x) for x in segments.retention(h, *a).collect())
    assert old(4) == [("a", 1), ("a", 2)]
    assert old(0) == [("a", i) for i in range(1, 6)]
    marks = spark.createDataFrame([("a", 2)], "ns_name string, checkpoint_segment bigint")
    assert old(4, marks) == [("a", 1)]
    assert [x.segment_id for x in segments.backup_after(h, 3).orderBy("segment_id").collect()] == [4, 5]
    assert [tuple(x) for x in segments.last_sealed(h).collect()] == [("a", 5)]


def test_retention_by_age(spark):
    """Within keep, old sealed segments go; an unsealed one takes no place among the sealed."""
    rows = [("a", i, t, 1, 1, flags, 1) for i, t, flags in ((1, 5, 2), (2, 5, 0), (3, 5, 2), (4, 9, 2), (5, None, 2), (6, 9, 8))] + [("one", 1, 1, 1, 1, 2, 1)]
    h = spark.createDataFrame(rows, HEADERS)
    ids = lambda *a, **k: [(x.ns_name, x.segment_id) for x in segments.retention(h, *a, **k).orderBy("ns_name", "segment_id").collect()]
    at = F.lit(5).cast(h.schema["last_modified_at"].dataType)
    assert ids(4) == [("a", 1), ("a", 3)]
    assert ids(10) == []
    assert ids(10, cutoff=at) == [("a", 1), ("a", 3)]
    assert ids(4, cutoff=F.lit(9).cast(h.schema["last_modified_at"].dataType)) == [("a", 1), ("a", 3)]
    assert ids(10, least=6, cutoff=at) == []
    marks = spark.createDataFrame([("a", 2)], "ns_name string, checkpoint_segment bigint")
    assert ids(10, marks, cutoff=at) == [("a", 1)]


def test_positions_and_ranges(spark):
    records = random_log(2)
    log = spark.createDataFrame(records, LOG)
    seen = {(r[0], r[3]): (r[1], r[2]) for r in records}
    assert {(x.ns_name, x.lsn): (x.segment_id, x.seg_offset) for x in segments.positions(log).collect()} == seen
    at = {(x.ns_name, x.lsn) for x in segments.from_position(log, 1, 640).select("ns_name", "lsn").collect()}
    assert at == {k for k, p in seen.items() if p >= (1, 640)}
    after = {(x.ns_name, x.lsn) for x in segments.from_position(log, 1, 640, strict=True).select("ns_name", "lsn").collect()}
    assert after == {k for k, p in seen.items() if p > (1, 640)}
    assert segments.from_lsn(log, 0).count() == len(records)
    assert {x.lsn for x in replication.in_range(log, 10, 12).collect()} == {11, 12}
    assert segments.truncate(log, 0).count() == 0
    assert {(x.ns_name, x.n_records) for x in segments.segment_stats(log).where("segment_id = 1").collect()} == {(ns, sum(k[0] == ns and p[0] == 1 for k, p in seen.items())) for ns in "nm"}


def test_what_a_follower_may_apply(spark):
    log = spark.createDataFrame([kv(n, b"k", b"") for n in (5, 6, 7, 9, 10)] + [kv(n, b"k", b"", ns="m") for n in (1, 2)], LOG)
    at = spark.createDataFrame([("n", 5), ("m", 2), ("far", 1)], "ns_name string, last_lsn bigint")
    assert {tuple(x) for x in replication.applicable(log, at).collect()} == {("n", 5, 8, 2), ("m", 2, 3, 0), ("far", 1, 2, 0)}


def test_sets(spark):
    m = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "id string, addr string")
    s = spark.createDataFrame([("b", "9"), ("c", None), ("d", "4")], "id string, addr string")
    assert {tuple(x) for x in replication.reconciled(m, s, "id", "addr").collect()} == {("a", "add"), ("b", "update"), ("d", "remove")}
    assert [x.id for x in replication.without(m, s, ["id"]).collect()] == ["a"]


def test_transactions(spark):
    log = txn(b"1", "KV", ("B", 1), ("P", 2, (b"k", b"v")), ("C", 3)) + txn(b"2", "KV", ("B", 4), ("P", 5, (b"k", b"v")))
    t = replication.transactions(spark.createDataFrame(log * 2, LOG))
    assert {(bytes(x.txn_id), x.status, x.n_prepared, x.first_lsn, x.last_lsn) for x in t.collect()} == {(b"1", "committed", 1, 1, 3), (b"2", "open", 1, 4, 5)}
    late = lambda ms: replication.stale(t, F.lit(1735689600005 + ms)).count()
    assert (late(119_999), late(120_000)) == (0, 1)


def test_messages(spark):
    log = spark.createDataFrame([kv(1, b"k", b"v"), rec(2, "DeleteRowByKey", kind="Row", entries=[(b"r", None)])], LOG)
    sent = {tuple(x) for x in replication.notifications(effective(log), F.col("entry_key")).collect()}
    assert sent == {
        ("n.kv", '{"key":"aw==","namespace":"n","operation":"put","entry_type":"kv","seq_num":1}'),
        ("n.row", '{"key":"cg==","namespace":"n","operation":"delete_row","entry_type":"row","seq_num":2}'),
    }


def test_availability_and_replacement(spark):
    rows = lambda *r: spark.createDataFrame([(ns, n, "x") for ns, n in r], "ns_name string, lsn bigint, op string")
    log = rows(("a", 5), ("a", 6), ("a", 7), ("b", 1))
    wanted = rows(("a", 4), ("a", 5), ("a", 8), ("c", 1))
    assert [r.status for r in segments.availability(wanted, log).orderBy("ns_name", "lsn").collect()] == ["truncated", "ok", "not_yet", "not_yet"]
    out = segments.stored(log, rows(("a", 6), ("c", 9)))
    assert sorted((r.ns_name, r.lsn) for r in out.collect()) == [("a", 5), ("a", 6), ("b", 1), ("c", 9)]
    assert [r.lsn for r in segments.without_range(log.where("ns_name = 'a'"), 5, 7, safe=6).collect()] == [7]


def test_namespaces(spark):
    relays = spark.createDataFrame([(["a", "b"], 5), (["b"], None), ([], 1)], "names array<string>, threshold int")
    flat, twice = replication.namespace_settings(relays, "names", "threshold", 9)
    assert sorted(map(tuple, flat.collect())) == [("a", 5), ("b", 5), ("b", 9)] and [tuple(r) for r in twice.collect()] == [("b",)]
    members = spark.createDataFrame([("1", ["a"]), ("1", ["a"]), ("2", None)], "id string, tags array<string>")
    assert [r.id for r in replication.members(members, "id", "tags", "a").collect()] == ["1"]
