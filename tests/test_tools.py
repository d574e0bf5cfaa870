"""Backups, envelopes, checkpoints, reports, sessions and quantiles, completeness of transactions."""

import random
import struct

import pytest
from logs import LOG, kv, rec, txn
from pyspark.sql import functions as F

from ledgerfold.functions import envelope, keys, text
from ledgerfold.operators import backup, metrics, replication, state, writes
from ledgerfold.operators.txn import chains
from ledgerfold.session import Folder, shared_folder, work_folder
from ledgerfold.sources import benchtext, reports, segments


def test_restore(spark):
    folder = work_folder(spark, "t")
    b = backup.Backup(spark, folder / "b")
    rows = spark.createDataFrame([(i, None if i % 3 else b"x" * i, {"a": b"1"}) for i in range(20)], "k int, v binary, m map<string,binary>")
    with pytest.raises(ValueError):
        b.check()
    with pytest.raises(ValueError):
        b.write({})
    b.write({"state": rows, "none": rows.limit(0)})
    with pytest.raises(FileExistsError):
        b.write({"state": rows})
    told = {(r.part, r.action, r.n_rows) for r in b.restore(folder / "t", dry_run=True).collect()}
    assert told == {("state", "would restore", 20), ("none", "would restore", 0)}
    assert Folder(spark, folder / "t").names() == []
    b.restore(folder / "t")
    plain = lambda df: sorted(map(str, df.collect()))
    assert plain(backup.restored(spark, folder / "t", "state")) == plain(rows)
    assert backup.restored(spark, folder / "t", "none").schema == rows.schema
    with pytest.raises(ValueError):
        b.restore(folder / "t", ["other"])


def test_restore_leaves_the_target_as_it_was(spark):
    """A damaged backup, a failure half way and a restoration beside another one change nothing."""
    folder = work_folder(spark, "t")
    first, second = backup.Backup(spark, folder / "1"), backup.Backup(spark, folder / "2")
    first.write({"s": spark.createDataFrame([(1,)], "k int")})
    second.write({"s": spark.createDataFrame([(2,), (3,)], "k int"), "z": spark.createDataFrame([(4,)], "k int")})
    first.restore(folder / "t")
    target = Folder(spark, folder / "t")
    is_as_it_was = lambda: [r.k for r in backup.restored(spark, folder / "t", "s").collect()] == [1] and backup.restored_numbers(target) == [1] and len(target.names("s")) == 1 and not target.names("z")
    target.commit_json("restore.lock", {})
    with pytest.raises(FileExistsError):
        second.restore(folder / "t")
    target.delete("restore.lock")
    assert is_as_it_was()
    compare, done = backup._compare, []

    def fails(spark, where, part, name):
        if where.path.endswith("/t") and name == "z":
            raise ValueError("torn")
        compare(spark, where, part, name)

    backup._compare = fails
    try:
        with pytest.raises(ValueError):
            second.restore(folder / "t")
    finally:
        backup._compare = compare
    assert is_as_it_was() and not target.exists("restore.lock"), done
    told = second.parts()
    Folder(spark, second.folder / told["z"]["at"]).delete("")
    with pytest.raises(ValueError):
        second.restore(folder / "t", dry_run=True)
    assert is_as_it_was()
    second.restore(folder / "t", ["s"])
    assert sorted(r.k for r in backup.restored(spark, folder / "t", "s").collect()) == [2, 3]


def uvarint(n):
    out = b""
    while n >= 128:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def test_envelopes(spark):
    made = lambda term, index, kind, ns, data, ext=b"": struct.pack("<QQBQ", term, index, kind, ns) + uvarint(len(data)) + data + uvarint(len(ext)) + ext
    long = bytes(range(256)) * 80
    cases = [made(1, 2, 0, 3, b"abc", b"xy"), made(2**40, 2**50, 1, 0, b""), made(1, 7, 3, 99, long), made(1, 2, 0, 3, b"abc")[:-3], b"short", b"", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, e binary").select("i", envelope.decode(F.col("e")).alias("d"), envelope.payload(F.col("e")).alias("p"))
    got = {r.i: (r.d, r.p) for r in df.collect()}
    assert tuple(got[0][0]) == (1, 2, 0, 3, b"abc", b"xy") and tuple(got[1][0]) == (2**40, 2**50, 1, 0, None, None) and bytes(got[2][0].data) == long
    assert all(got[i] == (None, None) for i in (3, 4, 5, 6))
    assert tuple(got[0][1]) == (False, None, None, b"abc") and tuple(got[1][1]) == (True, 2**50, 1, None) and tuple(got[2][1])[:3] == (True, 7, 99)
    sizes = spark.createDataFrame([(n,) for n in (0, 1, 127, 128, 16383, 16384, 2**21, 2**28, 2**35 - 1)], "n bigint").select("n", envelope.varint(F.col("n")).alias("v")).collect()
    assert all(bytes(r.v) == uvarint(r.n) for r in sizes)


def test_lsn_in_a_record(spark):
    r = dict(lsn=5, hlc=6, crc32_checksum=7, operation_type="Insert", txn_state="None", entry_type="KV", txn_id=b"t", prev_txn_wal_index=None, entries=[(b"k", b"v", None)])
    df = spark.createDataFrame([(segments.encode_record(r),), (b"",), (None,)], "b binary").select(envelope.with_lsn(F.col("b"), F.lit(2**40 + 3)).alias("b"))
    first, *rest = [x.b for x in df.collect()]
    assert segments.record(bytes(first)) == r | {"lsn": 2**40 + 3} and rest == [None, None]


def test_checkpoints(spark):
    raw = struct.pack("<QIqQQ", 9, 4, 128, 11, 2)
    df = spark.createDataFrame([(raw,), (raw[:20],), (raw[:19],), (b"",)], "b binary").select(keys.decode_checkpoint(F.col("b")).alias("c"))
    assert [tuple(r.c) for r in df.collect()] == [(9, 4, 128, 11, 2), (9, 4, 128, 0, 0), (0, 0, 0, 0, 0), (0, 0, 0, 0, 0)]
    one = spark.range(1).select(keys.encode_checkpoint(*map(F.lit, (9, 4, 128, 11, 2))).alias("b"), keys.encode_checkpoint(F.lit(9), F.lit(None).cast("bigint"), F.lit(None).cast("bigint"), F.lit(1), F.lit(1)).alias("n")).first()
    assert bytes(one.b) == raw and bytes(one.n) == struct.pack("<QIqQQ", 9, 0, 0, 1, 1)


def test_small_texts(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [one(text.decimals(F.lit(x), 2)) for x in (0.0, 1.0, 1.5, 10.256, 100.0)] == ["0", "1", "1.5", "10.26", "100"]
    assert [one(text.duration_text(F.lit(float(x)))) for x in (0, 5, 61, 3600, 90061, -61)] == ["0s", "5s", "1m 1s", "1h 0m 0s", "1d 1h 1m 1s", "-1m 1s"]
    assert one(text.positive_sizes(F.lit("1, 2,,30"))) == [1, 2, 30]
    assert [one(text.positive_sizes(F.lit(x))) for x in ("", "a", "1,0", "-1", ",")] == [None] * 5
    assert [one(text.package_of(F.lit(x))) for x in ("/app/kernel/a.go", "a.go", "/.x/b", "./b")] == ["kernel", "unknown", "x", "unknown"]
    assert [one(text.log_level(F.lit(x))) for x in ("WARNING", "", "loud")] == ["WARN", "INFO", None]
    assert one(text.http_status(F.lit(None).cast("string"))) == 500


def test_reports(spark):
    df = spark.createDataFrame([(2, "bb", None), (1, "a", 1.5)], "id int, name string, x double")
    lines = [r.line for r in reports.text_table(df, {"ID": F.col("id"), "NAME": F.col("name"), "X": F.col("x")}, ["id"]).orderBy("line_no").collect()]
    assert lines == ["ID  NAME  X", "1   a     1.5", "2   bb"]
    assert reports.text_table(df.limit(0), {"ID": F.col("id")}, ["id"]).count() <= 1
    assert [r.line for r in reports.csv_lines(df, ["id", "name", "x"], header=True).collect()] == ["id,name,x", "2,bb,", "1,a,1.50"]
    folder = work_folder(spark, "t")
    for _ in range(2):
        reports.appended_csv(df, ["id", "x"], folder / "csv")
    assert spark.read.text(folder / "csv").count() == 4


def brute_sessions(rows, gap):
    out = []
    for user in {u for u, _ in rows}:
        at = sorted(t for u, t in rows if u == user and t is not None)
        for t in at:
            if out and out[-1][0] == user and t - out[-1][2] < gap:
                out[-1][2], out[-1][3] = t, out[-1][3] + 1
            else:
                out.append([user, t, t, 1])
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("gaps", [1, 3, 1000])
def test_sessions_in_stretches(spark, monkeypatch, gaps):
    monkeypatch.setattr(metrics, "GAPS", gaps)
    r = random.Random(gaps)
    rows = [(r.choice(["hot", "hot", "hot", None, "u"]), r.choice([r.randint(0, 900), None])) for _ in range(300)] + [("hot", 100)] * 5
    df = spark.createDataFrame(rows, "u string, s bigint").select("u", F.timestamp_seconds("s").alias("ts"), F.lit(1).alias("_s"))
    got = [(x.u, x.a, x.b, x.n) for x in metrics.sessions(df, ["u"], "ts", "10 seconds").select("u", F.unix_seconds("started_at").alias("a"), F.unix_seconds("ended_at").alias("b"), "n").collect()]
    assert sorted(got, key=str) == brute_sessions(rows, 10)
    assert metrics.sessions(df.limit(0), ["u"], "ts", "10 seconds").count() == 0


def test_exact_quantiles(spark):
    import numpy as np

    r = random.Random(3)
    rows = [(r.choice(["a", "b", None]), r.choice([None, 5.0, r.random() * 100, float(r.randint(0, 3))])) for _ in range(400)] + [("only null", None), ("one", 7.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    at = {"p0": 0.0, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    for x in metrics.quantiles(df, ["k"], "v", at).collect():
        own = [v for k, v in rows if k == x.k and v is not None]
        assert x.n == len(own)
        assert [x[c] for c in at] == (pytest.approx([np.quantile(own, q) for q in at.values()]) if own else [None] * 4)
    assert metrics.quantiles(df, [], "v", at).first().n == sum(v is not None for _, v in rows)
    assert metrics.quantiles(df.limit(0), ["k"], "v", at).count() == 0


def test_completeness_of_objects(spark):
    """A large object one of whose chunks hasn't come is live and incomplete; a delete ends it."""
    own = lambda n: struct.pack("<Iq", n // 100 + 1, n % 100 * 64)
    log = txn(b"t", "Chunked", ("B", 1), ("P", 2, (b"o", b"a")), ("P", 3, (b"o", b"b")), ("C", 4, (b"o",)))
    log = [x if x[7] == "Begin" else (*x[:10], own(x[3] - 1), *x[11:]) for x in log]
    check = lambda rows: [(r.n_chunks, r.is_complete) for r in state.object_checks(spark.createDataFrame(rows, LOG)).collect()]
    assert check(log * 2) == [(2, True)]
    assert check([x for x in log if x[3] != 2]) == [(1, False)]
    assert [(r.n_prepared, r.n_missing) for r in chains(spark.createDataFrame([x for x in log if x[3] != 3], LOG)).collect()] == [(1, 1)]
    assert chains(spark.createDataFrame([], LOG)).count() == 0
    gone = [*log, rec(5, "Delete", kind="Chunked", entries=[(b"o", None)])]
    assert check(gone) == [] and state.objects(state.state(spark.createDataFrame(gone, LOG))).count() == 0
    assert check([*gone, *[(*x[:3], x[3] + 10, *x[4:9], b"u", None if x[7] == "Begin" else x[10], *x[11:]) for x in log]])[0][0] == 2


def test_relay_checks(spark, monkeypatch):
    monkeypatch.setattr(replication, "BATCHES", 2)
    schema = "batch_id bigint, consumer_id string, ns_name string, server_ts timestamp_ntz, records array<struct<lsn:bigint,record:binary,crc32_checksum:bigint>>"
    r = random.Random(5)
    rows, wanted, last = [], {}, {}
    for i in range(12):
        lsns = [r.randint(1, 4) + i for _ in range(r.randint(0, 3))]
        who = r.choice(["a", None])
        rows.append((i, who, "n", None, [(x, None, None) for x in lsns] if lsns else r.choice([None, []])))
        if lsns:
            chain = [last[who], *lsns] if who in last else lsns
            wanted[i] = (len(lsns), sum(b != a + 1 for a, b in zip(chain, chain[1:])), last.get(who))
            last[who] = lsns[-1]
    got = {x.batch_id: (x.n, x.n_breaks, x.prev_lsn) for x in replication.relay_checks(spark.createDataFrame(rows, schema)).collect()}
    assert got == wanted


def test_position_checks(spark):
    log = spark.createDataFrame([kv(1, b"k", b"v"), kv(2, b"k", b"v")], LOG)
    received = spark.createDataFrame([("n", 1, 1, 64, "x"), ("n", 2, 1, 64, "x"), ("n", 3, 1, 0, "x"), ("n", 2, None, 1, "x"), (None, 1, 1, 64, "x")], "ns_name string, lsn bigint, segment_id bigint, seg_offset bigint, status string")
    assert [x[-1] for x in replication.position_checks(received.drop("status"), log).orderBy("ns_name", "lsn", "segment_id").collect()] == ["absent", "same", "elsewhere", "elsewhere", "absent"]


def test_records_of_a_table(spark, tmp_path):
    spark.range(50).repartition(7).write.parquet(str(tmp_path / "t"))
    entry = F.struct(F.col("id").cast("string").cast("binary").alias("entry_key"), F.lit(None).cast("binary").alias("entry_value"), F.lit(None).cast("map<string,binary>").alias("cells"))
    made = writes.records_of(spark.read.parquet(str(tmp_path / "t")), "n", "Insert", "KV", 10, entry, 8)
    assert made.schema.names == spark.createDataFrame([], LOG).schema.names
    rows = made.collect()
    assert sorted(r.lsn for r in rows) == list(range(11, 61)) and all((r.lsn - 1) // 8 + 1 == r.segment_id for r in rows)
    assert state.kv(state.state(made)).count() == 50


def test_older_trace_lines(spark):
    df = spark.createDataFrame([("gc 1 @0.5s 2%: 0.25+1.5 ms clock, 1+2 ms cpu, 4->5->1 MB, 5 MB goal, 8 P",), ("gc 2 @1.5s 2%: 0.25+1.5+0.5 ms clock, 1+2 ms cpu, 4->5->1 MB, 5 MB goal, 8 P",)], "value string")
    assert [(r.pause_ms, r.concurrent_ms) for r in benchtext.gc_lines(df).orderBy("cycle").collect()] == [(1.75, 0.0), (0.75, 1.5)]


def test_no_folder_of_one_machine_on_a_cluster(spark):
    """Without a shared folder an operator fails on a cluster, and where all is local it takes one of its own."""

    class Conf:
        get = staticmethod(lambda name, default=None: default)

    class Context:
        master = "spark://somewhere:7077"

    class Session:
        conf, sparkContext = Conf, Context()

    with pytest.raises(ValueError):
        shared_folder(Session)
    Session.sparkContext.master = "local[2]"
    assert shared_folder(Session) == shared_folder(Session) and shared_folder(Session).startswith("file://")
