"""Scalar functions, metrics and merges."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from ledgerfold.functions import bitmaps, keys, text
from ledgerfold.operators import crdt, metrics


def one(spark, column, *values, schema="v binary"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(column).collect()]


def test_keys(spark):
    v = F.col("v")
    hexed = lambda c: F.hex(c)
    assert one(spark, hexed(keys.kv_key(v)), b"a", b"\xfea", b"", None) == ["FE61", "FE61", "FE", None]
    assert one(spark, hexed(keys.row_key(v)), b"ab", b"") == ["FD000000026162", "FD00000000"]
    assert one(spark, hexed(keys.cell_key(v, F.lit("c"))), b"a") == ["FD000000016163"]
    assert one(spark, hexed(keys.chunk_key(v, F.lit(258))), b"a") == ["FF000000016100000102"]
    assert one(spark, keys.kind_of(v), b"\xfe", b"\xfdx", b"\xff", b"\xfc", b"a", b"", None) == ["KV", "Row", "Chunked", "System", None, None, None]
    assert one(spark, keys.lsn_of(keys.lsn_key(F.col("v"))), 0, 1, 2**40, None, schema="v bigint") == [0, 1, 2**40, None]
    assert one(spark, keys.lsn_of(v), b"123") == [None]
    p = keys.encode_position(F.col("v"), F.col("v") * 1000)
    assert one(spark, F.hex(p), 258, schema="v bigint") == ["02010000D0EF030000000000"]
    assert one(spark, keys.decode_position(p)["seg_offset"], 258, schema="v bigint") == [258000]
    assert one(spark, keys.decode_position(v), b"short", None) == [None, None]


def test_text(spark):
    v = F.col("v")
    s = lambda c, *x: one(spark, c, *x, schema="v string")
    n = lambda c, *x: one(spark, c, *x, schema="v bigint")
    assert s(text.parse_size(v), "16MB", " 1kb ", "7", "x", "", None, "1.5MB", "2GB", "1 KB", "5TB", "-3") == [16 << 20, 1024, 7, 0, 0, 0, 0, 2 << 30, 0, 0, -3]
    assert s(text.split_list(v), "a, b,,c ", "", None) == [["a", "b", "c"], [], None]
    assert n(text.align8(v), 0, 1, 8, 9) == [0, 8, 8, 16]
    assert n(text.record_size(v), 0, 1, 8) == [16, 24, 24]
    assert n(text.segment_file_name(v), 7) == ["000000007.seg"]
    assert n(text.clamp(v, 0, 10), -1, 5, 11) == [0, 5, 10]
    assert n(text.si_count(v), 999, 1500, 2_500_000) == ["999", "1.5K", "2.5M"]
    assert n(text.varint_size(v), 0, 127, 128, 16383, 16384) == [1, 1, 2, 2, 3]
    assert s(text.method_parts(v)["method"], "/svc/Call", "svc") == ["Call", None]
    assert s(text.is_relative_path(v), "a/b", "/a", "a/../b", "..", "a..b") == [True, False, False, False, True]
    assert n(text.chunk_label(v, F.lit(3)), 0, 1, 2) == ["first", "middle", "last"]
    assert [len(x) for x in n(text.chunk_spans(v, 10), 0, 1, 10, 25)] == [0, 1, 1, 3]
    assert n(text.safe_time(v), 0, -1) == [None, None]


def test_bitmaps(spark):
    numbers = [0, 5, 32767, 32768, 100000, -1, -32768]
    df = spark.createDataFrame([(n,) for n in numbers], "v bigint")
    v = F.col("v")
    maps = df.groupBy(bitmaps.bucket(v).alias("b")).agg(F.bitmap_construct_agg(bitmaps.bit(v)).alias("m"))
    probe = spark.createDataFrame([(n,) for n in [*numbers, 1, 32769, -2]], "v bigint")
    found = probe.join(maps, bitmaps.bucket(v) == F.col("b"), "left").where(bitmaps.is_set(F.col("m"), bitmaps.bit(v)))
    assert sorted(r.v for r in found.collect()) == sorted(numbers)


def test_metrics(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None), (None, 2.0)], "k string, v double")
    q = metrics.quantiles(df, ["k"], "v", {"p50": 0.5})
    assert {(r.k, r.n, r.p50) for r in q.collect()} == {("a", 2, 2.0), ("b", 0, None), (None, 1, 2.0)}
    assert metrics.quantiles(df, ["k"], "v", {"p50": 0.5}, exact=False).where("k = 'a'").first().p50 in (1.0, 3.0)
    counts = metrics.op_counts(df, ["k"], F.col("v") > 2)
    assert {tuple(r) for r in counts.collect()} == {("a", 2, 1), ("b", 1, 0), (None, 1, 0)}
    ages = spark.createDataFrame([(x,) for x in (0, 59, 60, 899, 900, 1799, 86399, 86400)], "v int")
    assert [r[0] for r in ages.select(metrics.age_bucket(F.col("v"))).collect()] == ["0s_1s", "30s_1m", "1m_10m", "10m_15m", "10m_30m", "10m_30m", "12h_24h", "24h_over"]
    at = lambda h: datetime.datetime(2025, 1, 1, h)
    t = spark.createDataFrame([("a", at(0)), ("a", at(0)), ("a", at(5)), ("b", at(1))], "k string, t timestamp_ntz")
    assert {(r.k, r.n, r.delta) for r in metrics.rates(t, "t", "hour", ["k"]).collect()} == {("a", 2, None), ("a", 1, -1), ("b", 1, None)}
    assert sorted(r.n for r in metrics.sessions(t, ["k"], "t", "2 hours").collect()) == [1, 1, 2]
    io = spark.createDataFrame([(1, 3), (1, 3)], "iowait int, other int")
    assert metrics.share(io, "iowait", ["iowait", "other"]).first()[0] == 25.0
    assert metrics.share(io.limit(0), "iowait", ["iowait", "other"]).first()[0] is None
    heads, own = spark.createDataFrame([("n", 100)], "ns string, head int"), spark.createDataFrame([("n", "x", 90), ("n", "y", None), ("n", "z", 120)], "ns string, c string, at int")
    assert {(r.c, r.lag, r.is_behind) for r in metrics.lag(heads, own, ["ns"], "head", "at", 50).collect()} == {("x", 10, False), ("y", 100, True), ("z", 0, False)}
    b = spark.createDataFrame([("s", i, 400) for i in range(6)], "s string, seq int, size int")
    assert [r.batch_no for r in metrics.batches(b, "s", F.floor(F.col("seq") / 2), ["seq"], F.col("size"), 1000).orderBy("seq").collect()] == [0, 0, 0, 1, 1, 2]


@pytest.mark.parametrize("seed", range(3))
def test_merges_in_any_order(spark, seed):
    r = random.Random(seed)
    reg = [("k", "v1", 5, "dc1"), ("k", "v2", 5, "dc2"), ("k", "v0", 4, "dc9"), ("k", "v2", 5, "dc2"), (None, "n", 1, "dc1")]
    r.shuffle(reg)
    out = crdt.lww(spark.createDataFrame(reg, "k string, value string, ts bigint, replica string"), ["k"], "ts", "replica", "value")
    assert {(x.k, x.value) for x in out.collect()} == {("k", "v2"), (None, "n")}
    ctr = [("k", "dc1", 3), ("k", "dc2", 4), ("k", "dc1", 5), ("k", "dc1", 2)]
    r.shuffle(ctr)
    df = spark.createDataFrame(ctr, "k string, replica string, count bigint")
    assert crdt.gcounter(df, ["k"], "replica", "count").first()["count"] == 9
    assert crdt.gcounter(df.limit(0), ["k"], "replica", "count").count() == 0


def test_updates_in_json(spark):
    values = [b'{"value":"x","timestamp":5,"replica":"dc1"}', b'{"replica":"dc2","count":7}', b"{broken", b"\xff\xfe", b"", None, b"[1]", b'{"replica":"dc2"}']
    rows = crdt.parsed(spark.createDataFrame([(v,) for v in values], "v binary"), "v").collect()
    assert [r.reg is not None for r in rows] == [True] + [False] * 7
    assert [r.ctr is not None for r in rows] == [False, True] + [False] * 6


def test_names_and_errors(spark):
    df = spark.createDataFrame([("Unavailable", "x"), ("OutOfRange", None), (None, "log truncated"), (None, "lost"), (None, None)], "code string, message string")
    assert [r[0] for r in df.select(text.error_kind(F.col("code"), F.col("message"))).collect()] == ["transient", "permanent", "permanent", "transient", "transient"]
    one_row = spark.range(1)
    value = lambda c: one_row.select(c).first()[0]
    assert value(text.metric_name(F.lit("m"), F.array(F.lit("a b"), F.lit("c:d")))) == "m.a_b.c_d"
    assert value(text.config_hash(F.lit("a"), F.lit(None), F.lit(3))) == __import__("hashlib").sha256(b"a||3").hexdigest()
    assert value(text.joined_path(F.lit("a/"), F.lit(""), F.lit("b"))) == "a/b"
    assert 80 <= value(text.backoff_ms(F.lit(0), 100, 250)) <= 120 and 200 <= value(text.backoff_ms(F.lit(99), 100, 250)) <= 300


def test_samples_and_synthetic_rows(spark):
    from ledgerfold.sources import synthetic

    rows = spark.createDataFrame([("debug",)] * 5 + [("INFO",)] * 400 + [("other",), (None,)], "level string")
    kept = {r.level: r["count"] for r in metrics.sampled_levels(rows, "level").groupBy("level").count().collect()}
    assert kept["debug"] == 5 and 50 < kept["INFO"] < 150 and "other" not in kept
    assert metrics.sampled_levels(rows, "level", {"Info": 0}).where("level = 'INFO'").count() == 0
    with pytest.raises(ValueError):
        metrics.sampled_levels(rows, "level", {"loud": 1})
    keys_made = [bytes(r.key) for r in synthetic.keys(spark, 50, 3).collect()]
    assert keys_made == [bytes(r.key) for r in synthetic.keys(spark, 50, 3).repartition(5).orderBy("key_no").collect()]
    assert len(set(keys_made)) == 50 and all(5 <= len(k) <= 256 for k in keys_made)
    sizes = [len(r.value) for r in synthetic.values(spark, 200).collect()]
    assert min(sizes) >= 100 and max(sizes) <= 102_400 and 150 < sum(s <= 2048 for s in sizes) < 199
    assert {r.key_no for r in synthetic.picks(spark, 500, 10).collect()} == set(range(10))


def sent(rows, limit):
    """(stream, seq) and batch number as the sender's loop cuts them."""
    out, at = {}, {}
    for s, seq, size in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        done, size_open = at.get(s, (0, 0))
        out[s, seq], size_open = done, size_open + (size or 0)
        at[s] = (done + 1, 0) if size_open >= limit else (done, size_open)
    return out


def test_sender_flushes(spark):
    """A flush resets the size, so what a batch has over the limit doesn't shorten the next; one stream has most records."""
    r = random.Random(0)
    rows = [("s", i, 400) for i in range(6)] + [(r.choice([None, "hot", "hot", "hot"]), i, r.choice([0, None, 1, 90, 300, 999, 1000, 2500])) for i in range(600)]
    rows += [("small", i, 7) for i in range(40)] + [("empty", 0, None)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "s string, seq int, size int")
    for limit, width in ((1000, 2), (1000, 50), (1, 7), (5000, 3)):
        got = metrics.flushes(df, "s", F.floor(F.col("seq") / width), ["seq"], F.col("size"), limit)
        assert got.columns == ["s", "seq", "size", "batch_no"]
        assert {(x.s, x.seq): x.batch_no for x in got.collect()} == sent(rows, limit)
    assert [sent(rows, 1000)["s", i] for i in range(6)] == [0, 0, 0, 1, 1, 1]
    assert metrics.flushes(df.limit(0), "s", F.floor(F.col("seq") / 2), ["seq"], F.col("size"), 1000).count() == 0


def test_stream_flushes_query(spark):
    """Numbers without gaps, and only the last batch of a consumer under 1,024 bytes."""
    import os

    import __spark_entry__

    at = "/root/testdata/sf0.001"
    if not os.path.exists(at):
        pytest.skip("no test tables here")
    rows = spark.read.parquet(f"{at}/stream_batches.parquet").select("consumer_id", "batch_id", F.posexplode("records")).select("consumer_id", "batch_id", "pos", F.octet_length("col.record")).collect()
    wanted = {}
    numbers, sizes = sent([(c, (b, p), n) for c, b, p, n in rows], 1024), {(c, (b, p)): n or 0 for c, b, p, n in rows}
    for (c, place), no in numbers.items():
        n, total = wanted.get((c, no), (0, 0))
        wanted[c, no] = (n + 1, total + sizes[c, place])
    assert {(x.consumer_id, x.batch_no): (x.n_records, x.n_bytes) for x in __spark_entry__.queries()["stream_flushes"](spark, at).collect()} == wanted
    last = {c: max(no for k, no in wanted if k == c) for c, _ in wanted}
    assert all(total >= 1024 or no == last[c] for (c, no), (_, total) in wanted.items())
