"""Per-key results against plain Python, with a key that has most rows."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerfold.operators import skew

SCHEMA = "ns string, key binary, value string, n int, _offset string"


def write(spark, path, rows, files=3):
    """The rows in files of about equal size, in order."""
    size = -(-len(rows) // files) or 1
    for i in range(files):
        spark.createDataFrame(rows[i * size : (i + 1) * size], SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/part={i}")
    return spark.read.schema(SCHEMA).parquet(*[f"{path}/part={i}" for i in range(files)])


def brute(rows):
    out = {}
    for ns, key, value, *_ in rows:
        n, nulls, changes, last = out.get((ns, key), (0, 0, 0, None))
        out[ns, key] = (n + 1, nulls + (value is None), changes + (n > 0 and last != value), value)
    return {k: v[:3] for k, v in out.items()}


@pytest.mark.parametrize("block,chunk", [(7, 5), (1000, 3), (4, 1000)])
def test_against_brute_force(spark, tmp_path, block, chunk):
    r = random.Random(block)
    rows = [(r.choice(["a", "b", None]), r.choice([b"hot"] * 6 + [b"x", b"", None]), r.choice(["u", "v", None]), 1, "clash") for _ in range(200)]
    df = write(spark, str(tmp_path / "t"), rows)
    placed = skew.positioned(df, "ns", "key", "value", block_rows=block)
    found = skew.per_key(placed, ["ns", "key"], "value", chunk_rows=chunk).collect()
    assert {(x.ns, None if x.key is None else bytes(x.key)): (x.n, x.nulls, x.changes) for x in found} == brute(rows)
    assert len(found) == len(brute(rows))


def test_numbers_and_chunks(spark, tmp_path):
    """Every key's rows have the numbers from 0 on in input order, and no chunk has more than its rows."""
    rows = [("a", b"hot" if i % 5 else b"%d" % i, str(i), i, "c") for i in range(100)]
    df = write(spark, str(tmp_path / "t"), rows)
    out = skew.numbered(skew.positioned(df, "ns", "key", "n", "_offset", block_rows=9), ["ns", "key"], chunk_rows=8).collect()
    seen = {}
    for ns, key, _, n, _ in rows:
        seen.setdefault(key, []).append(n)
    assert {(bytes(x.key), x.n): x[skew.NUMBER] for x in out} == {(k, n): i for k, ns in seen.items() for i, n in enumerate(ns)}
    assert all(x[skew.CHUNK] == x[skew.NUMBER] // 8 and x._offset == "c" for x in out)


def test_heavy_and_empty(spark, tmp_path):
    rows = [("a", b"hot", "v", 1, "")] * 50 + [("a", b"k%d" % i, "v", 1, "") for i in range(49)] + [("b", b"one", None, 1, "")]
    df = write(spark, str(tmp_path / "t"), rows, 2)
    results = skew.per_key(skew.positioned(df, "ns", "key", "value"), ["ns", "key"], "value")
    assert {(x.ns, bytes(x.key)) for x in skew.heavy(results, 50, ["ns"]).collect()} == {("a", b"hot"), ("b", b"one")}
    empty = write(spark, str(tmp_path / "e"), [], 1)
    nothing = skew.per_key(skew.positioned(empty, "ns", "key", "value"), ["ns", "key"], "value")
    assert nothing.count() == 0
    assert skew.heavy(nothing, 50, ["ns"]).count() == 0


def test_groups_stay_small(spark, tmp_path):
    """A single key in all rows: no group of any step has more rows than a block or a chunk."""
    df = write(spark, str(tmp_path / "t"), [("a", b"k", str(i), i, "") for i in range(300)])
    out = skew.numbered(skew.positioned(df, "ns", "key", "value", block_rows=20), ["ns", "key"], chunk_rows=10)
    assert out.groupBy("ns", "key", skew.FILE, skew.BLOCK).count().agg(F.max("count")).first()[0] <= 20
    assert out.groupBy("ns", "key", skew.CHUNK).count().agg(F.max("count")).first()[0] <= 10


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_running_sums(spark, width):
    r = random.Random(width)
    rows = [(r.choice(["a", "a", "a", None]), i, r.randint(0, 9)) for i in range(120)]
    df = spark.createDataFrame(rows, "k string, seq int, v bigint")
    found = {x.seq: x.before for x in skew.running(df, ["k"], F.floor(F.col("seq") / width), ["seq"], F.col("v"), "before").collect()}
    sums, wanted = {}, {}
    for k, i, v in rows:
        wanted[i] = sums.get(k, 0)
        sums[k] = wanted[i] + v
    assert found == wanted
