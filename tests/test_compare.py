"""Differences between two copies."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from ledgerfold.operators import compare

SCHEMA = "ns string, key binary, v binary, t timestamp_ntz, c bigint, _n0 string, l string"
T1, T2 = datetime.datetime(2025, 1, 1), datetime.datetime(2025, 1, 1, 0, 0, 0, 1)


def run(spark, left, right, **more):
    pad = lambda rows: spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    rows = compare.differences(pad(left), pad(right), ["ns", "key"], ["v", "t", "c"], **more).collect()
    assert len({(r.ns, r.key if r.key is None else bytes(r.key)) for r in rows}) == len(rows)
    return {(r.ns, None if r.key is None else bytes(r.key)): (r.in_left, r.in_right, [tuple(d) for d in r.diffs]) for r in rows}


def test_kinds_of_differences(spark):
    left = [("a", b"1", b"x", T1, 1), ("a", b"2", None, T1, 0), ("a", b"3", b"", None, None), ("a", b"only", b"x", T1, 1), (None, None, b"n", T1, 1), ("same", b"s", None, None, None)]
    right = [("a", b"1", b"x", T2, 1), ("a", b"2", b"", T1, None), ("a", b"3", b"", None, None), ("b", b"1", b"x", T1, 1), (None, None, b"m", T1, 1), ("same", b"s", None, None, None)]
    assert run(spark, left, right) == {
        ("a", b"1"): (True, True, [("t", "2025-01-01 00:00:00", "2025-01-01 00:00:00.000001")]),
        ("a", b"2"): (True, True, [("v", None, ""), ("c", "0", None)]),
        ("a", b"only"): (True, False, []),
        ("b", b"1"): (False, True, []),
        (None, None): (True, True, [("v", "6E", "6D")]),
    }


def test_null_key_is_not_an_empty_key(spark):
    assert run(spark, [("", b"", b"x", T1, 1)], [(None, None, b"x", T1, 1)]) == {("", b""): (True, False, []), (None, None): (False, True, [])}


def test_repeats_and_ties(spark):
    """Exact repeats count once, however many; unequal rows with one key are compared as sets."""
    assert run(spark, [("a", b"1", b"x", T1, 1)] * 300, [("a", b"1", b"x", T1, 1)] * 2) == {}
    two = [("a", b"1", b"x", T1, 1), ("a", b"1", None, T1, 9)]
    assert run(spark, two, two[::-1]) == {}
    assert run(spark, two, two[1:]) == {("a", b"1"): (True, True, [("v", "78", None), ("c", "1", None)])}


def test_unequal_rows_of_one_key(spark):
    """{A, B} against {B} is reported, whichever is the greater, and so are other combinations of the same values."""
    a, b = ("a", b"1", b"x", T1, 1), ("a", b"1", b"y", T1, 1)
    for one in (a, b):
        other = b if one is a else a
        assert run(spark, [a, b], [one] * 3) == {("a", b"1"): (True, True, [("v", "78" if other is a else "79", None)])}
        assert run(spark, [one], [a, b]) == {("a", b"1"): (True, True, [("v", None, "78" if other is a else "79")])}
    c, d = ("a", b"1", b"x", T1, 2), ("a", b"1", b"y", T1, 2)
    assert run(spark, [a, d], [b, c]) == {("a", b"1"): (True, True, [("rows", None, None)])}
    assert run(spark, [a, b], [b, a, a]) == {}
    assert run(spark, [a, b], []) == {("a", b"1"): (True, False, [])}
    null = ("a", b"1", None, None, None)
    empty = ("a", b"1", b"", None, None)
    assert run(spark, [a, null], [a, empty]) == {("a", b"1"): (True, True, [("v", None, "")])}


def test_many_unequal_rows_of_a_hot_key(spark):
    rows = [("a", b"hot", b"%d" % i, T1, i) for i in range(500)]
    assert run(spark, rows, rows[::-1] * 2) == {}
    assert run(spark, rows, rows[1:]) == {("a", b"hot"): (True, True, [("v", "30", None), ("c", "0", None)])}


def test_empty_and_long(spark):
    assert run(spark, [], []) == {}
    assert run(spark, [("a", b"1", b"x" * 100_000, T1, 1)], []) == {("a", b"1"): (True, False, [])}


def test_normalised(spark):
    left, right = [("a", b"1", b"X ", T1, 1)], [("a", b"1", b"x", T1, 1)]
    assert len(run(spark, left, right)) == 1
    assert run(spark, left, right, normalise={"v": F.lower(F.trim(F.col("v").cast("string")))}) == {}


@pytest.mark.parametrize("seed", [1, 2])
def test_random(spark, seed):
    r = random.Random(seed)
    side = lambda: {(r.choice("ab"), b"%d" % r.randint(0, 20)): (r.choice([None, b"", b"x"]), r.choice([None, T1]), r.choice([None, 0, 1])) for _ in range(30)}
    a, b = side(), side()
    rows = lambda s: [(*k, *v) for k, v in s.items() for _ in range(r.randint(1, 2))]
    found = run(spark, rows(a), rows(b))
    wanted = {k for k in a.keys() | b.keys() if a.get(k) != b.get(k)}
    assert found.keys() == wanted
    for k in wanted & a.keys() & b.keys():
        assert [d[0] for d in found[k][2]] == [f for f, x, y in zip("vtc", a[k], b[k]) if x != y]
