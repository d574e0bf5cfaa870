"""Runs over only what is new, and the records that followers still have to process."""

import random

import pytest

from ledgerfold.operators import incremental
from ledgerfold.operators.incremental import IncrementalStore, outstanding
from ledgerfold.session import work_folder

SOURCE = "stream string, seq bigint, value string, _top string"
LOG = "ns_name string, lsn bigint, lo bigint, stretch string"
REQUESTS = "request_id bigint, consumer_id string, ns_name string, start_lsn bigint, latest_lsn bigint, outcome string"


def test_runs(spark):
    store = IncrementalStore(spark, work_folder(spark, "t").path)
    rows = [("a", 1, "x"), ("a", 2, "y"), (None, 5, "n"), ("b", None, "never")]
    df = lambda: spark.createDataFrame(rows, "stream string, seq bigint, value string")
    assert store.run(df(), "seq", ["stream"]) == 1
    assert sorted(r.value for r in store.output().collect()) == ["n", "x", "y"]
    rows += [("a", 3, "z"), ("a", 2, "late"), ("c", 1, "new"), (None, 6, "m")]
    store.run(df(), "seq", ["stream"])
    assert sorted(r.value for r in store.output(2).collect()) == ["m", "new", "z"]
    store.run(df(), "seq", ["stream"])
    assert store.output(3).count() == 0
    assert sorted((r.stream or "", r.mark) for r in store.marks().collect()) == [("", 6), ("a", 3), ("c", 1)]


def test_failed_runs_leave_nothing(spark):
    store = IncrementalStore(spark, work_folder(spark, "t").path)
    df = spark.createDataFrame([("a", i, str(i)) for i in range(5)], "stream string, seq bigint, value string")

    def fails(_):
        raise OSError("lost")

    with pytest.raises(OSError):
        store.run(df, "seq", ["stream"], fails)
    commit, store.folder.commit_json = store.folder.commit_json, lambda *a: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        store.run(df, "seq", ["stream"])
    store.folder.commit_json = commit
    assert store.runs() == [] and store.marks() is None
    store.run(df, "seq", ["stream"])
    assert store.output().count() == 5


def test_two_writers_one_wins(spark):
    store = IncrementalStore(spark, work_folder(spark, "t").path)
    store.folder.commit_json("commits/1.json", {"run": 1})
    with pytest.raises(FileExistsError):
        store.folder.commit_json("commits/1.json", {"run": 1})
    assert store.folder.names("commits") == ["1.json"] and not [n for n in store.folder.names() if n.endswith(".draft")]


def test_the_loser_leaves_the_winners_rows(spark):
    """Two writers of one run: the second one to commit fails, and what the first committed stays as it was."""
    path = work_folder(spark, "t").path
    one, two = IncrementalStore(spark, path), IncrementalStore(spark, path)
    rows = lambda v: spark.createDataFrame([("a", 1, v)], "stream string, seq bigint, value string")

    def slow(df):
        one.run(rows("first"), "seq", ["stream"])
        return df

    with pytest.raises(FileExistsError):
        two.run(rows("second"), "seq", ["stream"], slow)
    assert [r.value for r in one.output().collect()] == ["first"] == [r.value for r in two.output().collect()]
    assert [r.mark for r in two.marks().collect()] == [1]


def test_source_that_grows_between_the_jobs(spark, tmp_path):
    """The limit is written first: what arrives while a run works belongs to the next run, nothing is skipped or repeated."""
    path = str(tmp_path / "source")
    schema = "stream string, seq bigint, value string"
    add = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    source = lambda: spark.read.schema(schema).parquet(path)
    store = IncrementalStore(spark, work_folder(spark, "t").path)
    add(("a", 1, "1"), ("b", 1, "b1"))
    calls = []

    def reads():  # more has come each time that the source is read
        calls.append(1)
        add(("a", 10 + len(calls), "late"), ("c", len(calls), "new"))
        return source()

    store.run(reads, "seq", ["stream"])
    marks = {r.stream: r.mark for r in store.marks().collect()}
    first = {(r.stream, r.seq) for r in store.output().collect()}
    assert len(calls) > 2 and first == {(r.stream, r.seq) for r in source().collect() if r.seq <= marks.get(r.stream, 0)}

    def fails(df):
        add(("a", 99, "more"))
        raise OSError("lost")

    with pytest.raises(OSError):
        store.run(source, "seq", ["stream"], fails)
    store.run(source, "seq", ["stream"])
    rows = [(r.stream, r.seq) for r in store.output().collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {(r.stream, r.seq) for r in source().collect()}


def test_limits_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("'a' AS stream", "id AS seq").write.parquet(str(tmp_path / "s"))
    source = spark.read.parquet(str(tmp_path / "s"))
    store = IncrementalStore(spark, work_folder(spark, "t").path)
    store.run(source, "seq", ["stream"], upto=40)
    seen = []

    def step(df):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    store.run(source, "seq", ["stream"], step)
    assert "GreaterThan(seq,40)" in seen[0] and "LessThanOrEqual(seq,99)" in seen[0]
    assert store.output(1).count() == 41 and store.output(2).count() == 59


def test_unordered_rows(spark):
    rows = spark.createDataFrame([("a", None, "n"), ("a", 1, "x")], "stream string, seq bigint, value string")
    store = IncrementalStore(spark, work_folder(spark, "t").path)
    for _ in range(2):
        store.run(rows, "seq", ["stream"], first_takes_unordered=True)
    assert sorted(r.value for r in store.output().collect()) == ["n", "x"]


@pytest.mark.parametrize("seed", [4, 5])
def test_outstanding_over_runs(spark, monkeypatch, seed):
    """A log that arrives in any order and with repeats, in three runs, gives what it gives at once."""
    monkeypatch.setattr(incremental, "STRETCH", 16)
    r = random.Random(seed)
    log = [(ns, n) for ns, start in (("a", 1), (None, 50)) for n in range(start, start + 60)]
    arrived = r.sample(log, len(log)) + r.sample(log, 30)
    requests = []
    for i in range(30):
        lo = r.choice([None, r.randint(1, 120)])
        requests.append((i, r.choice(["x", None]), r.choice(["a", None]), lo, r.choice([None, (lo or 0) + r.randint(-2, 30)]), r.choice(["ok", "failed", None])))
    source = spark.createDataFrame([(*x, i) for i, x in enumerate(arrived)], "ns_name string, lsn bigint, at bigint")
    store = IncrementalStore(spark, work_folder(spark, "t").path)
    step = incremental.outstanding_step(store, spark.createDataFrame(requests, REQUESTS))
    for upto in (30, 90, None):
        store.run(source, "at", ["ns_name"], step, upto=upto)
    rows = [tuple(x) for x in store.output().collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == brute(log, requests)


def brute(log, requests):
    held = {}
    for ns, lsn in log:
        if lsn is not None:
            held.setdefault(ns, set()).add(lsn)
    asked = {}
    for _, consumer, ns, lo, hi, outcome in requests:
        if ns in held:
            asked.setdefault((consumer, ns), []).append((min(held[ns]) if lo is None else lo, hi, outcome))
    out = set()
    for (consumer, ns), rs in asked.items():
        highs = [hi for _, hi, _ in rs if hi is not None]
        if highs:
            low, high = min(lo for lo, _, _ in rs), max(highs)
            out |= {(consumer, ns, n) for n in held[ns] if low <= n <= high and not any(o == "ok" and hi is not None and lo <= n <= hi for lo, hi, o in rs)}
    return out


@pytest.mark.parametrize("seed,stretch", [(1, 4096), (2, 7), (3, 16)])
def test_outstanding(spark, monkeypatch, seed, stretch):
    monkeypatch.setattr(incremental, "STRETCH", stretch)
    r = random.Random(seed)
    log = [(ns, n) for ns, start in (("a", 1), ("b", 100), (None, 50)) for n in range(start, start + 60) if r.random() < 0.9] * 2 + [("a", None)]
    requests = []
    for i in range(60):
        ns = r.choice(["a", "b", None, "unknown"])
        lo = r.choice([None, 0, r.randint(1, 160)])
        requests.append((i, r.choice(["x", "y", None]), ns, lo, r.choice([None, (lo or 0) + r.randint(-2, 30)]), r.choice(["ok", "ok", "failed", None])))
    requests += r.sample(requests, 10)
    found, _ = outstanding(spark.createDataFrame([(*x, 1, "s") for x in log], LOG), spark.createDataFrame(requests, REQUESTS))
    rows = [tuple(x) for x in found.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == brute(log, requests)


def test_outstanding_of_nothing(spark):
    log, requests = spark.createDataFrame([("a", 1, 1, "s")], LOG), spark.createDataFrame([(1, "c", "a", None, 5, "failed")], REQUESTS)
    assert [tuple(x) for x in outstanding(log, requests)[0].collect()] == [("c", "a", 1)]
    assert outstanding(log.limit(0), requests)[0].count() == 0
    assert outstanding(log, requests.limit(0))[0].count() == 0
