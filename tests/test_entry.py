"""Every registered query against its SQL on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as entry_module

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(DIR), reason="no test tables here")

NAMES = [n for n, f in entry_module.queries().items() if not f.__module__.startswith("ledgerfold.llm")]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def test_every_sql_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["ns_name", "entry_type", "key_hex", "cell_name", "lsn", "entry_no"] and df.count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, tmp_path, name):
    check(spark, duck, tmp_path, name)


def check(spark, duck, tmp_path, name):
    entry_module.queries()[name](spark, DIR).write.parquet(str(tmp_path / "out"))
    duck.execute(f"create or replace view got as select * from '{tmp_path}/out/*.parquet'")
    sql = entry_module.oracle_sql().get(name)
    if sql is None:
        return
    columns = ", ".join(r[0] for r in duck.execute(f"describe {sql}").fetchall())
    assert sorted(columns.split(", ")) == sorted(r[0] for r in duck.execute("describe got").fetchall())
    duck.execute(f"create or replace table wanted as {sql}")
    assert duck.execute(f"select count(*) from (select {columns} from wanted except all select {columns} from got)").fetchone() == (0,)
    assert duck.execute("select (select count(*) from wanted) - (select count(*) from got)").fetchone() == (0,)


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("empty")
    for path in glob.glob(f"{DIR}/*.parquet"):
        spark.read.parquet(path).limit(0).coalesce(1).write.parquet(str(at / os.path.basename(path)))
    return str(at)


@pytest.mark.parametrize("name", [n for n in NAMES if n.startswith("p") and n[1].isdigit()] + ["stream_objects", "log_recover", "log_gaps"])
def test_empty_tables(spark, empty_dir, name):
    full, nothing = entry_module.queries()[name](spark, DIR), entry_module.queries()[name](spark, empty_dir)
    assert nothing.count() == 0 and nothing.dtypes == full.dtypes
