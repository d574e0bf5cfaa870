"""The text queries against their SQL on the smallest tables."""

import pytest
from test_entry import DIR, check, duck, empty_dir, entry_module, pytestmark  # noqa: F401

from ledgerfold.llm import queries


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, tmp_path, name):  # noqa: F811
    check(spark, duck, tmp_path, name)


def test_columns(spark):
    wanted = {"p6_ids": ["doc_id", "ids"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id"]}
    assert {n: queries.QUERIES[n](spark, DIR).columns for n in wanted} == wanted


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty_tables(spark, empty_dir, name):  # noqa: F811
    full, nothing = queries.QUERIES[name](spark, DIR), queries.QUERIES[name](spark, empty_dir)
    assert nothing.count() == 0 and nothing.dtypes == full.dtypes
