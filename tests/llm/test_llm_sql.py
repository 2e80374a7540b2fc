"""Every training-data query that SQL can express, beside its SQL."""

import pytest
from oracle_check import compare, duck

import __spark_entry__ as entry
from leadlake.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_sql(spark, name):
    pytest.importorskip("duckdb")
    verdict, rows, _, detail = compare(spark, duck(SF), name, QUERIES[name], ORACLES[name], SF)
    assert verdict == "ok" and rows, detail


def test_entry_points_list_them():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql())
