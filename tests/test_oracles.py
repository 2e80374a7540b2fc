"""A cross-section of the registered queries against their SQL (all: oracle_check.py)."""

import pytest
from oracle_check import compare, duck

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = (
    "parse_capital", "parse_date", "contact_normalise", "keep_best_row", "upsert_sequence", "upsert_partial",
    "registry_load", "fill_blank_enrich", "capital_repair", "search_page", "search_or_exists", "facets",
    "contact_pivot_parts", "task_pack", "radius_batch_join", "centre_geocode", "street_match", "score_parts",
    "value_topn", "timing_percentiles", "token_all", "stream_flags",
)


@pytest.fixture(scope="module")
def con():
    pytest.importorskip("duckdb")
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    verdict, _, _, detail = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert verdict == "ok", detail


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry.__doc__
