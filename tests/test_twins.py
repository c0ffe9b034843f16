"""A selection of the registered queries against DuckDB; check.py compares all of them."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, compare

SELECTED = [
    "area_ranking_district", "kpis_winsorised", "monthly_series", "seasonal_pivot", "repeat_sales", "box_stats",
    "lake_outcode2_year", "certificate_link_keys", "dataset_order_and_limit", "link_full", "address_cohort",
    "balanced_sample_documents", "render_labelled", "token_features",
]


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SELECTED)
def test_twin(spark, sf_dir, con, name):
    verdict, _, note = compare(spark, sf_dir, entry.queries()[name], entry.oracle_sql()[name], con)
    assert verdict == "ok", note


def test_registry(spark):
    queries, twins = entry.queries(), entry.oracle_sql()
    assert set(twins) <= set(queries) and set(entry.HEADLINE) <= set(queries) and set(SELECTED) <= set(twins)
    assert entry.entry(spark).columns == ["District", "Year", "median_price", "volume", "median_prev", "yoy_pct"]
