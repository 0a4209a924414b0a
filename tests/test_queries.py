"""Registered queries against their SQL on the smallest driver tables, where those are present."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, compare

SF = "/root/testdata/sf0.001"
NAMES = [
    "latest_per_url", "catalogue_stats", "site_summary", "lookup_product", "export_csv", "export_xml", "expand_sitemap_index",
    "urls_from_sitemaps", "infer_product_urls", "urls_from_wp_rest", "extract_links", "parse_products", "apply_selector_rules",
    "site_report", "retry_plan", "price_context", "upsert_latest", "stream_host_blocks",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    found = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert compare(df.collect(), df.columns, found.fetchall(), names) is None


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry
