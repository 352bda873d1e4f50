"""Registered queries against their SQL on the smallest data. All of them: ``python tests/compare.py``."""

from __future__ import annotations

import os

import duckdb
import pytest
from compare import compare, duck

import __spark_entry__ as entry
from prodlens.catalog.oracles import ORACLES
from prodlens.catalog.queries import REGISTRY

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CHECKED = [
    "panel_month", "asof_state", "interval_join_sliced", "entity_attrs", "monthly_cube", "block_cube", "dict_encode",
    "type_curve_exact", "spec_query", "top6_dense_series", "reconcile_series", "null_zero_census", "describe_by_group",
    "histogram_fd_log", "lorenz_curve", "spearman_matrix", "gloss_labels", "entity_history", "year_coverage",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql_except_file_hashes():
    assert set(REGISTRY) - set(ORACLES) == {"file_manifest"}
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["provincia", "oil"]


@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, con, name):
    assert compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF) is None


def test_national_monthly_keeps_every_cent(spark, con, tmp_path):
    """A month of little production is not cut to nothing, and the SQL says the same."""
    small = tmp_path / "star"
    small.mkdir()
    for table in ("customer", "nation", "region", "embeddings", "supplier", "lineitem"):
        con.execute(f"COPY {table} TO '{small}/{table}.parquet'")
    con.execute(
        f"""COPY (SELECT * REPLACE (CASE WHEN o_orderkey % 2 = 0 THEN 0.25 ELSE 12.13 END AS o_totalprice)
                  FROM orders) TO '{small}/orders.parquet'"""
    )
    own = duckdb.connect()
    for table in ("customer", "nation", "region", "embeddings", "supplier", "lineitem", "orders"):
        own.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    query, sql = entry.queries()["national_monthly"], entry.oracle_sql()["national_monthly"]
    assert compare(spark, own, "national_monthly", query, sql, str(small)) is None
    rows = query(spark, str(small)).collect()
    assert any(0 < r.oil_m3 < 1000 and r.oil_m3 != int(r.oil_m3) for r in rows)
