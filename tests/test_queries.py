"""Every query with SQL gives the same columns, types and rows in Spark and DuckDB; the others run."""

from __future__ import annotations

import pytest

from dipfold.plans import registry
from tests.oracle import difference, duck

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(spark, small, name):
    assert difference(spark, registry.QUERIES[name], registry.ORACLES[name], small) == ""
    types = {r[0]: r[1] for r in duck(small).execute("DESCRIBE " + registry.ORACLES[name]).fetchall()}
    assert {c: TYPES[t] for c, t in registry.QUERIES[name](spark, small).dtypes} == types


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, small, name):
    assert registry.QUERIES[name](spark, small).count() > 0


def test_number_formats_of_ties_and_missing_values(spark, tmp_path):
    """Balances whose percentage ends in 5, exact in binary or not, negative, zero and missing ones."""
    con = duck("/root/testdata/sf0.001")
    cents = "SELECT k AS s_suppkey, 's' AS s_name, 1 AS s_nationkey, CASE WHEN k % 997 > 0 THEN (k * 5 - 30000) / 1.0::DOUBLE + (k % 3) / 100 END AS s_acctbal FROM (SELECT unnest(generate_series(1, 12000)) AS k)"
    con.execute(f"COPY ({cents}) TO '{tmp_path}/supplier.parquet' (FORMAT parquet)")
    query, sql = registry.QUERIES["number_formats"], registry.ORACLES["number_formats"]
    want = {r[0]: r[1:] for r in con.execute(sql.replace("FROM supplier", f"FROM '{tmp_path}/supplier.parquet'")).fetchall()}
    got = {r[0]: tuple(r[1:]) for r in query(spark, str(tmp_path)).collect()}
    assert got == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
