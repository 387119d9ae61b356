"""Registered queries against DuckDB on the smallest tables."""

import duckdb
import pytest

from loomtide.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "customer orders lineitem events part conversations".split()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    relation = con.sql(SQL[name])
    assert sorted(relation.columns) == columns
    want = sorted(tuple(str(row[relation.columns.index(c)]) for c in columns) for row in relation.fetchall())
    assert sorted(tuple(str(r[c]) for c in columns) for r in df.collect()) == want


def test_entry_imports():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
