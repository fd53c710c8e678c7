"""Every registered query with SQL gives the SQL's rows on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from jobs import registered
from phenospark.plans.oracle import ORACLE
from phenospark.plans.queries import QUERIES

QUERIES, ORACLE = QUERIES | registered.QUERIES, ORACLE | registered.ORACLE

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want, got = con.sql(ORACLE[name]).df(), QUERIES[name](spark, DATA).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = [sorted(map(repr, t[columns].astype(object).where(t[columns].notna(), None).to_numpy().tolist())) for t in (got, want)]
    assert rows[0] == rows[1]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())
