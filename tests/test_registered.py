"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest
from helpers import SMALL

from __spark_entry__ import entry, oracle_sql, queries
from tablescout.plans import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, sf_dir, duck, name):
    df = queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(map(str, r)) for r in df.select(*columns).collect())
    if name not in oracle_sql():
        assert got
        return
    rel = duck.sql(oracle_sql()[name])
    assert sorted(rel.columns) == columns
    order = [rel.columns.index(c) for c in columns]
    assert got == sorted(tuple(str(r[i]) for i in order) for r in rel.fetchall())


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(oracle_sql()) <= set(queries())
