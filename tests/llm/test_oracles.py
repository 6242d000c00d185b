"""Queries of the subpackage that SQL can express, against it."""

import duckdb
import pytest
from brute import SMALL_TABLES

from tablescout.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL_TABLES}/{t}.parquet'")
    df = QUERIES[name](spark, SMALL_TABLES)
    columns = sorted(df.columns)
    rel = con.sql(ORACLES[name])
    assert sorted(rel.columns) == columns
    order = [rel.columns.index(c) for c in columns]
    got = sorted(tuple(map(str, r)) for r in df.select(*columns).collect())
    assert got == sorted(tuple(str(r[i]) for i in order) for r in rel.fetchall())
