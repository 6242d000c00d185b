"""Queries for the query-log audit and bounded reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescout.functions import text as X
from tablescout.operators import audit as A
from tablescout.operators import reads as R
from tablescout.plans.derived import duckdb_cte, view
from tablescout.plans.registry import query
from tablescout.sources.tables import load


@query("find_mutations", duckdb_cte("query_log") + r"""
SELECT event_id, array_to_string(list_sort(list_distinct(list_transform(
  regexp_extract_all(sql, '(?i)\b(INSERT|UPDATE|DELETE|DROP|TRUNCATE|ALTER|CREATE|EXEC|EXECUTE|GRANT|REVOKE|MERGE)\b'),
  lambda x: upper(x)))), ',') AS mutations FROM query_log
""")
def find_mutations(spark, d):
    return A.find_mutations(view(spark, d, "query_log")).select(
        "event_id", F.array_join("mutations", ",").alias("mutations")
    )


@query("audit_readonly", duckdb_cte("query_log") + r"""
SELECT event_id, coalesce(NOT regexp_matches(sql, '(?i)\b(INSERT|UPDATE|DELETE|DROP|TRUNCATE|ALTER|CREATE)\b'), true) AS readonly
FROM query_log
""")
def audit_readonly(spark, d):
    return A.audit_readonly(view(spark, d, "query_log")).select("event_id", "readonly")


@query("audit_row_cap", duckdb_cte("query_log") + rf""", parsed AS (
SELECT event_id, sql, regexp_matches(sql, '(?i){X.SELECT_START}') AS is_select,
       TRY_CAST(nullif(regexp_extract(sql, '(?i){X.CAPPED_SELECT}', 1), '') AS BIGINT) AS own_cap FROM query_log)
SELECT event_id, coalesce(own_cap, -1) AS own_cap, is_select AND (own_cap IS NULL OR own_cap > 100) AS was_limited,
       CASE WHEN is_select AND (own_cap IS NULL OR own_cap > 100)
            THEN regexp_replace(sql, '(?i){X.CAP_PLACE}', '\1TOP 100 ') ELSE sql END AS capped_sql
FROM parsed
""")
def audit_row_cap(spark, d):
    return A.audit_row_cap(view(spark, d, "query_log")).select(
        "event_id", F.coalesce("own_cap", F.lit(-1)).alias("own_cap"), "was_limited", "capped_sql"
    )


MARKED_SQL = " OR ".join(f"contains(lower(error_text), '{m}')" for m in X.RATE_LIMIT_MARKS)


@query("error_triage", duckdb_cte("query_log") + rf"""
SELECT event_id,
  coalesce({MARKED_SQL}, false) AS rate_limited,
  coalesce(TRY_CAST(nullif(regexp_extract(error_text, '(?i){X.RETRY_AFTER}', 1), '') AS DOUBLE),
    TRY_CAST(nullif(regexp_extract(error_text, '(?i){X.SECONDS}', 1), '') AS DOUBLE)) AS retry_after_s,
  coalesce(TRY_CAST(nullif(regexp_extract(error_text, '(?i){X.RETRY_AFTER}', 1), '') AS DOUBLE),
    TRY_CAST(nullif(regexp_extract(error_text, '(?i){X.SECONDS}\b', 1), '') AS DOUBLE)) AS retry_after_strict_s
FROM query_log WHERE error_text IS NOT NULL
""")
def error_triage(spark, d):
    return A.error_triage(view(spark, d, "query_log").where("error_text IS NOT NULL")).drop("sql", "error_text")


TOP_ORDERS = "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey"


@query("bounded_read", TOP_ORDERS + " LIMIT 100")
def bounded_read(spark, d):
    load(spark, d, "orders").createOrReplaceTempView("orders")
    return R.bounded_read(spark, TOP_ORDERS).rows


STATEMENTS = [
    TOP_ORDERS,
    "SELECT o_orderkey FROM orders WHERE o_totalprice < 0",
    "SELECT max(o_totalprice) AS top_price FROM orders",
    "WITH f AS (SELECT * FROM orders WHERE o_orderstatus = 'F') SELECT o_orderkey FROM f",
    "DROP TABLE orders",
    "SELECT 1; DELETE FROM orders",
]


@query("bounded_read_status", f"""
SELECT * FROM (
SELECT '{TOP_ORDERS}' AS sql, 'success' AS status, least(count(*), 100) AS row_count,
       count(*) >= 100 AS truncated, count(*) > 100 AS more_rows FROM orders
UNION ALL SELECT '{STATEMENTS[1]}', CASE WHEN count(*) > 0 THEN 'success' ELSE 'empty' END, least(count(*), 100),
       count(*) >= 100, count(*) > 100 FROM orders WHERE o_totalprice < 0
UNION ALL SELECT '{STATEMENTS[2]}', 'success', 1, false, false FROM (SELECT max(o_totalprice) FROM orders)
UNION ALL SELECT '{STATEMENTS[3].replace("'", "''")}', 'success', least(count(*), 100),
       false, count(*) > 100 FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT '{STATEMENTS[4]}', 'error', 0, false, false
UNION ALL SELECT '{STATEMENTS[5]}', 'error', 0, false, false)
""")
def bounded_read_status(spark, d):
    load(spark, d, "orders").createOrReplaceTempView("orders")
    out = None
    for text in STATEMENTS:
        one = R.bounded_read(spark, text).status.select("sql", "status", "row_count", "truncated", "more_rows")
        out = one if out is None else out.unionByName(one)
    return out.na.fill(0).na.fill(False)


@query("scalar_read", "SELECT max(o_totalprice) AS value FROM orders")
def scalar_read(spark, d):
    load(spark, d, "orders").createOrReplaceTempView("orders")
    return R.scalar_read(spark, "SELECT max(o_totalprice), count(*) FROM orders")


@query("param_binding", "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey = 3 AND s_acctbal > 0 ORDER BY s_suppkey LIMIT 100")
def param_binding(spark, d):
    load(spark, d, "supplier").createOrReplaceTempView("supplier")
    text = "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey = ? AND s_acctbal > ? ORDER BY s_suppkey"
    return R.bounded_read(spark, text, args=[3, 0.0]).rows
