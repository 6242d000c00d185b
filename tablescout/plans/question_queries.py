"""Queries for the questions users ask."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescout.operators import questions as Q
from tablescout.plans.derived import duckdb_cte, view
from tablescout.plans.registry import query
from tablescout.sources.tables import load

AS_OF = "2001-08-01"


def day(column):
    return F.date_format(column, "yyyy-MM-dd")


@query("point_lookup", "SELECT s_name, s_acctbal FROM supplier WHERE s_suppkey = 7")
def point_lookup(spark, d):
    return Q.point_lookup(load(spark, d, "supplier"), "s_suppkey", 7, "s_name", "s_acctbal")


@query("filter_limit", """
SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 5
""")
def filter_limit(spark, d):
    c = load(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return Q.filter_limit(c, F.col("c_mktsegment") == "BUILDING", ["c_custkey"], 5)


@query("count_all", "SELECT count(*) AS n_rows FROM orders")
def count_all(spark, d):
    return Q.count_all(load(spark, d, "orders"))


@query("max_date", "SELECT strftime(max(o_orderdate), '%Y-%m-%d') AS last_date FROM orders")
def max_date(spark, d):
    return Q.max_date(load(spark, d, "orders"), "o_orderdate").select(day("last_date").alias("last_date"))


@query("age_filter", f"""
SELECT o_orderkey, CAST(date_diff('year', CAST(o_orderdate AS DATE), DATE '{AS_OF}') AS INTEGER) AS years
FROM orders WHERE date_diff('year', CAST(o_orderdate AS DATE), DATE '{AS_OF}') > 4
""")
def age_filter(spark, d):
    return Q.older_than(load(spark, d, "orders"), "o_orderdate", 4, AS_OF).select("o_orderkey", "years")


@query("join_person_debt", """
SELECT c_custkey, c_name, count(*) AS n_debts, round(sum(o_totalprice), 2) AS total_sum
FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name
""")
def join_person_debt(spark, d):
    out = Q.sum_per_person(
        load(spark, d, "customer").select("c_custkey", "c_name"), load(spark, d, "orders"),
        "c_custkey", "o_custkey", "o_totalprice",
    )
    return out.withColumn("total_sum", F.round("total_sum", 2))


@query("join_person_debt_rows", """
SELECT o_orderkey, c_custkey, c_name, o_totalprice FROM customer JOIN orders ON o_custkey = c_custkey
""")
def join_person_debt_rows(spark, d):
    orders = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return Q.person_debts(load(spark, d, "customer").select("c_custkey", "c_name"), orders, "c_custkey", "o_custkey")


@query("full_name", """
SELECT c_custkey,
       concat(coalesce(c_name, ''), ' ', coalesce(CASE WHEN c_acctbal >= 0 THEN c_mktsegment END, ''), ' ',
              coalesce(CAST(c_nationkey AS VARCHAR), '')) AS full_name
FROM customer
""")
def full_name(spark, d):
    named = Q.full_name(
        load(spark, d, "customer"),
        F.col("c_name"), F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")), F.col("c_nationkey"),
    )
    return named.select("c_custkey", "full_name")


@query("code_decode", duckdb_cte("code_dict") + """
SELECT c_mktsegment, d.name AS status_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total_sum
FROM orders JOIN customer ON c_custkey = o_custkey
LEFT JOIN code_dict d ON d.code = o_orderstatus AND d.dict_code = 6
GROUP BY c_mktsegment, d.name
""")
def code_decode(spark, d):
    out = Q.decoded_totals(
        load(spark, d, "customer"), load(spark, d, "orders"), view(spark, d, "code_dict"), 6,
        "c_custkey", "o_custkey", "o_orderstatus", "o_totalprice", "c_mktsegment",
    )
    return out.select(
        "c_mktsegment", F.col("o_orderstatus_name").alias("status_name"),
        F.col("n").alias("n_orders"), F.round("s", 2).alias("total_sum"),
    )


@query("status_by_person", duckdb_cte("code_dict") + """
SELECT c_name, o_orderkey, d.name AS status_name
FROM customer JOIN orders ON o_custkey = c_custkey
LEFT JOIN code_dict d ON d.code = o_orderstatus AND d.dict_code = 6
WHERE c_custkey = 123
""")
def status_by_person(spark, d):
    person = load(spark, d, "customer").where("c_custkey = 123").select("c_custkey", "c_name")
    orders = load(spark, d, "orders").where("o_custkey = 123").select(
        F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus"
    )
    out = Q.decode(person.join(orders, "c_custkey"), "o_orderstatus", view(spark, d, "code_dict"), 6)
    return out.select("c_name", "o_orderkey", F.col("o_orderstatus_name").alias("status_name"))


@query("latest_n", """
SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM orders
ORDER BY orders.o_orderdate DESC, o_orderkey LIMIT 10
""")
def latest_n(spark, d):
    out = Q.latest_n(load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderdate", "o_orderkey", 10)
    return out.withColumn("o_orderdate", day("o_orderdate"))


@query("latest_n_per_key", """
SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders
) WHERE rank <= 3
""")
def latest_n_per_key(spark, d):
    orders = load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    out = Q.latest_n_per_key(orders, "o_custkey", "o_orderdate", "o_orderkey", 3)
    return out.withColumn("o_orderdate", day("o_orderdate"))


@query("latest_per_key", """
SELECT o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderkey FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders
) WHERE rn = 1
""")
def latest_per_key(spark, d):
    out = Q.latest_per_key(load(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey")
    return out.withColumn("o_orderdate", day("o_orderdate"))


def link_targets(spark, d):
    return Q.tagged_union({
        "customer": (load(spark, d, "customer"), "c_custkey", "c_name"),
        "supplier": (load(spark, d, "supplier"), "s_suppkey", "s_name"),
        "part": (load(spark, d, "part"), "p_partkey", "p_name"),
    })


TARGETS_SQL = """, targets AS (
  SELECT 'customer' AS obj, c_custkey AS r_id, c_name AS target_name FROM customer
  UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier
  UNION ALL SELECT 'part', p_partkey, p_name FROM part)
"""


@query("polymorphic_links", duckdb_cte("links") + TARGETS_SQL + """
SELECT id, obj, r_id, target_name FROM links LEFT JOIN targets USING (obj, r_id)
""")
def polymorphic_links(spark, d):
    return Q.resolve_links(view(spark, d, "links"), link_targets(spark, d))


@query("dangling_links", duckdb_cte("links") + TARGETS_SQL + """
SELECT obj, r_id, count(*) AS n_links FROM links
WHERE NOT EXISTS (SELECT 1 FROM targets t WHERE t.obj = links.obj AND t.r_id = links.r_id)
GROUP BY obj, r_id
""")
def dangling_links(spark, d):
    return Q.dangling_links(view(spark, d, "links"), link_targets(spark, d))


@query("parent_chain", """
SELECT n_nationkey, n_name, count(*) AS n_lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
JOIN nation ON n_nationkey = c_nationkey GROUP BY n_nationkey, n_name
""")
def parent_chain(spark, d):
    out = Q.parent_chain_totals(*[load(spark, d, t) for t in ("lineitem", "orders", "customer", "nation")])
    return out.select("n_nationkey", "n_name", F.col("n").alias("n_lines"), F.round("v", 2).alias("revenue"))


# Orders hang on the customer's order before, except: every 23rd customer's first order hangs on the last one, so these
# orders go round; every 17th order hangs on one that does not exist.
PREVIOUS_ORDER = """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 17 = 0 THEN -o_orderkey
  WHEN o_custkey % 23 = 0 THEN coalesce(lag(o_orderkey) OVER w, max(o_orderkey) OVER (PARTITION BY o_custkey))
  ELSE lag(o_orderkey) OVER w END AS parent
FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)"""


@query("parent_hierarchy", "WITH RECURSIVE nodes AS (" + PREVIOUS_ORDER.replace("{orders}", "orders") + """),
above(id, up) AS (SELECT id, parent FROM nodes WHERE parent IN (SELECT id FROM nodes)
  UNION SELECT a.id, n.parent FROM above a JOIN nodes n ON n.id = a.up WHERE n.parent IN (SELECT id FROM nodes)),
ends AS (SELECT id, parent FROM nodes WHERE parent IS NULL OR parent NOT IN (SELECT id FROM nodes)),
ended AS (SELECT a.id, e.id AS root, e.parent AS beyond FROM above a JOIN ends e ON e.id = a.up),
steps AS (SELECT id, count(*) AS depth, bool_or(up = id) AS circular FROM above GROUP BY id)
SELECT n.id, coalesce(e.root, t.id) AS root,
  CASE WHEN t.id IS NOT NULL THEN 0 WHEN e.id IS NOT NULL THEN s.depth END AS depth,
  CASE WHEN t.id IS NOT NULL THEN CASE WHEN n.parent IS NULL THEN 'root' ELSE 'orphan' END
    WHEN e.id IS NOT NULL THEN CASE WHEN e.beyond IS NULL THEN 'linked' ELSE 'under_orphan' END
    WHEN s.circular THEN 'cycle' ELSE 'into_cycle' END AS status
FROM nodes n LEFT JOIN ends t ON t.id = n.id LEFT JOIN ended e ON e.id = n.id LEFT JOIN steps s ON s.id = n.id
""")
def parent_hierarchy(spark, d):
    """Every order with the order its chain of earlier orders starts from, broken and circular chains told apart."""
    nodes = spark.sql(PREVIOUS_ORDER, orders=load(spark, d, "orders").select("o_orderkey", "o_custkey"))
    return Q.hierarchy(nodes, "id", "parent")
