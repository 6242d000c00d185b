"""Queries for catalog and relationship profiling."""

from __future__ import annotations

from itertools import combinations, permutations

from tablescout.operators import keys as Y
from tablescout.operators import profile as P
from tablescout.plans import knowledge_data as K
from tablescout.plans.registry import query
from tablescout.session import small_frame
from tablescout.sources import catalog as C
from tablescout.sources.tables import load

ALL_TABLES = list(K.TABLE_COLUMNS)


def all_tables(spark, d):
    return {t: load(spark, d, t) for t in ALL_TABLES}


def observed(spark, d, wanted=("nulls", "chars")):
    tables = all_tables(spark, d)
    cat = C.catalog(spark, tables, K.SERVER, K.DATABASE, K.COLUMN_NOTES)
    return C.observed_catalog(cat, C.column_facts(tables, wanted))


@query("catalog_tables", "WITH " + K.catalog_sql() + ", " + K.descriptions_sql() + """
SELECT table_name, table_description, count(*) AS column_count, count_if(is_nullable) AS nullable_columns
FROM catalog LEFT JOIN descriptions USING (table_name) GROUP BY table_name, table_description
""")
def catalog_tables(spark, d):
    return P.catalog_tables(observed(spark, d, ("nulls",)), K.descriptions(spark)).select(
        "table_name", "table_description", "column_count", "nullable_columns"
    )


@query("catalog_columns", "WITH " + K.catalog_sql() + """
SELECT table_name, column_id, column_name, data_type, is_nullable, description FROM catalog
""")
def catalog_columns(spark, d):
    return P.catalog_columns(observed(spark, d, ("nulls",)))


TYPE_TEXT = "CASE WHEN char_max_length IS NOT NULL THEN concat(data_type, '(', char_max_length, ')') ELSE data_type END"


@query("column_details", "WITH " + K.catalog_sql() + f"""
SELECT table_name, column_id, column_name, {TYPE_TEXT} AS type_text, char_max_length, is_nullable, description FROM catalog
""")
def column_details(spark, d):
    return P.column_details(observed(spark, d)).select(
        "table_name", "column_id", "column_name", "type_text", "char_max_length", "is_nullable", "description"
    )


@query("table_row_counts", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, nullif(count(*), 0) AS row_count, count(*) AS exact_rows FROM {t}" for t in ALL_TABLES
))
def table_row_counts(spark, d):
    return P.table_row_counts(all_tables(spark, d))


KEY_KINDS = ("int", "bigint", "varchar", "timestamp")


def _single_keys_sql():
    return " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS key_columns, 1 AS width, count(*) AS n_rows FROM {t} "
        f"HAVING count(DISTINCT {c}) = count(*) AND count({c}) = count(*) AND count(*) > 0"
        for t in ALL_TABLES for c, kind in K.columns_of(t) if kind in KEY_KINDS
    )


def _pair_keys_sql():
    parts = []
    for t in ALL_TABLES:
        able = [c for c, kind in K.columns_of(t) if kind in KEY_KINDS]
        for i, a in enumerate(able):
            for b in able[i + 1:]:
                parts.append(
                    f"SELECT '{t}', '{a},{b}', 2, count(*) FROM {t} HAVING count(DISTINCT ({a}, {b})) = count(*) "
                    f"AND count(DISTINCT {a}) < count(*) AND count(DISTINCT {b}) < count(*) "
                    f"AND count({a}) = count(*) AND count({b}) = count(*)"
                )
    return " UNION ALL ".join(parts)


@query("candidate_keys", _single_keys_sql() + " UNION ALL " + _pair_keys_sql())
def candidate_keys(spark, d):
    return P.candidate_keys(spark, all_tables(spark, d))


WIDEST = 3


def _wide_keys_sql(tables=ALL_TABLES):
    """Groups of up to ``WIDEST`` columns that are unique and hold no smaller unique group."""
    parts = []
    for t in tables:
        able = [c for c, kind in K.columns_of(t) if kind in KEY_KINDS]
        for width in range(1, WIDEST + 1):
            for group in combinations(able, width):
                present = " AND ".join(f"count({c}) = count(*)" for c in group)
                parts.append(f"SELECT '{t}' AS table_name, {list(group)} AS cols, count(*) AS n_rows FROM {t} "
                             f"HAVING count(DISTINCT ({', '.join(group)},)) = count(*) AND count(*) > 0 AND {present}")
    return f"""unique_groups AS MATERIALIZED ({" UNION ALL ".join(parts)}),
wide_keys AS (SELECT table_name, array_to_string(cols, ',') AS key_columns, CAST(len(cols) AS INT) AS width, n_rows FROM unique_groups u
  WHERE NOT EXISTS (SELECT 1 FROM unique_groups s WHERE s.table_name = u.table_name AND len(s.cols) < len(u.cols) AND list_has_all(u.cols, s.cols)))"""


@query("candidate_keys_wide", "WITH " + _wide_keys_sql() + " SELECT * FROM wide_keys")
def candidate_keys_wide(spark, d):
    """Keys of up to three columns."""
    return P.candidate_keys(spark, all_tables(spark, d), max_width=WIDEST)


ANSWERS = "SELECT conv_id AS a_conv, turn AS a_turn, length(text) AS a_length FROM conversations WHERE role = 'assistant'"


def _answer_references_sql(first, second):
    return f"""SELECT 'answers' AS dep_table, '{first},{second}' AS dep_columns, 'conversations' AS ref_table, 'conv_id,turn' AS ref_columns,
  count(DISTINCT ({first}, {second})) AS n_values,
  round(count(DISTINCT ({first}, {second})) / (SELECT count(DISTINCT (conv_id, turn)) FROM conversations), 6) AS coverage
FROM (SELECT * FROM answers WHERE {first} IS NOT NULL AND {second} IS NOT NULL)
WHERE EXISTS (SELECT 1 FROM wide_keys WHERE key_columns = 'conv_id,turn')
HAVING count(*) > 0 AND count(*) = count(*) FILTER (WHERE EXISTS (SELECT 1 FROM conversations WHERE conv_id = {first} AND turn = {second}))"""


@query("composite_references", f"""WITH {_wide_keys_sql(["conversations"])}, answers AS ({ANSWERS})
{" UNION ALL ".join(_answer_references_sql(*pair) for pair in permutations(["a_conv", "a_turn", "a_length"], 2))}
""")
def composite_references(spark, d):
    """Answers, derived from the conversations, refer to these by conversation and turn."""
    conversations = load(spark, d, "conversations")
    answers = conversations.where("role = 'assistant'").selectExpr("conv_id AS a_conv", "turn AS a_turn", "length(text) AS a_length")
    given = {"conversations": conversations, "answers": answers}
    facts = P.known_facts(given, ("nulls", "bounds"))
    keys = P.candidate_keys(spark, {"conversations": conversations}, facts={k: f for k, f in facts.items() if k[0] == "conversations"})
    keys = keys.where("key_columns = 'conv_id,turn'")
    included = P.inclusion_dependencies(spark, given, facts, Y.key_parts(keys))
    return Y.composite_references(spark, given, keys, included, facts)


FAMILIES = {"int": "number", "bigint": "number", "varchar": "text", "timestamp": "time"}


def _inclusions_sql():
    able = [(t, c, FAMILIES[kind]) for t in ALL_TABLES for c, kind in K.columns_of(t) if kind in FAMILIES]
    vals = " UNION ALL ".join(
        f"SELECT DISTINCT '{t}' AS t, '{c}' AS c, '{kind}' AS k, CAST({c} AS VARCHAR) AS v FROM {t} WHERE {c} IS NOT NULL" for t, c, kind in able
    )
    tail = "regexp_replace({}, '^[^_]*_', '')"
    return f"""vals AS MATERIALIZED ({vals}), sizes AS MATERIALIZED (SELECT t, c, count(*) AS n FROM vals GROUP BY t, c),
single_keys AS MATERIALIZED ({_single_keys_sql()}),
keyed AS MATERIALIZED (SELECT v.* FROM vals v JOIN single_keys k ON k.table_name = v.t AND k.key_columns = v.c),
inclusions AS MATERIALIZED (
SELECT a.t AS dep_table, a.c AS dep_column, b.t AS ref_table, b.c AS ref_column,
       a.c = b.c OR ends_with(a.c, '_' || b.c) OR ends_with(b.c, '_' || a.c)
         OR (contains(a.c, '_') AND contains(b.c, '_') AND {tail.format("a.c")} = {tail.format("b.c")}) AS same_suffix,
       contains(lower(a.c), lower(b.t)) AS named,
       any_value(sa.n) AS n_values, round(any_value(sa.n) / any_value(sb.n), 6) AS coverage
FROM vals a JOIN keyed b ON a.k = b.k AND a.v = b.v AND (a.t <> b.t OR a.c <> b.c)
JOIN sizes sa ON sa.t = a.t AND sa.c = a.c JOIN sizes sb ON sb.t = b.t AND sb.c = b.c
GROUP BY a.t, a.c, b.t, b.c HAVING count(*) = any_value(sa.n))"""


@query("inclusion_dependencies", "WITH " + _inclusions_sql() + " SELECT * FROM inclusions")
def inclusion_dependencies(spark, d):
    return P.inclusion_dependencies(spark, all_tables(spark, d))


@query("orphan_check", " UNION ALL ".join(f"""
SELECT '{c}.{fk}' AS child, '{p}.{pk}' AS parent, count({fk}) AS n_refs,
       count_if({fk} IS NOT NULL AND {fk} NOT IN (SELECT {pk} FROM {p})) AS n_orphan_rows,
       count(DISTINCT CASE WHEN {fk} NOT IN (SELECT {pk} FROM {p}) THEN {fk} END) AS n_orphan_keys FROM {c}
""" for c, fk, p, pk in K.RELATIONSHIPS))
def orphan_check(spark, d):
    return P.orphan_check(all_tables(spark, d), K.RELATIONSHIPS)


REQUESTED = ["orders", "lineitem", "labels", "payments"]


@query("table_schema_report", "WITH " + K.catalog_sql() + ", " + _inclusions_sql() + f""",
requested AS {K.sql_values([(t,) for t in REQUESTED], "table_name")},
counts AS ({" UNION ALL ".join(f"SELECT '{t}' AS table_name, nullif(count(*), 0) AS row_count FROM {t}" for t in ALL_TABLES)}),
first_keys AS (SELECT c.table_name, arg_min(c.column_name, c.column_id) AS pk FROM catalog c
  JOIN single_keys k ON k.table_name = c.table_name AND k.key_columns = c.column_name GROUP BY c.table_name),
ranked AS (SELECT *, row_number() OVER (PARTITION BY dep_table, dep_column ORDER BY same_suffix DESC, named DESC, coverage DESC, ref_table, ref_column) AS nth
  FROM inclusions WHERE (same_suffix OR named) AND dep_table <> ref_table),
fks AS (SELECT dep_table AS table_name, dep_column AS column_name, ref_table || '.' || ref_column AS refers_to FROM ranked WHERE nth = 1)
SELECT r.table_name, CASE WHEN c.column_name IS NULL THEN 'empty' ELSE 'success' END AS status,
       CASE WHEN c.column_name IS NULL THEN concat('table ''', r.table_name, ''' not found') END AS message,
       coalesce(c.column_id, 0) AS column_id, c.column_name, {TYPE_TEXT} AS type_text, coalesce(c.is_nullable, false) AS is_nullable,
       coalesce(f.pk = c.column_name, false) AS is_pk, g.refers_to IS NOT NULL AS is_fk, g.refers_to,
       c.description, coalesce(n.row_count, 0) AS row_count
FROM requested r LEFT JOIN catalog c USING (table_name) LEFT JOIN counts n ON n.table_name = r.table_name
LEFT JOIN first_keys f ON f.table_name = r.table_name LEFT JOIN fks g ON g.table_name = c.table_name AND g.column_name = c.column_name
""")
def table_schema_report(spark, d):
    tables = all_tables(spark, d)
    facts = P.known_facts(tables)
    keys = P.candidate_keys(spark, tables, max_width=1, facts=facts)
    key_columns = {(r["table_name"], r["key_columns"]) for r in keys.collect()}
    references = P.references(P.inclusion_dependencies(spark, tables, facts=facts, key_columns=key_columns))
    asked = {t: df for t, df in tables.items() if t in REQUESTED}
    cat = C.catalog(spark, asked, K.SERVER, K.DATABASE, K.COLUMN_NOTES)
    return P.table_schema_report(
        C.observed_catalog(cat, P.facts_frame(spark, facts)), P.table_row_counts(asked), keys, references,
        small_frame(spark, [(t,) for t in REQUESTED], "table_name STRING"),
    ).drop("default_value").na.fill(0).na.fill(False)


@query("schema_docs_join", """
SELECT c_custkey, c_name, c_nationkey, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey
""")
def schema_docs_join(spark, d):
    """Customers stand for the column notes, nations for the table notes they belong to."""
    parents = load(spark, d, "nation").select("n_nationkey", "n_name")
    children = load(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    return P.schema_docs_join(parents, children, "n_nationkey", "c_nationkey")
