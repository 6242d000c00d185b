"""Queries for run-log scoring."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.operators import runlog as L
from tablescout.plans.derived import duckdb_cte, view
from tablescout.plans.registry import query
from tablescout.session import shared_dir
from tablescout.sources.sinks import save_run

EXECUTED = "len(list_filter(steps, lambda s: starts_with(s, 'execute_query') AND NOT contains(s, 'no_sql'))) > 0"

CHECKS = {
    "correct_classification": "coalesce(got_type, 'none') = expected_type",
    "correct_tool_call": """len(list_filter(expected_tools, lambda t: NOT (CASE t
        WHEN 'metadata_search' THEN list_contains(tools_used, 'search_metadata')
        WHEN 'schema_tool' THEN list_contains(tools_used, 'get_table_schema')
        WHEN 'sql_tool' THEN list_contains(tools_used, 'generate_sql') OR list_contains(tools_used, 'execute_query')
        ELSE list_contains(tools_used, t) END))) = 0""",
    "answer_contains_expected_terms": """len(list_filter(expected_terms, lambda t:
        NOT contains(lower(concat(coalesce(answer, ''), ' ', coalesce(sql, ''))), lower(t)))) = 0""",
    "sql_executed": EXECUTED,
    "sql_not_executed": f"NOT ({EXECUTED})",
    "sql_readonly": r"""CASE WHEN sql IS NULL THEN true ELSE
        NOT regexp_matches(sql, '(?i)\b(INSERT|UPDATE|DELETE|DROP|TRUNCATE|ALTER|CREATE)\b') AND coalesce(is_safe, false) END""",
    "no_unhandled_error": "len(list_filter(steps, lambda s: ends_with(s, ':error'))) = 0 AND error IS NULL",
}

VERDICT = "CASE name " + " ".join(f"WHEN '{n}' THEN ({sql})" for n, sql in CHECKS.items()) + " ELSE false END"

# run_criteria: one row per run and listed criterion; scored: the run log with its verdict
SCORED = duckdb_cte("run_log") + f""", listed AS (SELECT *, unnest(criteria) AS name FROM run_log),
all_criteria AS (SELECT case_id, name, error, {VERDICT} AS passed FROM listed),
run_criteria AS (SELECT case_id, name, passed FROM all_criteria WHERE error IS NULL),
verdicts AS (SELECT case_id, bool_and(passed) AS passed FROM all_criteria GROUP BY case_id),
scored AS (SELECT r.*, coalesce(v.passed, true) AS passed FROM run_log r LEFT JOIN verdicts v USING (case_id))
"""


def _flag_query(name, check):
    @query(name, duckdb_cte("run_log") + f"SELECT case_id, {CHECKS[check]} AS passed FROM run_log")
    def flag(spark, d):
        return view(spark, d, "run_log").select("case_id", L.CRITERIA[check]().alias("passed"))


_flag_query("score_classification", "correct_classification")
_flag_query("score_tools", "correct_tool_call")
_flag_query("score_terms", "answer_contains_expected_terms")
_flag_query("score_sql_executed", "sql_executed")
_flag_query("score_sql_not_executed", "sql_not_executed")
_flag_query("score_sql_readonly", "sql_readonly")
_flag_query("score_no_error", "no_unhandled_error")


def scored(spark, d):
    return L.score_case(view(spark, d, "run_log"))


@query("score_case", SCORED + """
SELECT s.case_id, s.passed, coalesce(f.failed, '') AS failed_criteria FROM scored s LEFT JOIN (
  SELECT case_id, string_agg(name, ',' ORDER BY name) AS failed FROM all_criteria WHERE NOT passed GROUP BY case_id) f
USING (case_id)
""")
def score_case(spark, d):
    failed = F.transform(F.filter("results", lambda r: ~r["passed"]), lambda r: r["name"])
    return scored(spark, d).select(
        "case_id", "passed", F.array_join(F.array_sort(failed), ",").alias("failed_criteria")
    )


def _shown(items: str) -> str:
    return f"concat('[', array_to_string(list_transform({items}, lambda s: concat(chr(39), s, chr(39))), ', '), ']')"


MISSING_TOOLS = CHECKS["correct_tool_call"].removeprefix("len(").removesuffix(") = 0")
MISSING_TERMS = CHECKS["answer_contains_expected_terms"].removeprefix("len(").removesuffix(") = 0")
ERROR_STEPS = "list_filter(steps, lambda s: ends_with(s, ':error'))"
WRITES = r"list_transform(regexp_extract_all(sql, '(?i)\b(INSERT|UPDATE|DELETE|DROP|TRUNCATE|ALTER|CREATE)\b', 1), lambda w: upper(w))"
DETAILS = {
    "correct_classification": f"""CASE WHEN {CHECKS["correct_classification"]} THEN coalesce(got_type, 'none')
        ELSE concat('got=', coalesce(got_type, 'none'), ', expected=', expected_type) END""",
    "correct_tool_call": f"""CASE WHEN len(expected_tools) = 0 THEN 'no tools expected' ELSE concat(CASE WHEN len({MISSING_TOOLS}) > 0
        THEN concat('missing=', {_shown(MISSING_TOOLS)}, ', ') ELSE '' END, 'tools_used=', {_shown("tools_used")}) END""",
    "answer_contains_expected_terms": f"""CASE WHEN len(expected_terms) = 0 THEN 'no terms expected' WHEN len({MISSING_TERMS}) > 0
        THEN concat('missing_terms=', {_shown(MISSING_TERMS)}) ELSE concat('found=', {_shown("expected_terms")}) END""",
    "sql_executed": f"concat('steps=', {_shown('steps')})",
    "sql_not_executed": f"concat('steps=', {_shown('steps')})",
    "sql_readonly": f"""CASE WHEN sql IS NULL THEN 'no SQL generated' WHEN {CHECKS["sql_readonly"]} THEN 'ok'
        ELSE concat('forbidden_keywords=', {_shown(WRITES)}) END""",
    "no_unhandled_error": f"""CASE WHEN {CHECKS["no_unhandled_error"]} THEN 'no errors' WHEN len({ERROR_STEPS}) > 0
        THEN concat('error_steps=', {_shown(ERROR_STEPS)}) ELSE concat('state.error=', chr(39), error, chr(39)) END""",
}
DETAIL = "CASE name " + " ".join(f"WHEN '{n}' THEN ({sql})" for n, sql in DETAILS.items()) + " ELSE concat('unknown criterion: ', name) END"


@query("criterion_details", SCORED + f"SELECT case_id, name, {VERDICT} AS passed, {DETAIL} AS detail FROM listed")
def criterion_details(spark, d):
    return L.criterion_details(scored(spark, d))


RUN_TOTALS = """SELECT count(*) AS total, count_if(passed AND error IS NULL) AS passed,
       count_if(NOT passed AND error IS NULL) AS failed, count_if(error IS NOT NULL) AS errors,
       round(count_if(passed AND error IS NULL) / count(*), 4) AS pass_rate FROM scored"""


@query("run_totals", SCORED + RUN_TOTALS)
def run_totals(spark, d):
    return L.run_totals(scored(spark, d))


LATENCY_RANKS = """, ranked AS (
SELECT latency_s AS v, row_number() OVER (ORDER BY latency_s) AS rn, count(*) OVER () AS n FROM run_log WHERE latency_s > 0),
ranks AS (SELECT *, greatest(1, least((9 * (n + 1)) // 10, n - 1)) AS j FROM ranked),
q AS (SELECT any_value(9 * (n + 1) - 10 * j) AS d, max(CASE WHEN rn = j THEN v END) AS lo,
             max(CASE WHEN rn = j + 1 THEN v END) AS hi FROM ranks)
"""
LATENCY = """SELECT (SELECT round(avg(v), 2) FROM ranked) AS avg_latency_s, round((lo * (10 - d) + hi * d) / 10, 2) AS p90_latency_s,
       (SELECT round(sum(v), 2) FROM ranked) AS total_time_s FROM q"""


@query("run_latency", duckdb_cte("run_log") + LATENCY_RANKS + LATENCY)
def run_latency(spark, d):
    return L.run_latency(view(spark, d, "run_log"))


BY_CRITERION = """SELECT name, round(avg(CASE WHEN passed THEN 1 ELSE 0 END), 4) AS pass_rate, count_if(passed) AS passed, count(*) AS total
FROM run_criteria GROUP BY name"""


@query("by_criterion", SCORED + BY_CRITERION)
def by_criterion(spark, d):
    return L.by_criterion(L.run_criteria(scored(spark, d)))


HEADLINE_RATES = """SELECT round(coalesce(avg(CASE WHEN name = 'correct_classification' THEN passed::INT END), 0), 4) AS classification_accuracy,
       round(coalesce(avg(CASE WHEN name = 'correct_tool_call' THEN passed::INT END), 0), 4) AS tool_call_accuracy,
       round(coalesce(avg(CASE WHEN name = 'sql_readonly' THEN passed::INT END), 1), 4) AS sql_safety_rate FROM run_criteria"""


@query("headline_rates", SCORED + HEADLINE_RATES)
def headline_rates(spark, d):
    return L.headline_rates(L.run_criteria(scored(spark, d)))


BY_CATEGORY = """SELECT category, count(*) AS total, count_if(passed AND error IS NULL) AS passed,
       round(count_if(passed AND error IS NULL) / count(*), 4) AS pass_rate,
       round(coalesce(avg(CASE WHEN latency_s > 0 THEN latency_s END), 0), 2) AS avg_latency FROM scored GROUP BY category"""


@query("by_category", SCORED + BY_CATEGORY)
def by_category(spark, d):
    return L.by_category(scored(spark, d))


@query("derive_error", duckdb_cte("run_log") + """
SELECT case_id, CASE WHEN sql_status = 'error' THEN coalesce(sql_message, 'SQL generation error')
  WHEN exec_status = 'error' THEN coalesce(exec_message, 'query execution error') ELSE schema_message END AS derived_error
FROM run_log
""")
def derive_error(spark, d):
    return L.derive_error(view(spark, d, "run_log")).select("case_id", "derived_error")


@query("route_audit", duckdb_cte("run_log") + """, nodes AS (
SELECT case_id, category, sql_status, is_safe, exec_status, retry_count,
       unnest(steps) AS step, generate_subscripts(steps, 1) AS pos FROM run_log),
seq AS (SELECT *, split_part(step, ':', 1) AS node,
               lead(split_part(step, ':', 1)) OVER (PARTITION BY case_id ORDER BY pos) AS following,
               count(*) FILTER (split_part(step, ':', 1) = 'fix_sql') OVER (PARTITION BY case_id ORDER BY pos) AS rewrites,
               max(pos) FILTER (split_part(step, ':', 1) = 'execute_query') OVER (PARTITION BY case_id) AS last_run FROM nodes),
taken AS (SELECT case_id, any_value(category) AS category, any_value(sql_status) AS sql_status, any_value(is_safe) AS is_safe,
       any_value(exec_status) AS exec_status, any_value(retry_count) AS retry_count,
       arg_min(following, pos) FILTER (node = 'classify_intent') AS first_taken,
       arg_min(following, pos) FILTER (node = 'generate_sql') AS after_sql_taken,
       arg_max(following, pos) FILTER (node = 'execute_query') AS after_exec_taken,
       coalesce(bool_and(following = CASE WHEN split_part(step, ':', 2) = 'error' AND rewrites < 2 THEN 'fix_sql' ELSE 'format_response' END)
         FILTER (node = 'execute_query' AND pos < last_run), true) AS retries_ok,
       bool_or(node = 'execute_query') AS executed FROM seq GROUP BY case_id),
exp AS (SELECT *, CASE category WHEN 'navigation' THEN 'search_metadata' WHEN 'schema' THEN 'get_schema'
         WHEN 'script' THEN 'generate_sql' WHEN 'data' THEN 'generate_sql' WHEN 'unsafe' THEN 'unsafe_query'
         ELSE 'handle_unknown' END AS first_expected,
       CASE WHEN category = 'data' AND sql_status = 'success' AND is_safe THEN 'execute_query' ELSE 'format_response' END AS after_sql_expected,
       CASE WHEN exec_status = 'error' AND retry_count < 2 THEN 'fix_sql' ELSE 'format_response' END AS after_exec_expected FROM taken)
SELECT case_id, first_expected, first_taken, after_sql_expected, after_sql_taken, after_exec_expected, after_exec_taken,
       coalesce(first_taken = first_expected, true) AND coalesce(after_sql_taken = after_sql_expected, true)
         AND coalesce(after_exec_taken = after_exec_expected, true) AND retries_ok AS route_ok, retries_ok,
       executed AND NOT coalesce(is_safe, true) AS unchecked_rewrite
FROM exp
""")
def route_audit(spark, d):
    return L.route_audit(view(spark, d, "run_log")).select(
        "case_id", "first_expected", "first_taken", "after_sql_expected", "after_sql_taken",
        "after_exec_expected", "after_exec_taken", "route_ok", "retries_ok", "unchecked_rewrite",
    )


def _pairs(section: str, prefix: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{section}', {prefix} || '{c}', CAST({c} AS DOUBLE) FROM {section}" for c in columns)


STORED_METRICS = """STRUCT<total BIGINT, passed BIGINT, failed BIGINT, errors BIGINT, overall_pass_rate DOUBLE, classification_accuracy DOUBLE,
tool_call_accuracy DOUBLE, sql_safety_rate DOUBLE, avg_latency_s DOUBLE, p90_latency_s DOUBLE, total_time_s DOUBLE,
by_category MAP<STRING, STRUCT<total BIGINT, passed BIGINT, pass_rate DOUBLE, avg_latency DOUBLE>>,
by_criterion MAP<STRING, STRUCT<pass_rate DOUBLE, passed BIGINT, total BIGINT>>>"""
SINGLE = {
    "totals": ["total", "passed", "failed", "errors", "pass_rate"],
    "rates": ["classification_accuracy", "tool_call_accuracy", "sql_safety_rate"],
    "latency": ["avg_latency_s", "p90_latency_s", "total_time_s"],
}


@query("sink_run_file", SCORED + LATENCY_RANKS + f""", totals AS ({RUN_TOTALS}), rates AS ({HEADLINE_RATES}), latency AS ({LATENCY}),
by_category AS ({BY_CATEGORY}), by_criterion AS ({BY_CRITERION}),
pairs(section, name, value) AS ({" UNION ALL ".join(_pairs(t, "''", c) for t, c in SINGLE.items())}
  UNION ALL {_pairs("by_category", "category || '.'", ["total", "passed", "pass_rate", "avg_latency"])}
  UNION ALL {_pairs("by_criterion", "name || '.'", ["total", "passed", "pass_rate"])}
  UNION ALL SELECT 'cases', name || '.' || passed, count(*) FROM all_criteria GROUP BY name, passed)
SELECT section, CASE WHEN name = 'pass_rate' THEN 'overall_pass_rate' ELSE name END AS name, value FROM pairs
""")
def sink_run_file(spark, d):
    """A run written with its metadata, metrics and case results with details, and read back as (section, name, value)."""
    cases = L.with_details(scored(spark, d)).select("case_id", "category", "passed", "latency_s", "error", "results")
    folder = save_run(cases, L.run_metrics, f"{shared_dir(spark)}/run-file-{uuid.uuid4().hex}", source="run_log")
    stored = spark.read.schema("metrics " + STORED_METRICS).json(f"{folder}/summary").select("metrics.*")

    def rows(section, pairs):
        pair = F.array(*[F.struct(n.alias("name"), v.cast("double").alias("value")) for n, v in pairs])
        return lambda df: df.select(F.lit(section).alias("section"), F.inline(pair))

    parts = []
    for section, columns in SINGLE.items():
        columns = [c.replace("pass_rate", "overall_pass_rate") for c in columns]
        parts.append(rows(section, [(F.lit(c), F.col(c)) for c in columns])(stored))
    for section, columns in (("by_category", ["total", "passed", "pass_rate", "avg_latency"]), ("by_criterion", ["total", "passed", "pass_rate"])):
        each = stored.select(F.explode(section))
        parts.append(rows(section, [(F.concat("key", F.lit("." + c)), F.col(f"value.{c}")) for c in columns])(each))
    kept = spark.read.schema("case_id BIGINT, results ARRAY<STRUCT<name STRING, passed BOOLEAN, detail STRING>>").json(f"{folder}/case_results")
    parts.append(kept.select(F.inline("results")).groupBy(F.concat_ws(".", "name", F.col("passed").cast("string")).alias("name")).agg(
        F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("cases").alias("section"), "name", "value"))
    return reduce(DataFrame.unionByName, parts)
