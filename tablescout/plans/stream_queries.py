"""Queries over run events, as streams and as their batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescout.functions.text import truncate
from tablescout.plans.derived import duckdb_cte, over, view
from tablescout.plans.index_queries import fresh_path
from tablescout.plans.registry import query
from tablescout.sources.tables import load
from tablescout.streaming import events as E


def event_stream(spark, d, name="run_events"):
    schema = load(spark, d, "events").schema
    return over(spark, name, E.read_events(spark, schema, f"{d}/events.parquet"))


def worked_off(spark, stream, name):
    """What an append-mode stream of another session emits, as a batch of this one."""
    path = fresh_path(spark, name)
    E.run_to_end(stream, path, fresh_path(spark, f"{name}-state"))
    return spark.read.schema(stream.schema).parquet(path)


def stamp(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def case_sql(pairs):
    return "CASE node " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + " END"


TERMINAL_SQL = "node IN (" + ", ".join(f"'{n}'" for n in E.TERMINAL_NODES) + ")"
STATUS_SQL = """CASE node WHEN 'search_metadata' THEN CASE WHEN n_found > 0 THEN 'ok' ELSE 'warn' END
  WHEN 'get_schema' THEN CASE WHEN status = 'success' THEN 'ok' ELSE 'warn' END
  WHEN 'generate_sql' THEN CASE WHEN status = 'success' THEN 'ok' ELSE 'error' END
  WHEN 'fix_sql' THEN 'warn'
  WHEN 'execute_query' THEN CASE status WHEN 'empty' THEN 'warn' WHEN 'error' THEN 'error' ELSE 'ok' END
  ELSE 'ok' END"""


@query("event_project", duckdb_cte("run_events") + f"""
SELECT event_id, 'step' AS type, node, {case_sql(E.NODE_LABELS)} AS label, {case_sql(E.NODE_KIND)} AS kind,
       {case_sql(E.TOOL_NODES)} AS tool, {STATUS_SQL} AS status,
       CASE WHEN node = 'search_metadata' THEN concat('found=', n_found)
            WHEN node = 'execute_query' THEN concat('status=', status, ';row_count=', n_found, ';error=', coalesce(message, 'NULL'))
            WHEN node IN ('get_schema', 'generate_sql', 'fix_sql') THEN concat('status=', status) ELSE '' END AS detail
FROM run_events WHERE NOT ({TERMINAL_SQL})
""")
def event_project(spark, d):
    """The events table read as a stream, projected and appended to parquet."""
    steps = E.event_project(event_stream(spark, d))
    out = E.run_to_end(steps, fresh_path(spark, "steps"), fresh_path(spark, "steps-state"))
    pairs = F.transform(F.map_entries("detail"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("NULL"))))
    return out.select("event_id", "type", "node", "label", "kind", "tool", "status", F.array_join(pairs, ";").alias("detail"))


def _shown_sql(text, limit):
    trimmed = f"regexp_replace({text}, '^{WS}|{WS}$', '', 'g')"
    return f"CASE WHEN length({trimmed}) <= {limit} THEN {trimmed} ELSE concat(regexp_replace(substring({trimmed}, 1, {limit}), '{WS}$', ''), ' …') END"


WS = r"[\s\x0B\x1c-\x1f\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _details_sql(*pairs):
    return "concat(" + ", ';', ".join(f"'{k}=', coalesce(CAST({v} AS VARCHAR), 'NULL')" for k, v in pairs) + ")"


STATUS = ("status", "status")


@query("event_details", duckdb_cte("event_details") + f"""
SELECT event_id, node, CASE node
  WHEN 'classify_intent' THEN {_details_sql(("query_type", "query_type"), ("confidence", "confidence"), ("reasoning", _shown_sql("reasoning", 240)))}
  WHEN 'search_metadata' THEN {_details_sql(("found", "n_found"), ("tables", "array_to_string(tables[1:5], ', ')"))}
  WHEN 'get_schema' THEN {_details_sql(("table", '"table"'), ("columns", "n_columns"), STATUS)}
  WHEN 'generate_sql' THEN {_details_sql(("sql", _shown_sql("sql", 600)), ("is_safe", "is_safe"), STATUS)}
  WHEN 'fix_sql' THEN {_details_sql(("attempt", "attempt"), ("sql", _shown_sql("sql", 600)), STATUS)}
  WHEN 'execute_query' THEN {_details_sql(STATUS, ("row_count", "n_found"), ("truncated", "truncated"), ("error", "message"))}
  ELSE '' END AS detail FROM event_details WHERE NOT ({TERMINAL_SQL})
""")
def event_details(spark, d):
    """Steps of events that carry everything a step shows, read as a stream."""
    steps = E.event_project(event_stream(spark, d, "event_details"))
    out = E.run_to_end(steps, fresh_path(spark, "details"), fresh_path(spark, "details-state"))
    pairs = F.transform(F.map_entries("detail"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("NULL"))))
    return out.select("event_id", "node", F.array_join(pairs, ";").alias("detail"))


@query("event_truncate", f"""
WITH trimmed AS (SELECT doc_id, regexp_replace(text, '^{WS}|{WS}$', '', 'g') AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) <= 600 THEN t ELSE concat(regexp_replace(substring(t, 1, 600), '{WS}$', ''), ' …') END AS short FROM trimmed
""")
def event_truncate(spark, d):
    return load(spark, d, "documents").select("doc_id", truncate(F.col("text"), 600).alias("short"))


GAP_MINUTES = 360

RUNS_SQL = duckdb_cte("run_events") + f""", gaps AS (
SELECT *, {STATUS_SQL} AS step_status, {TERMINAL_SQL} AS terminal,
       CASE WHEN ts - lag(ts) OVER w < INTERVAL {GAP_MINUTES} MINUTE THEN 0 ELSE 1 END AS opens FROM run_events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM gaps),
runs AS (SELECT user_id, run, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS run_start, max(ts) AS last_ts,
       count_if(NOT terminal) AS n_steps,
       count_if(NOT terminal AND node IN ('search_metadata', 'get_schema', 'execute_query')) AS tool_calls,
       (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 AS elapsed_ms, bool_or(terminal) AS final_reached,
       bool_or(NOT terminal AND step_status = 'error') AS had_error FROM numbered GROUP BY user_id, run)
"""

RUN_COLUMNS = ["user_id", "run_start", "n_steps", "tool_calls", "elapsed_ms", "final_reached", "had_error"]


@query("run_summary_stream", RUNS_SQL + f"""
SELECT {", ".join(RUN_COLUMNS)} FROM runs
WHERE last_ts + INTERVAL {GAP_MINUTES} MINUTE <= (SELECT max(ts) FROM run_events) - INTERVAL 1 DAY
""")
def run_summary_stream(spark, d):
    """Runs the watermark has closed by the end of the stream."""
    runs = E.run_summary_stream(event_stream(E.stream_session(spark), d), GAP_MINUTES)
    out = worked_off(spark, runs, "runs")
    return out.withColumn("run_start", stamp("run_start")).select(*RUN_COLUMNS)


@query("run_final_stream", RUNS_SQL + f""", told AS (
SELECT user_id, run, string_agg(node, '>' ORDER BY ts, event_id) AS steps, max_by(node, (ts, event_id)) FILTER (terminal) AS final_node,
       max_by(message, (ts, event_id)) FILTER (message IS NOT NULL) AS message FROM numbered GROUP BY user_id, run)
SELECT user_id, run_start, CASE WHEN final_reached THEN 'final' ELSE 'error' END AS type, final_node,
       CASE WHEN NOT final_reached THEN coalesce(message, '{E.NO_ANSWER}') END AS message, steps, elapsed_ms, tool_calls
FROM runs JOIN told USING (user_id, run) WHERE last_ts + INTERVAL {GAP_MINUTES} MINUTE <= (SELECT max(ts) FROM run_events) - INTERVAL 1 DAY
""")
def run_final_stream(spark, d):
    """The closing event of every run the watermark has passed, by timers of keyed state."""
    runs = E.run_final_stream(event_stream(E.stream_session(spark), d), GAP_MINUTES)
    out = worked_off(spark, runs, "finals")
    return out.withColumns({"run_start": stamp("run_start"), "steps": F.array_join("steps", ">")})


@query("run_summary", RUNS_SQL + f"SELECT {', '.join(RUN_COLUMNS)} FROM runs")
def run_summary(spark, d):
    return E.run_summary(view(spark, d, "run_events"), GAP_MINUTES).withColumn("run_start", stamp("run_start")).select(*RUN_COLUMNS)


@query("run_steps", RUNS_SQL + f"""
SELECT n.user_id, r.run_start, row_number() OVER (PARTITION BY n.user_id, n.run ORDER BY n.ts, n.event_id) AS position,
       event_id, node, {case_sql(E.NODE_KIND)} AS kind, step_status AS status
FROM numbered n JOIN runs r ON r.user_id = n.user_id AND r.run = n.run
""")
def run_steps(spark, d):
    return E.run_steps(view(spark, d, "run_events"), GAP_MINUTES).withColumn("run_start", stamp("run_start")).drop("ts")


@query("run_completion", RUNS_SQL + """
SELECT user_id, run_start, CASE WHEN final_reached AND NOT had_error THEN 'final' ELSE 'error' END AS outcome,
       CASE WHEN NOT final_reached THEN 'no final answer' WHEN had_error THEN 'step failed' END AS reason FROM runs
""")
def run_completion(spark, d):
    return E.run_completion(E.run_summary(view(spark, d, "run_events"), GAP_MINUTES)).select(
        "user_id", stamp("run_start").alias("run_start"), "outcome", "reason"
    )


METRICS_SQL = duckdb_cte("run_events") + f"""
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S.%f') AS window_start, {case_sql(E.NODE_KIND)} AS kind, count(*) AS n_events,
       count_if({STATUS_SQL} = 'error') AS n_errors, round(count_if({STATUS_SQL} = 'error') / count(*), 4) AS error_rate
FROM run_events GROUP BY 1, 2
"""


@query("run_metrics_stream", METRICS_SQL)
def run_metrics_stream(spark, d):
    counts = E.run_metrics_stream(event_stream(spark, d))
    out = E.run_updates_to_end(counts, fresh_path(spark, "live"), fresh_path(spark, "live-state"), ["window_start", "kind"])
    return out.withColumn("window_start", stamp("window_start"))


@query("run_metrics_redelivered", METRICS_SQL)
def run_metrics_redelivered(spark, d):
    """The same counts from a stream that delivers every event twice, in no order."""
    events, path = load(spark, d, "events"), fresh_path(spark, "twice")
    events.union(events).repartition(4, "user_id").write.parquet(path)
    twice = over(spark, "run_events", E.read_events(spark, events.schema, path))
    counts = E.run_metrics_stream(twice, delivered_once=False)
    out = E.run_updates_to_end(counts, fresh_path(spark, "live"), fresh_path(spark, "live-state"), ["window_start", "kind"])
    return out.withColumn("window_start", stamp("window_start"))
