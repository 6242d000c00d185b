"""Views derived from the given tables, in SQL both Spark and DuckDB read.

``{name}`` stands for a given table, ``{no_items}`` for an empty list literal, ``{q}`` for the
quotes of a name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablescout.sources.tables import load

QUERY_LOG = """
SELECT event_id,
       CASE event_type
            WHEN 'purchase' THEN concat('UPDATE debt SET status = ', event_id % 3, ' WHERE id = ', user_id)
            WHEN 'error' THEN concat('drop table t_', user_id, '; insert into u values (1)')
            WHEN 'click' THEN concat('SELECT R_CREATE_USER_ID FROM t WHERE id = ', event_id)
            WHEN 'view' THEN concat('SELECT TOP ', event_id % 300, ' * FROM t')
            ELSE 'WITH c AS (SELECT 1 AS a) SELECT * FROM c' END AS sql,
       CASE event_type
            WHEN 'error' THEN concat('429 Too Many Requests, retry-after: ', event_id % 30)
            WHEN 'signup' THEN concat('timeout: ', event_id % 7, ' servers down')
            WHEN 'purchase' THEN concat('Rate limit reached, try again in ', event_id % 9, '.5s') END AS error_text
FROM {events}
"""

CODE_DICT = """
SELECT * FROM (VALUES
    (1, 6, 'F', 'finished'), (2, 6, 'O', 'open'), (3, 6, 'P', 'partly shipped'),
    (4, 9, 'F', 'female'), (5, 9, 'M', 'male')) AS d(id, dict_code, code, name)
"""

LINKS = """
SELECT event_id AS id,
       CASE event_id % 3 WHEN 0 THEN 'customer' WHEN 1 THEN 'supplier' ELSE 'part' END AS obj,
       CASE WHEN event_id % 50 = 0 THEN -1 - user_id ELSE user_id END AS r_id
FROM {events}
"""

QUESTIONS = """
SELECT event_id AS qid,
       CASE event_type
            WHEN 'click' THEN concat('Где хранится custkey клиента ', user_id, '?')
            WHEN 'view' THEN concat('покажи скидку l_disc, 100%_', user_id, '?')
            WHEN 'signup' THEN 'где найти'
            WHEN 'purchase' THEN 'Order status, totalprice и nation?'
            ELSE concat('zzz', event_id, ' qqq') END AS text
FROM {events}
"""

RUN_LOG = """
SELECT r.*,
       CASE WHEN r.case_id % 35 = 0 THEN NULL WHEN r.case_id % 5 = 0 THEN 'unknown' ELSE r.category END AS got_type,
       r.category AS expected_type,
       CASE r.category WHEN 'navigation' THEN split('metadata_search', ',')
            WHEN 'schema' THEN split('schema_tool', ',')
            WHEN 'unsafe' THEN {no_items}
            ELSE split('metadata_search,sql_tool', ',') END AS expected_tools,
       CASE r.category WHEN 'navigation' THEN split('search_metadata', ',')
            WHEN 'schema' THEN CASE WHEN r.case_id % 9 = 0 THEN split('search_metadata', ',')
                                    ELSE split('search_metadata,get_table_schema', ',') END
            WHEN 'script' THEN split('search_metadata,generate_sql', ',')
            WHEN 'data' THEN split('search_metadata,generate_sql,execute_query', ',')
            ELSE {no_items} END AS tools_used,
       CASE r.category WHEN 'navigation' THEN split('debt,Status', ',')
            WHEN 'schema' THEN split('person', ',')
            WHEN 'script' THEN split('SELECT,Person', ',')
            WHEN 'data' THEN split('from DEBT', ',')
            ELSE {no_items} END AS expected_terms,
       CASE WHEN r.case_id % 8 = 0 THEN NULL
            WHEN r.case_id % 2 = 0 THEN 'STATUS is kept in Debt, names in PERSON'
            ELSE 'The table person has columns' END AS answer,
       CASE WHEN r.category = 'script' THEN 'SELECT TOP 10 * FROM person'
            WHEN r.category = 'data' AND r.case_id % 11 = 0 THEN 'UPDATE debt SET status = 1'
            WHEN r.category = 'data' THEN concat('SELECT * FROM debt WHERE id = ', r.user_id) END AS sql,
       CASE WHEN r.category IN ('script', 'data') THEN r.case_id % 11 <> 0 END AS is_safe,
       CASE r.category WHEN 'navigation' THEN split('classify_intent:navigation,search_metadata,format_response', ',')
            WHEN 'schema' THEN CASE WHEN r.case_id % 9 = 0
                THEN split('classify_intent:schema,get_schema:not_found,format_response', ',')
                ELSE split('classify_intent:schema,get_schema,format_response', ',') END
            WHEN 'script' THEN CASE WHEN r.case_id % 13 = 0
                THEN split('classify_intent:script,generate_sql:error,format_response', ',')
                ELSE split('classify_intent:script,generate_sql:success,format_response', ',') END
            WHEN 'data' THEN CASE r.case_id % 6
                WHEN 0 THEN split('classify_intent:data,generate_sql:success,execute_query:error,fix_sql:attempt_1,execute_query:success,format_response', ',')
                WHEN 1 THEN split('classify_intent:data,generate_sql:success,execute_query:empty,format_response', ',')
                WHEN 2 THEN split('classify_intent:data,generate_sql:success,execute_query:error,fix_sql:attempt_1,execute_query:error,fix_sql:attempt_2,execute_query:error,format_response', ',')
                WHEN 3 THEN split('classify_intent:data,generate_sql:error,format_response', ',')
                WHEN 4 THEN split('classify_intent:data,generate_sql:error,execute_query:no_sql,format_response', ',')
                ELSE split('classify_intent:data,generate_sql:success,execute_query:success,format_response', ',') END
            ELSE split('classify_intent:unsafe,unsafe_query:blocked', ',') END AS steps,
       CASE WHEN r.category = 'script' THEN CASE WHEN r.case_id % 13 = 0 THEN 'error' ELSE 'success' END
            WHEN r.category = 'data' THEN CASE WHEN r.case_id % 6 IN (3, 4) THEN 'error' ELSE 'success' END END AS sql_status,
       CASE WHEN r.category = 'script' AND r.case_id % 26 = 0 THEN 'model refused' END AS sql_message,
       CASE WHEN r.category = 'data' THEN CASE r.case_id % 6 WHEN 1 THEN 'empty' WHEN 2 THEN 'error' WHEN 3 THEN NULL
            WHEN 4 THEN 'error' ELSE 'success' END END AS exec_status,
       CASE WHEN r.category = 'data' AND r.case_id % 6 = 2 THEN concat('invalid column c', r.user_id) END AS exec_message,
       CASE WHEN r.category = 'schema' AND r.case_id % 9 = 0 THEN 'table not found' END AS schema_message,
       CASE WHEN r.category = 'data' THEN CASE r.case_id % 6 WHEN 0 THEN 1 WHEN 2 THEN 2 ELSE 0 END ELSE 0 END AS retry_count,
       CASE r.category WHEN 'script' THEN split('correct_classification,correct_tool_call,answer_contains_expected_terms,sql_not_executed,sql_readonly,no_unhandled_error', ',')
            WHEN 'data' THEN split('correct_classification,correct_tool_call,answer_contains_expected_terms,sql_executed,sql_readonly,no_unhandled_error', ',')
            WHEN 'unsafe' THEN CASE WHEN r.case_id % 4 = 0 THEN {no_items} ELSE split('correct_classification,sql_not_executed,tone_of_voice', ',') END
            ELSE split('correct_classification,correct_tool_call,answer_contains_expected_terms,sql_not_executed,no_unhandled_error', ',') END AS criteria
FROM (SELECT event_id AS case_id, user_id, ts,
             CASE event_type WHEN 'click' THEN 'navigation' WHEN 'view' THEN 'schema'
                  WHEN 'signup' THEN 'script' WHEN 'purchase' THEN 'data' ELSE 'unsafe' END AS category,
             CASE WHEN event_id % 19 = 0 THEN 0 ELSE value END AS latency_s,
             CASE WHEN event_id % 17 = 0 THEN 'timeout' END AS error
      FROM {events}) AS r
"""

RUN_EVENTS = """
SELECT event_id, ts, user_id,
       CASE WHEN event_id % 23 = 0 THEN 'format_response'
            WHEN event_id % 101 = 0 THEN 'unsafe_query'
            WHEN event_type = 'click' THEN 'search_metadata'
            WHEN event_type = 'view' THEN 'get_schema'
            WHEN event_type = 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'classify_intent' ELSE 'generate_sql' END
            WHEN event_type = 'purchase' THEN 'execute_query'
            ELSE CASE WHEN event_id % 2 = 0 THEN 'fix_sql' ELSE 'execute_query' END END AS node,
       CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 6 = 0 THEN 'empty' ELSE 'success' END AS status,
       event_id % 6 AS n_found,
       CASE WHEN event_type = 'error' THEN concat('Invalid object name t', user_id) END AS message
FROM {events}
"""

EVENT_DETAILS = """
SELECT r.*,
       CASE event_id % 4 WHEN 0 THEN 'navigation' WHEN 1 THEN 'schema' WHEN 2 THEN 'data' END AS query_type,
       CASE WHEN event_id % 3 = 0 THEN '0.5' ELSE '0.95' END AS confidence,
       repeat(concat('because ', event_id, ' '), CAST(event_id % 40 AS INT)) AS reasoning,
       split(substring('customer,orders,lineitem,part,supplier,nation,region', 1, CAST(8 + event_id % 44 AS INT)), ',') AS tables,
       CASE WHEN event_id % 6 > 0 THEN 'orders' END AS {q}table{q}, event_id % 9 AS n_columns,
       concat(' SELECT ', repeat('custkey, ', CAST(event_id % 90 AS INT)), event_id, ' FROM orders ') AS sql,
       event_id % 5 > 0 AS is_safe, event_id % 3 AS attempt, event_id % 7 = 0 AS truncated
FROM ({run_events}) AS r
""".replace("{run_events}", RUN_EVENTS)

VIEWS = {
    "query_log": QUERY_LOG,
    "code_dict": CODE_DICT,
    "links": LINKS,
    "questions": QUESTIONS,
    "run_log": RUN_LOG,
    "run_events": RUN_EVENTS,
    "event_details": EVENT_DETAILS,
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view over the tables in ``sf_dir``."""
    return over(spark, name, load(spark, sf_dir, "events"))


def over(spark: SparkSession, name: str, events: DataFrame) -> DataFrame:
    """The same view over a given events DataFrame, batch or streaming."""
    text = VIEWS[name].replace("{no_items}", "array()").replace("{q}", "`")
    return spark.sql(text, events=events)


def duckdb_cte(*names: str) -> str:
    """``WITH`` clause giving the views to a DuckDB query."""
    parts = [
        f"{n} AS ({VIEWS[n].replace('{no_items}', '[]').replace('{q}', chr(34)).replace('{events}', 'events')})" for n in names
    ]
    return "WITH " + ",\n".join(parts)
