import random
import statistics

import pytest
from helpers import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablescout.functions.stats import exclusive_p90, exclusive_p90_by
from tablescout.operators import runlog as L

RUN = """
case_id BIGINT, category STRING, expected_type STRING, got_type STRING, expected_tools ARRAY<STRING>,
tools_used ARRAY<STRING>, expected_terms ARRAY<STRING>, answer STRING, sql STRING, is_safe BOOLEAN,
steps ARRAY<STRING>, sql_status STRING, sql_message STRING, exec_status STRING, exec_message STRING,
schema_message STRING, retry_count INT, criteria ARRAY<STRING>, latency_s DOUBLE, error STRING
"""


def run(case_id, **given):
    base = dict(
        case_id=case_id, category="data", expected_type="data", got_type="data", expected_tools=[], tools_used=[],
        expected_terms=[], answer=None, sql=None, is_safe=None, steps=[], sql_status=None, sql_message=None,
        exec_status=None, exec_message=None, schema_message=None, retry_count=0, criteria=[], latency_s=1.0, error=None,
    )
    return {**base, **given}


def log(spark, *runs):
    return spark.createDataFrame(list(runs), RUN)


def p90(values):
    return statistics.quantiles(values, n=10)[8] if len(values) > 1 else values[0]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(0.001, 1e6), min_size=1, max_size=40))
def test_p90_is_the_exclusive_quantile(spark, values):
    df = spark.createDataFrame([(1, v) for v in values], "g INT, v DOUBLE")
    got = exclusive_p90_by(df, "v", ["g"]).first()["p90"]
    assert got == pytest.approx(p90(values), rel=1e-9)
    arrays = df.groupBy("g").agg(F.array_sort(F.collect_list("v")).alias("a")).select(exclusive_p90(F.col("a")))
    assert arrays.first()[0] == pytest.approx(p90(values), rel=1e-9)


def test_p90_of_large_skewed_groups(spark):
    rng = random.Random(3)
    data = {"hot": [round(rng.lognormvariate(0, 2), 3) for _ in range(3000)], "same": [2.5] * 700, "one": [4.0], "two": [1.0, 9.0]}
    df = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs] + [("hot", 0.0)], "g STRING, v DOUBLE")
    got = {r.g: r.p90 for r in exclusive_p90_by(df, "v", ["g"]).collect()}
    positive = {g: [v for v in vs if v > 0] for g, vs in data.items()}
    assert got == pytest.approx({g: p90(vs) for g, vs in positive.items()})


def test_criteria(spark):
    df = log(
        spark,
        run(1, got_type=None, expected_tools=["sql_tool"], tools_used=["execute_query"], expected_terms=["DEBT", "x"],
            answer="debt", sql="select X", is_safe=True, steps=["execute_query:success"]),
        run(2, expected_tools=["schema_tool", "other"], tools_used=["get_table_schema", "other"], sql="drop t", is_safe=True,
            steps=["execute_query:no_sql"], expected_terms=["missing"]),
        run(3, expected_tools=["schema_tool", "sql_tool"], tools_used=["get_table_schema"], sql="select 1", is_safe=False,
            steps=["execute_query:error"]),
        run(4, error="boom", tools_used=None, expected_tools=["a"]),
    )
    flags = df.select("case_id", *[check().alias(name) for name, check in L.CRITERIA.items()])
    got = {r.case_id: r.asDict() for r in flags.collect()}
    assert [got[i]["correct_classification"] for i in (1, 2, 3, 4)] == [False, True, True, True]
    assert [got[i]["correct_tool_call"] for i in (1, 2, 3, 4)] == [True, True, False, False]
    assert [got[i]["answer_contains_expected_terms"] for i in (1, 2, 3, 4)] == [True, False, True, True]
    assert [got[i]["sql_executed"] for i in (1, 2, 3, 4)] == [True, False, True, False]
    assert [got[i]["sql_not_executed"] for i in (1, 2, 3, 4)] == [False, True, False, True]
    assert [got[i]["sql_readonly"] for i in (1, 2, 3, 4)] == [True, False, False, True]
    assert [got[i]["no_unhandled_error"] for i in (1, 2, 3, 4)] == [True, True, False, False]


def test_score_case_unknown_criterion_and_empty_list(spark):
    df = log(
        spark, run(1), run(2, criteria=["tone"]), run(3, criteria=["correct_classification", "no_unhandled_error"]),
        run(4, criteria=["correct_classification", "polite"]),
    )
    scored = L.score_case(df, {"polite": lambda: F.lit(True)})
    assert rows(scored, "case_id", "passed") == [(1, True), (2, False), (3, True), (4, True)]
    assert rows(L.run_criteria(scored))[0] == (2, "tone", False)


def test_details_tell_why(spark):
    every = list(L.CRITERIA)
    df = log(
        spark,
        run(1, criteria=[*every, "tone", "polite"], expected_tools=["sql_tool", "it's"], tools_used=["execute_query"],
            expected_terms=["Debt", "x"], answer="debts", sql="drop table a; DROP b", is_safe=True, steps=["a:ok", "b:error"]),
        run(2, criteria=every, got_type=None, sql="SELECT 1", is_safe=True, error="it broke"),
        run(3),
    )
    polite = {"polite": lambda: F.lit(False)}
    got = {(r.case_id, r.name): (r.passed, r.detail) for r in L.criterion_details(L.score_case(df, polite), polite).collect()}
    steps = "steps=['a:ok', 'b:error']"
    assert got == {
        (1, "correct_classification"): (True, "data"),
        (1, "correct_tool_call"): (False, """missing=["it's"], tools_used=['execute_query']"""),
        (1, "answer_contains_expected_terms"): (False, "missing_terms=['x']"),
        (1, "sql_executed"): (False, steps), (1, "sql_not_executed"): (True, steps),
        (1, "sql_readonly"): (False, "forbidden_keywords=['DROP', 'DROP']"),
        (1, "no_unhandled_error"): (False, "error_steps=['b:error']"),
        (1, "tone"): (False, "unknown criterion: tone"), (1, "polite"): (False, None),
        (2, "correct_classification"): (False, "got=none, expected=data"),
        (2, "correct_tool_call"): (True, "no tools expected"),
        (2, "answer_contains_expected_terms"): (True, "no terms expected"),
        (2, "sql_executed"): (False, "steps=[]"), (2, "sql_not_executed"): (True, "steps=[]"),
        (2, "sql_readonly"): (True, "ok"), (2, "no_unhandled_error"): (False, "state.error='it broke'"),
    }


def metrics(spark, *runs):
    scored = L.score_case(log(spark, *runs))
    return L.run_totals(scored).first(), scored


def test_metrics_of_nothing(spark):
    totals, scored = metrics(spark)
    assert (totals.total, totals.passed, totals.pass_rate) == (0, 0, 0.0)
    assert tuple(L.run_latency(scored).first()) == (0.0, 0.0, 0.0)
    rates = L.headline_rates(L.run_criteria(scored)).first()
    assert tuple(rates) == (0.0, 0.0, 1.0)


def test_metrics_all_pass(spark):
    totals, scored = metrics(spark, *[run(i, criteria=["correct_classification"]) for i in range(4)])
    assert (totals.total, totals.passed, totals.pass_rate) == (4, 4, 1.0)
    assert L.headline_rates(L.run_criteria(scored)).first().classification_accuracy == 1.0


def test_metrics_pass_fail_error(spark):
    totals, scored = metrics(
        spark, run(1, criteria=["correct_classification"]), run(2, got_type="unknown", criteria=["correct_classification"]),
        run(3, error="boom", criteria=["correct_classification"]),
    )
    assert (totals.passed, totals.failed, totals.errors) == (1, 1, 1)
    assert rows(L.by_criterion(L.run_criteria(scored))) == [("correct_classification", 0.5, 1, 2)]


def test_latency_mean_and_p90(spark):
    r = L.run_latency(log(spark, *[run(i, latency_s=float(i)) for i in range(1, 11)])).first()
    assert (r.avg_latency_s, r.p90_latency_s, r.total_time_s) == (5.5, 9.9, 55.0)


def test_by_category_keeps_errors_in_the_denominator(spark):
    _, scored = metrics(spark, run(1, category="data"), run(2, category="unsafe", criteria=["x"]), run(3, category="data", error="e", latency_s=0.0))
    assert rows(L.by_category(scored)) == [("data", 2, 1, 0.5, 1.0), ("unsafe", 1, 0, 0.0, 1.0)]


def test_derive_error(spark):
    df = log(
        spark, run(1, sql_status="error", exec_status="error", exec_message="x"), run(2, exec_status="error", exec_message="bad column"),
        run(3, schema_message="table not found"), run(4, exec_status="empty"), run(5, sql_status="error", sql_message="no"),
    )
    assert rows(L.derive_error(df), "case_id", "derived_error") == [
        (1, "SQL generation error"), (2, "bad column"), (3, "table not found"), (4, None), (5, "no"),
    ]


def test_routes(spark):
    types = ["navigation", "schema", "script", "data", "unknown", "unsafe", None]
    df = spark.createDataFrame([(t,) for t in types], "t STRING")
    assert [r[0] for r in df.select(L.first_step(F.col("t"))).collect()] == [
        "search_metadata", "get_schema", "generate_sql", "generate_sql", "handle_unknown", "unsafe_query", "handle_unknown",
    ]
    after = spark.createDataFrame(
        [("data", "success", True), ("data", "success", False), ("script", "success", True), ("data", "error", True), (None, None, None)],
        "t STRING, s STRING, safe BOOLEAN",
    )
    assert [r[0] for r in after.select(L.step_after_sql(*map(F.col, ("t", "s", "safe")))).collect()] == [
        "execute_query", *["format_response"] * 4,
    ]
    ran = spark.createDataFrame([("error", 0), ("error", 1), ("error", 2), ("empty", 0), ("success", 0), (None, None)], "s STRING, n INT")
    assert [r[0] for r in ran.select(L.step_after_execution(F.col("s"), F.col("n"))).collect()] == [
        "fix_sql", "fix_sql", *["format_response"] * 4,
    ]


def test_route_audit_flags_wrong_turns(spark):
    good = ["classify_intent:data", "generate_sql:success", "execute_query:success", "format_response"]
    df = log(
        spark, run(1, steps=good, sql_status="success", is_safe=True, exec_status="success"),
        run(2, steps=good, sql_status="success", is_safe=False, exec_status="success"),
        run(3, steps=["classify_intent:data", "search_metadata"], is_safe=True),
    )
    assert rows(L.route_audit(df), "case_id", "route_ok", "unchecked_rewrite") == [(1, True, False), (2, False, True), (3, False, False)]


def test_every_retry_is_held_against_its_own_status(spark):
    start = ["classify_intent:data", "generate_sql:success"]
    failed, fixed, done = "execute_query:error", "fix_sql:success", ["execute_query:success", "format_response"]
    cases = [
        ([*start, failed, fixed, *done], 1, True), ([*start, failed, *done], 0, False), ([*start, failed, fixed, failed, fixed, *done], 2, True),
        ([*start, failed, fixed, failed, fixed, failed, fixed, *done], 3, False), ([*start, "execute_query:success", fixed, *done], 1, False),
    ]
    df = log(spark, *(run(i, steps=s, sql_status="success", is_safe=True, exec_status="success", retry_count=n) for i, (s, n, _) in enumerate(cases)))
    got = {r.case_id: (r.retries_ok, r.route_ok) for r in L.route_audit(df).collect()}
    assert [got[i] for i in sorted(got)] == [(ok, ok) for _, _, ok in cases]


def test_all_metrics_in_one_row(spark):
    _, scored = metrics(
        spark, run(1, criteria=["no_unhandled_error"], latency_s=2.0), run(2, criteria=["sql_readonly"], sql="DROP x", category=None),
        run(3, error="gone"),
    )
    m = L.run_metrics(scored).first().asDict(recursive=True)
    assert (m["total"], m["passed"], m["failed"], m["errors"], m["overall_pass_rate"]) == (3, 1, 1, 1, 0.3333)
    assert (m["classification_accuracy"], m["sql_safety_rate"], m["total_time_s"]) == (0.0, 0.0, 4.0)
    assert m["by_category"] == {
        "data": {"total": 2, "passed": 1, "pass_rate": 0.5, "avg_latency": 1.5}, "": {"total": 1, "passed": 0, "pass_rate": 0.0, "avg_latency": 1.0}}
    assert m["by_criterion"] == {
        "no_unhandled_error": {"pass_rate": 1.0, "passed": 1, "total": 1}, "sql_readonly": {"pass_rate": 0.0, "passed": 0, "total": 1}}
    m = L.run_metrics(scored.limit(0)).first()
    assert (m.total, m.p90_latency_s, m.by_category, m.by_criterion) == (0, 0.0, {}, {})
