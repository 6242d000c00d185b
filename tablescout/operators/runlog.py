"""Scoring of run logs: one row per run in, pass flags and aggregate rates out.

Criteria are column expressions over the run's own row, so scoring is map-only; the only
shuffles are the small group-bys of the metrics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescout.functions.stats import exclusive_p90_by
from tablescout.functions.text import SCORED_WRITE_WORDS, all_write_words, has_write_word, let

# Names under which a tool shows up in a run.
TOOL_ALIASES = {
    "metadata_search": ["search_metadata"],
    "schema_tool": ["get_table_schema"],
    "sql_tool": ["generate_sql", "execute_query"],
}

# Fixed value: how often failed SQL is rewritten.
MAX_REWRITES = 2

# First step after classification.
FIRST_STEP = {
    "navigation": "search_metadata",
    "schema": "get_schema",
    "script": "generate_sql",
    "data": "generate_sql",
    "unknown": "handle_unknown",
    "unsafe": "unsafe_query",
}


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def classification_ok() -> Column:
    return F.coalesce("got_type", F.lit("none")) == F.col("expected_type")


def tools_ok() -> Column:
    aliases = F.create_map(*[
        c for tool, names in TOOL_ALIASES.items() for c in (F.lit(tool), F.array(*map(F.lit, names)))
    ])

    def called(tool):
        names = F.coalesce(F.try_element_at(aliases, tool), F.array(tool))
        return F.arrays_overlap(names, F.coalesce("tools_used", F.array().cast("array<string>")))

    return F.coalesce(F.forall("expected_tools", called), F.lit(True))


def terms_ok() -> Column:
    text = F.lower(F.concat(F.coalesce("answer", F.lit("")), F.lit(" "), F.coalesce("sql", F.lit(""))))
    found = let(text, lambda all_text: F.forall("expected_terms", lambda t: F.contains(all_text, F.lower(t))))
    return F.coalesce(found, F.lit(True))


def sql_executed() -> Column:
    return F.coalesce(
        F.exists("steps", lambda s: F.startswith(s, F.lit("execute_query")) & ~F.contains(s, F.lit("no_sql"))),
        F.lit(False),
    )


def sql_readonly() -> Column:
    clean = ~has_write_word(F.col("sql"), SCORED_WRITE_WORDS)
    return F.when(F.col("sql").isNull(), F.lit(True)).otherwise(clean & F.coalesce("is_safe", F.lit(False)))


def no_error() -> Column:
    failed = F.exists("steps", lambda s: F.endswith(s, F.lit(":error")))
    return ~F.coalesce(failed, F.lit(False)) & (F.coalesce("error", F.lit("")) == "")


CRITERIA = {
    "correct_classification": classification_ok,
    "correct_tool_call": tools_ok,
    "answer_contains_expected_terms": terms_ok,
    "sql_executed": sql_executed,
    "sql_not_executed": lambda: ~sql_executed(),
    "sql_readonly": sql_readonly,
    "no_unhandled_error": no_error,
}


def score_case(runs: DataFrame, criteria: dict | None = None) -> DataFrame:
    """Add ``results`` (name, passed per listed criterion) and ``passed`` (all of them).

    ``criteria`` maps further names to functions giving a boolean column. A listed name
    without such a function fails; a run listing none passes.
    """
    checks = {**CRITERIA, **(criteria or {})}
    listed = F.coalesce("criteria", F.array().cast("array<string>"))
    # every check stands once in the plan; looking them up per listed name would repeat them all
    verdicts = F.array(*[
        F.struct(F.lit(name).alias("name"), F.coalesce(check(), F.lit(False)).alias("passed"))
        for name, check in checks.items()
    ])
    def listed_results(both):
        unknown = F.array_except(both["listed"], F.array(*map(F.lit, checks)))
        return F.concat(
            F.filter(both["verdicts"], lambda r: F.array_contains(both["listed"], r["name"])),
            F.transform(unknown, lambda name: F.struct(name.alias("name"), F.lit(False).alias("passed"))),
        )

    results = let(F.struct(listed.alias("listed"), verdicts.alias("verdicts")), listed_results)
    return runs.withColumn("results", results).withColumn("passed", F.forall("results", lambda r: r["passed"]))


def _listed(items: Column) -> Column:
    """An array of strings as a Python list is shown: single quotes, double ones around a text that holds only single ones."""
    def shown(x):
        escaped = F.replace(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))
        single = F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
        double = F.concat(F.lit('"'), escaped, F.lit('"'))
        return F.when(F.contains(x, F.lit("'")) & ~F.contains(x, F.lit('"')), double).otherwise(single)

    return F.concat(F.lit("["), F.array_join(F.transform(items, shown), ", "), F.lit("]"))


def criterion_detail() -> dict[str, Column]:
    """Why each known criterion of a run passed or failed, as text."""
    none = F.array().cast("array<string>")
    tools, steps = F.coalesce("tools_used", none), F.coalesce("steps", none)
    wanted, terms = F.coalesce("expected_tools", none), F.coalesce("expected_terms", none)
    aliases = F.create_map(*[c for t, names in TOOL_ALIASES.items() for c in (F.lit(t), F.array(*map(F.lit, names)))])
    missing = F.filter(wanted, lambda t: ~F.arrays_overlap(F.coalesce(F.try_element_at(aliases, t), F.array(t)), tools))
    text = F.lower(F.concat(F.coalesce("answer", F.lit("")), F.lit(" "), F.coalesce("sql", F.lit(""))))
    unmet = F.filter(terms, lambda t: ~F.contains(text, F.lower(t)))
    broken = F.filter(steps, lambda s: F.endswith(s, F.lit(":error")))
    got = F.coalesce("got_type", F.lit("none"))
    written = F.concat(F.lit("steps="), _listed(steps))
    # fixed values: the wording of the details
    return {
        "correct_classification": F.when(classification_ok(), got).otherwise(
            F.concat(F.lit("got="), got, F.lit(", expected="), F.coalesce("expected_type", F.lit("None")))),
        "correct_tool_call": F.when(F.size(wanted) == 0, "no tools expected").otherwise(F.concat(
            F.when(F.size(missing) > 0, F.concat(F.lit("missing="), _listed(missing), F.lit(", "))).otherwise(""),
            F.lit("tools_used="), _listed(tools))),
        "answer_contains_expected_terms": F.when(F.size(terms) == 0, "no terms expected")
        .when(F.size(unmet) > 0, F.concat(F.lit("missing_terms="), _listed(unmet)))
        .otherwise(F.concat(F.lit("found="), _listed(terms))),
        "sql_executed": written,
        "sql_not_executed": written,
        "sql_readonly": F.when(F.col("sql").isNull(), "no SQL generated").when(sql_readonly(), "ok").otherwise(
            F.concat(F.lit("forbidden_keywords="), _listed(F.transform(all_write_words(F.col("sql"), SCORED_WRITE_WORDS), F.upper)))),
        "no_unhandled_error": F.when(no_error(), "no errors")
        .when(F.size(broken) > 0, F.concat(F.lit("error_steps="), _listed(broken)))
        .otherwise(F.concat(F.lit("state.error="), F.substring(_listed(F.array("error")), F.lit(2), F.length(_listed(F.array("error"))) - 2))),
    }


def with_details(scored: DataFrame, criteria: dict | None = None) -> DataFrame:
    """``score_case`` rows whose ``results`` also say why: (name, passed, detail).

    ``criteria`` are those given to ``score_case``; they have no detail (NULL). A criterion nobody knows says so.
    """
    known = criterion_detail()
    own = F.array(*map(F.lit, [*known, *(criteria or {})]))

    def explained(both):
        def detail(r):
            unknown = F.concat(F.lit("unknown criterion: "), r["name"])
            return F.when(F.array_contains(own, r["name"]), F.try_element_at(both["why"], r["name"])).otherwise(unknown)

        return F.transform(both["results"], lambda r: F.named_struct(
            F.lit("name"), r["name"], F.lit("passed"), r["passed"], F.lit("detail"), detail(r)))

    why = F.create_map(*[c for name, text in known.items() for c in (F.lit(name), text)])
    return scored.withColumn("results", let(F.struct(F.col("results").alias("results"), why.alias("why")), explained))


def criterion_details(scored: DataFrame, criteria: dict | None = None) -> DataFrame:
    """One row per run and listed criterion: (case_id, name, passed, detail), runs that broke off included."""
    return with_details(scored, criteria).select("case_id", F.explode_outer("results").alias("verdict")).select(
        "case_id", "verdict.name", "verdict.passed", "verdict.detail").where("name IS NOT NULL")


def run_criteria(scored: DataFrame) -> DataFrame:
    """One row per run and criterion, runs that broke off excluded.

    ``explode`` would have the optimizer test the size of ``results`` first and compute all
    checks a second time for that; ``explode_outer`` does not.
    """
    return scored.where(F.coalesce("error", F.lit("")) == "").select(
        "case_id", F.explode_outer("results").alias("verdict")
    ).select("case_id", "verdict.name", "verdict.passed").where("name IS NOT NULL")


def run_totals(scored: DataFrame) -> DataFrame:
    broke = F.coalesce("error", F.lit("")) != ""
    total = F.count(F.lit(1))
    passed = F.count_if(F.col("passed") & ~broke)
    return scored.agg(
        total.alias("total"),
        passed.alias("passed"),
        F.count_if(~F.col("passed") & ~broke).alias("failed"),
        F.count_if(broke).alias("errors"),
        F.round(F.coalesce(F.try_divide(passed, total), F.lit(0.0)), 4).alias("pass_rate"),
    )


def run_latency(runs: DataFrame) -> DataFrame:
    """Mean, total and exclusive 90 % quantile of the latencies above zero; 0 without any."""
    timed = runs.where(F.col("latency_s") > 0).select("latency_s", F.lit("all").alias("runs"))
    p90 = exclusive_p90_by(timed, "latency_s", ["runs"]).select("p90").scalar()
    return timed.agg(
        F.round(F.coalesce(F.avg("latency_s"), F.lit(0.0)), 2).alias("avg_latency_s"),
        F.round(F.coalesce(F.sum("latency_s"), F.lit(0.0)), 2).alias("total_time_s"),
    ).select("avg_latency_s", F.round(F.coalesce(p90, F.lit(0.0)), 2).alias("p90_latency_s"), "total_time_s")


def by_criterion(criteria_rows: DataFrame) -> DataFrame:
    return criteria_rows.groupBy("name").agg(
        F.round(F.avg(F.col("passed").cast("int")), 4).alias("pass_rate"),
        F.count_if(F.col("passed")).alias("passed"),
        F.count(F.lit(1)).alias("total"),
    )


def headline_rates(criteria_rows: DataFrame) -> DataFrame:
    """Classification and tool rates (0 when absent) and SQL safety rate (1 when absent)."""
    def rate(name, absent):
        hit = F.when(F.col("name") == name, F.col("passed").cast("int"))
        return F.round(F.coalesce(F.avg(hit), F.lit(absent)), 4)

    return criteria_rows.agg(
        rate("correct_classification", 0.0).alias("classification_accuracy"),
        rate("correct_tool_call", 0.0).alias("tool_call_accuracy"),
        rate("sql_readonly", 1.0).alias("sql_safety_rate"),
    )


def by_category(scored: DataFrame) -> DataFrame:
    passed = F.count_if(F.col("passed") & (F.coalesce("error", F.lit("")) == ""))
    latency = F.avg(F.when(F.col("latency_s") > 0, F.col("latency_s")))
    return scored.groupBy("category").agg(
        F.count(F.lit(1)).alias("total"),
        passed.alias("passed"),
        F.round(passed / F.count(F.lit(1)), 4).alias("pass_rate"),
        F.round(F.coalesce(latency, F.lit(0.0)), 2).alias("avg_latency"),
    )


def run_metrics(scored: DataFrame) -> DataFrame:
    """All metrics of a run as one row: totals, headline rates, latencies, and ``by_category`` and ``by_criterion`` as maps.

    Maps hold one entry for each category and criterion. Runs without a category come under the empty name. Without any run all
    counts are 0 and the maps empty.
    """
    checked = run_criteria(scored)

    def by(groups: DataFrame, name: str, *values: str) -> DataFrame:
        entry = F.struct(F.coalesce(name, F.lit("")).alias("key"), F.struct(*values).alias("value"))
        return groups.agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("m"))

    one = run_totals(scored).withColumnRenamed("pass_rate", "overall_pass_rate")
    parts = [headline_rates(checked), run_latency(scored)]
    parts += [by(by_category(scored), "category", "total", "passed", "pass_rate", "avg_latency").withColumnRenamed("m", "by_category"),
              by(by_criterion(checked), "name", "pass_rate", "passed", "total").withColumnRenamed("m", "by_criterion")]
    for part in parts:
        whole = part.select(F.struct("*")).scalar()  # one row each
        one = one.withColumn("_part", whole).select("*", "_part.*").drop("_part")
    return one


def derive_error(runs: DataFrame) -> DataFrame:
    """First of: SQL writing error, execution error, schema message."""
    def text(message, fallback):
        return F.coalesce(F.nullif(F.col(message), F.lit("")), F.lit(fallback))

    return runs.withColumn("derived_error", F.coalesce(
        F.when(F.col("sql_status") == "error", text("sql_message", "SQL generation error")),
        F.when(F.col("exec_status") == "error", text("exec_message", "query execution error")),
        F.nullif(F.col("schema_message"), F.lit("")),
    ))


def first_step(query_type: Column) -> Column:
    return F.coalesce(F.try_element_at(_literal_map(FIRST_STEP), query_type), F.lit("handle_unknown"))


def step_after_sql(query_type: Column, sql_status: Column, is_safe: Column) -> Column:
    run = (query_type == "data") & (sql_status == "success") & is_safe
    return F.when(F.coalesce(run, F.lit(False)), "execute_query").otherwise("format_response")


def step_after_execution(exec_status: Column, retries: Column) -> Column:
    again = (exec_status == "error") & (F.coalesce(retries, F.lit(0)) < MAX_REWRITES)
    return F.when(F.coalesce(again, F.lit(False)), "fix_sql").otherwise("format_response")


def route_audit(runs: DataFrame) -> DataFrame:
    """Expected next step at the three decision points against the step really taken.

    ``*_taken`` is the step that follows (NULL if the run never got there). The last execution is held against the run's final status;
    ``retries_ok`` holds every earlier one against its own: an error is followed by a rewrite as long as fewer than two were made. ``unchecked_rewrite``
    marks runs executing unsafe text, which the rules do not test again after a rewrite.
    """
    nodes = F.transform("steps", lambda s: F.split_part(s, F.lit(":"), F.lit(1)))

    def following(step, last=False):
        """Node right after the first (or last) occurrence of a step."""
        size = F.size("nodes")
        first_at = F.array_position("nodes", step)
        last_at = F.when(first_at > 0, size + 1 - F.array_position(F.reverse("nodes"), step)).otherwise(0)
        at = (last_at if last else first_at).cast("int")
        return F.when(at > 0, F.try_element_at("nodes", at + 1))

    out = runs.withColumn("nodes", nodes).select(
        "*",
        first_step(F.col("category")).alias("first_expected"),
        following("classify_intent").alias("first_taken"),
        step_after_sql(F.col("category"), F.col("sql_status"), F.col("is_safe")).alias("after_sql_expected"),
        following("generate_sql").alias("after_sql_taken"),
        step_after_execution(F.col("exec_status"), F.col("retry_count")).alias("after_exec_expected"),
        following("execute_query", last=True).alias("after_exec_taken"),
    )

    positions = F.sequence(F.lit(1), F.greatest(F.size("nodes"), F.lit(1)))
    last = F.size("nodes") + 1 - F.array_position(F.reverse("nodes"), "execute_query")

    def retried(i):
        before = F.size(F.filter(F.slice("nodes", F.lit(1), i), lambda n: n == "fix_sql"))
        status = F.split_part(F.try_element_at("steps", i), F.lit(":"), F.lit(2))
        taken = F.coalesce(F.try_element_at("nodes", i + 1), F.lit(""))
        early = F.coalesce(F.try_element_at("nodes", i) == "execute_query", F.lit(False)) & (i < last)
        return ~early | (taken == step_after_execution(status, before))

    out = out.withColumn("retries_ok", F.coalesce(F.forall(positions, retried), F.lit(True)))

    def agrees(point):
        taken = F.col(f"{point}_taken")
        return taken.isNull() | (taken == F.col(f"{point}_expected"))

    return out.select(
        "*",
        (agrees("first") & agrees("after_sql") & agrees("after_exec") & F.col("retries_ok")).alias("route_ok"),
        (F.array_contains("nodes", "execute_query") & ~F.coalesce("is_safe", F.lit(True))).alias("unchecked_rewrite"),
    )
