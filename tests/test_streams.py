import os
from datetime import datetime, timedelta

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tablescout.plans.derived import over, view
from tablescout.streaming import events as E

RUN = ["user_id", "run_start", "n_steps", "tool_calls", "elapsed_ms", "final_reached", "had_error"]


@pytest.fixture(scope="module")
def staged(spark, sf_dir, tmp_path_factory):
    """The events in time order as four files of rising age."""
    folder = tmp_path_factory.mktemp("staged")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    ordered = events.orderBy("ts").toPandas()
    for i, part in enumerate([ordered[:250], ordered[250:500], ordered[500:750], ordered[750:]]):
        part.to_parquet(folder / f"{i}.parquet", coerce_timestamps="us", index=False)
        os.utime(folder / f"{i}.parquet", (1_700_000_000 + i * 60,) * 2)
    return events.schema, str(folder)


def stream(spark, staged):
    return over(spark, "run_events", E.read_events(spark, *staged, files_per_batch=1))


@pytest.mark.parametrize("gap", [30, 360])
def test_closed_runs_equal_batch_runs(spark, sf_dir, staged, tmp_path, gap):
    out = E.run_to_end(E.run_summary_stream(stream(E.stream_session(spark), staged), gap), str(tmp_path / "out"), str(tmp_path / "state"))
    events = view(spark, sf_dir, "run_events")
    last = events.agg(F.max("ts").cast("timestamp").alias("m")).first().m
    batch = E.run_summary(events, gap)
    closed = batch.where(F.col("last_ts") + F.expr(f"INTERVAL {gap} MINUTES") <= F.lit(last - timedelta(days=1)))
    assert rows(out, *RUN) == rows(closed, *RUN)
    assert 0 < out.count() < batch.count()


def test_steps_are_positioned_by_time(spark, sf_dir):
    steps = E.run_steps(view(spark, sf_dir, "run_events"), 360).collect()
    by_run = {}
    for s in steps:
        by_run.setdefault((s.user_id, s.run_start), []).append(s)
    assert len(steps) == 1000
    for run in by_run.values():
        run.sort(key=lambda s: s.position)
        assert [s.position for s in run] == list(range(1, len(run) + 1))
        assert [(s.ts, s.event_id) for s in run] == sorted((s.ts, s.event_id) for s in run)
        assert all((b.ts - a.ts) < timedelta(minutes=360) for a, b in zip(run, run[1:]))


def test_one_user_with_most_events(spark):
    """Runs of a hot user, including equal stamps and a pause of exactly the gap."""
    start = datetime(2024, 1, 1)
    stamps = [start + timedelta(seconds=i // 3) for i in range(900)]
    stamps += [stamps[-1] + timedelta(minutes=30), stamps[-1] + timedelta(minutes=59, seconds=59)]
    data = [(i, t, 1, "execute_query", "success", 1, None) for i, t in enumerate(stamps)] + [(9999, start, 2, "format_response", "success", 0, None)]
    events = spark.createDataFrame(data, "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, node STRING, status STRING, n_found BIGINT, message STRING")
    runs = E.run_summary(events)
    assert rows(runs, "user_id", "n_steps", "tool_calls", "elapsed_ms", "final_reached") == [
        (1, 2, 2, 1_799_000, False), (1, 900, 900, 299_000, False), (2, 0, 0, 0, True),
    ]
    steps = E.run_steps(events).where("user_id = 1").orderBy("run_start", "position").collect()
    assert [s.event_id for s in steps] == list(range(902)) and [s.position for s in steps][-2:] == [1, 2]
    assert rows(E.run_completion(runs), "user_id", "outcome", "reason")[-1] == (2, "final", None)


def test_projection_matches_batch(spark, sf_dir, staged, tmp_path):
    out = E.run_to_end(E.event_project(stream(spark, staged)), str(tmp_path / "out"), str(tmp_path / "state"))
    batch = E.event_project(view(spark, sf_dir, "run_events"))
    columns = ["event_id", "label", "kind", "tool", "status", F.to_json("detail").alias("d")]
    assert rows(out.select(*columns)) == rows(batch.select(*columns))
    assert batch.where(F.col("node").isin(E.TERMINAL_NODES)).count() == 0


def test_step_status_rules(spark):
    given = [
        ("search_metadata", "success", 0, "warn"), ("search_metadata", None, 3, "ok"), ("get_schema", "empty", 0, "warn"),
        ("get_schema", "success", 0, "ok"), ("generate_sql", "error", 0, "error"), ("fix_sql", "success", 0, "warn"),
        ("execute_query", "empty", 0, "warn"), ("execute_query", "error", 0, "error"), ("execute_query", None, 0, "ok"),
        ("classify_intent", None, None, "ok"), ("new_node", None, None, "ok"),
    ]
    df = spark.createDataFrame(given, "node STRING, status STRING, n_found BIGINT, want STRING")
    assert all(r.got == r.want for r in df.withColumn("got", E.step_status()).collect())
    new = df.where("node = 'new_node'").select(
        F.lit(1).alias("event_id"), F.lit(None).alias("ts"), F.lit(1).alias("user_id"), "*", F.lit("m").alias("message")
    )
    r = E.event_project(new).first()
    assert (r.label, r.kind, r.tool, r.detail) == ("new_node", "router", None, {})


def test_live_counts_over_several_batches(spark, sf_dir, staged, tmp_path):
    live = E.run_metrics_stream(stream(spark, staged))
    out = E.run_updates_to_end(live, str(tmp_path / "out"), str(tmp_path / "state"), ["window_start", "kind"])
    batch = E.run_metrics_stream(view(spark, sf_dir, "run_events"))
    assert rows(out) == rows(batch, *out.columns)


def plain_runs(events, gap, delay):
    """Runs of every user one event at a time: the closing rows, and when they may be told."""
    out, last = [], max(e.ts for e in events)
    by_user = {}
    for e in sorted(events, key=lambda e: (e.ts, e.event_id)):
        by_user.setdefault(e.user_id, []).append(e)
    for user, own in by_user.items():
        runs = [[own[0]]]
        for a, b in zip(own, own[1:]):
            if b.ts - a.ts >= gap:
                runs.append([])
            runs[-1].append(b)
        for run in runs:
            if run[-1].ts + gap <= last - delay:
                answers = [e.node for e in run if e.node in E.TERMINAL_NODES]
                failed = [e.message for e in run if e.message is not None]
                message = None if answers else failed[-1] if failed else E.NO_ANSWER
                elapsed = (run[-1].ts - run[0].ts) // timedelta(milliseconds=1)
                tools = sum(e.node in E.TOOL_NODES for e in run)
                out.append((user, run[0].ts, "final" if answers else "error", answers[-1] if answers else None, message, [e.node for e in run], elapsed, tools))
    return sorted(out, key=repr)


def finals(out):
    return rows(out, "user_id", F.col("run_start").cast("timestamp_ntz"), "type", "final_node", "message", "steps", "elapsed_ms", "tool_calls")


@pytest.mark.parametrize("gap", [30, 360])
def test_every_run_ends_with_one_event(spark, sf_dir, staged, tmp_path, gap):
    before = dict(spark.conf.getAll)
    out = E.run_to_end(E.run_final_stream(stream(E.stream_session(spark), staged), gap), str(tmp_path / "out"), str(tmp_path / "state"))
    events = view(spark, sf_dir, "run_events").collect()
    want = plain_runs(events, timedelta(minutes=gap), timedelta(days=1))
    assert finals(out) == want
    assert {w[2] for w in want} == {"final", "error"}
    assert dict(spark.conf.getAll) == before


def test_runs_of_late_users_and_hot_ones(spark, tmp_path):
    """A user who never comes back, one whose events come out of order over two batches, events without a time, and a hot user."""
    schema = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, node STRING, status STRING, n_found BIGINT, message STRING"
    start = datetime(2024, 1, 1)
    at = [(1, 0, 1, "search_metadata"), (2, 0, 2, "execute_query"), (3, 20, 2, "get_schema"), (4, 70, 3, "format_response"), (5, 10, 2, "fix_sql"), (6, 5, 2, "format_response")]
    at += [(100 + i, i / 100, 9, "execute_query") for i in range(2000)] + [(9999, 3000, 4, "classify_intent")]
    made = [(i, start + timedelta(minutes=m), u, n, "success", 1, None) for i, m, u, n in at] + [(7, None, 2, "get_schema", "success", 1, "x")]
    for k, part in enumerate([made[:4] + made[6:1000], made[4:6] + made[1000:-2], made[-2:]]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
        file = next(f for f in os.listdir(tmp_path / f"in{k}") if f.endswith(".parquet"))
        os.makedirs(tmp_path / "in", exist_ok=True)
        os.link(tmp_path / f"in{k}" / file, tmp_path / "in" / f"{k}.parquet")
        os.utime(tmp_path / "in" / f"{k}.parquet", (1_700_000_000 + k * 60,) * 2)
    own = E.stream_session(spark)
    events = E.read_events(own, spark.createDataFrame([], schema).schema, str(tmp_path / "in"), files_per_batch=1)
    out = E.run_to_end(E.run_final_stream(events, 30, "1 hour"), str(tmp_path / "out"), str(tmp_path / "state"))
    timed = [r for r in spark.createDataFrame(made, schema).collect() if r.ts is not None]
    assert finals(out) == plain_runs(timed, timedelta(minutes=30), timedelta(hours=1))
    assert {r.user_id: (r.type, len(r.steps)) for r in out.collect()} == {1: ("error", 1), 2: ("final", 4), 3: ("final", 1), 9: ("error", 2000)}


def test_events_delivered_twice_count_once(spark, sf_dir, staged, tmp_path):
    schema, folder = staged
    os.makedirs(tmp_path / "in")
    for k, name in enumerate(["0", "1", "0", "2", "1", "3", "2"]):
        os.link(f"{folder}/{name}.parquet", tmp_path / "in" / f"{k}.parquet")
    twice = over(spark, "run_events", E.read_events(spark, schema, str(tmp_path / "in"), files_per_batch=7))
    live = E.run_metrics_stream(twice, delivered_once=False)
    out = E.run_updates_to_end(live, str(tmp_path / "out"), str(tmp_path / "state"), ["window_start", "kind"])
    batch = E.run_metrics_stream(view(spark, sf_dir, "run_events"))
    assert rows(out) == rows(batch, *out.columns)


def test_details_of_every_step(spark):
    names = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, node STRING, status STRING, n_found BIGINT, message STRING, query_type STRING, confidence DOUBLE, reasoning STRING, " \
            "tables ARRAY<STRING>, `table` STRING, n_columns INT, sql STRING, is_safe BOOLEAN, attempt INT, truncated BOOLEAN"
    common = ("success", 7, "m" * 300, "data", 0.9, "r" * 300, list("abcdefg"), "debt", 3, " S" * 400, True, 2, False)
    nodes = ["classify_intent", "search_metadata", "get_schema", "generate_sql", "fix_sql", "execute_query", "format_response", "other"]
    df = spark.createDataFrame([(i, None, 1, n, *common) for i, n in enumerate(nodes)], names)
    got = {r.node: r.detail for r in E.event_project(df).collect()}
    sql = ("S " * 300).strip() + " …"
    assert got == {
        "classify_intent": {"query_type": "data", "confidence": "0.9", "reasoning": "r" * 240 + " …"},
        "search_metadata": {"found": "7", "tables": "a, b, c, d, e"},
        "get_schema": {"table": "debt", "columns": "3", "status": "success"},
        "generate_sql": {"sql": sql, "is_safe": "true", "status": "success"},
        "fix_sql": {"attempt": "2", "sql": sql, "status": "success"},
        "execute_query": {"status": "success", "row_count": "7", "truncated": "false", "error": "m" * 200 + " …"},
        "other": {},
    }
    nulls = df.select("event_id", "ts", "user_id", "node", *(F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns[4:]))
    assert all(v is None for r in E.event_project(nulls).collect() for v in r.detail.values())


class _Kept:
    """State and timers of one user in memory."""

    def __init__(self):
        self.rows, self.timers, self.calls = [], set(), 0

    def getListState(self, name, schema):  # noqa: N802
        return self

    def appendList(self, rows):  # noqa: N802
        self.rows += rows

    def put(self, rows):
        self.rows = list(rows)

    def clear(self):
        self.rows = []

    def get(self):
        return iter(self.rows)

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)
        self.calls += 1

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.now


def test_calls_of_a_user_do_not_grow_with_their_runs():
    gap, hour = 60_000_000, 3_600_000_000
    kept, runs = _Kept(), E._OpenRuns(gap)
    runs.init(kept)
    fields = ("ts", "user_id", "micros", "event_id", "node", "message", "terminal", "tool")
    made = [E.Row(*fields)(None, 1, i * hour, i, "get_schema", None, False, True) for i in range(300)]
    for part in (made[150:], made[:150]):
        assert list(runs.handleInputRows((1,), iter(part), kept)) == []
    assert kept.calls == 2 and len(kept.rows) == 2  # before: 300 of each
    out = []
    for kept.now in (100 * hour // 1000, 299 * hour // 1000, 400 * hour // 1000):
        for at in sorted(t for t in kept.timers if t <= kept.now):
            kept.timers.discard(at)
            out += runs.handleExpiredTimer((1,), kept, None)
        assert bool(kept.timers) == bool(kept.rows)
    assert [r.start for r in out] == [i * hour for i in range(300)] and kept.calls <= 5
