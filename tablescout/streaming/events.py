"""Run events: projection to display steps, run summaries and live counts.

Every function takes a batch or a streaming DataFrame of run events
(event_id, ts, user_id, node, status, n_found, message) unless it says otherwise. A run is
what one user does without a pause of ``gap_minutes``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import pairwise

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tablescout.functions.text import truncate

GAP_MINUTES = 30
DELAY = "1 day"

# Nodes that call a tool, their labels and kinds, and the nodes that end a run.
TOOL_NODES = {
    "search_metadata": "search_metadata",
    "get_schema": "get_table_schema",
    "execute_query": "execute_query",
}
NODE_LABELS = {
    "classify_intent": "Классификация запроса",
    "search_metadata": "RAG-поиск по метаданным",
    "get_schema": "Чтение схемы таблицы",
    "generate_sql": "Генерация SQL",
    "execute_query": "Выполнение SQL",
    "fix_sql": "Самоисправление SQL",
    "format_response": "Формирование ответа",
    "handle_unknown": "Запрос вне домена БД",
    "unsafe_query": "Блокировка небезопасного запроса",
}
NODE_KIND = {
    "classify_intent": "llm",
    "search_metadata": "tool",
    "get_schema": "tool",
    "generate_sql": "llm",
    "execute_query": "tool",
    "fix_sql": "llm",
    "format_response": "llm",
    "handle_unknown": "router",
    "unsafe_query": "router",
}
TERMINAL_NODES = ["format_response", "handle_unknown", "unsafe_query"]
NO_ANSWER = "Агент не вернул финальный ответ"


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)


def is_terminal() -> Column:
    return F.col("node").isin(TERMINAL_NODES)


def tool_of() -> Column:
    return _lookup(TOOL_NODES, F.col("node"))


def kind_of() -> Column:
    return F.coalesce(_lookup(NODE_KIND, F.col("node")), F.lit("router"))


def step_status() -> Column:
    """Display status by node: what counts as fine, a warning or an error differs per step."""
    node, status = F.col("node"), F.col("status")
    fine = F.coalesce(status == "success", F.lit(False))
    return (
        F.when(node == "search_metadata", F.when(F.coalesce("n_found", F.lit(0)) > 0, "ok").otherwise("warn"))
        .when(node == "get_schema", F.when(fine, "ok").otherwise("warn"))
        .when(node == "generate_sql", F.when(fine, "ok").otherwise("error"))
        .when(node == "fix_sql", "warn")
        .when(node == "execute_query", F.when(status == "empty", "warn").when(status == "error", "error").otherwise("ok"))
        .otherwise("ok")
    )


def event_project(events: DataFrame) -> DataFrame:
    """Display steps: label, kind, tool, status and a detail map; terminal nodes are left out.

    Details a step shows beyond ``status``, ``n_found`` and ``message`` come from further columns where the events have them:
    ``query_type, confidence, reasoning`` of a classification, ``tables`` (names, five are shown) of a search, ``table, n_columns`` of a
    structure, ``sql, is_safe, attempt`` of generated or repaired SQL, ``truncated`` of an execution.
    """
    node, have = F.col("node"), set(events.columns)

    def entry(key, value):
        return F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"))

    def more(key, column, shown=lambda c: c):
        return [entry(key, shown(F.col(column)))] if column in have else []

    reported = entry("status", F.col("status"))
    found = entry("found", F.col("n_found"))
    error = entry("error", truncate(F.col("message"), 200))
    sql = more("sql", "sql", lambda c: truncate(c, 600))
    steps = {
        "classify_intent": [*more("query_type", "query_type"), *more("confidence", "confidence"), *more("reasoning", "reasoning", lambda c: truncate(c, 240))],
        "search_metadata": [found, *more("tables", "tables", lambda c: F.array_join(F.slice(c, 1, 5), ", "))],
        "get_schema": [*more("table", "table"), *more("columns", "n_columns"), reported],
        "generate_sql": [*sql, *more("is_safe", "is_safe"), reported],
        "fix_sql": [*more("attempt", "attempt"), *sql, reported],
        "execute_query": [reported, entry("row_count", F.col("n_found")), *more("truncated", "truncated"), error],
    }
    detail = F.array().cast("array<struct<key:string,value:string>>")
    for name, entries in steps.items():
        if entries:
            detail = F.when(node == name, F.array(*entries)).otherwise(detail)
    return events.where(~is_terminal()).select(
        "event_id", "ts", "user_id", F.lit("step").alias("type"), "node",
        F.coalesce(_lookup(NODE_LABELS, node), node).alias("label"), kind_of().alias("kind"), tool_of().alias("tool"),
        step_status().alias("status"), F.map_from_entries(detail).alias("detail"),
    )


def _summary_aggregates() -> list[Column]:
    """Constant-size state per run: no list of its events is kept."""
    return [
        F.count_if(~is_terminal()).alias("n_steps"),
        F.count_if(~is_terminal() & tool_of().isNotNull()).alias("tool_calls"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.bool_or(is_terminal()).alias("final_reached"),
        F.bool_or(~is_terminal() & (step_status() == "error")).alias("had_error"),
    ]


def _elapsed_ms() -> Column:
    return ((F.unix_micros("last_ts") - F.unix_micros("first_ts")) / 1000).cast("bigint")


def run_summary_stream(events: DataFrame, gap_minutes: int = GAP_MINUTES, delay: str = DELAY) -> DataFrame:
    """Per closed run: steps, tool calls, elapsed time, whether an answer was reached.

    For streams: ``ts`` becomes an instant, because watermarks need one, and a run is emitted
    once the watermark has passed its end. In a ``stream_session`` each task first merges the sessions among its own
    rows, so a very busy user reaches the shuffle as a few partial runs, not row by row.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return (
        timed.withWatermark("ts", delay)
        .groupBy("user_id", F.session_window("ts", f"{gap_minutes} minutes").alias("session"))
        .agg(*_summary_aggregates())
        .select(
            "user_id", F.col("session.start").alias("run_start"), "n_steps", "tool_calls",
            _elapsed_ms().alias("elapsed_ms"), "final_reached", "had_error",
        )
    )


def _slots(events: DataFrame, gap_minutes: int) -> DataFrame:
    """Events counted per user and gap-long time slot.

    Events of one slot are less than a gap apart, hence of one run. This is the only shuffle
    of a size with the data and map tasks combine for it; afterwards a user has at most one
    row per slot of the calendar, however many events they send.
    """
    return events.groupBy("user_id", _slot(gap_minutes)).agg(*_summary_aggregates(), F.count(F.lit(1)).alias("n_events"))


def _slot(gap_minutes: int) -> Column:
    return F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (gap_minutes * 60_000_000)).alias("slot")


def _with_run_start(slots: DataFrame, gap_minutes: int) -> DataFrame:
    by_user = W.partitionBy("user_id").orderBy("slot")
    previous = F.lag("last_ts").over(by_user)
    pause = F.unix_micros(F.col("first_ts").cast("timestamp")) - F.unix_micros(previous.cast("timestamp"))
    opens = F.when(previous.isNull() | (pause >= gap_minutes * 60_000_000), F.col("first_ts"))
    return slots.withColumn("opens", opens).withColumn(
        "run_start", F.last("opens", ignorenulls=True).over(by_user.rowsBetween(W.unboundedPreceding, 0))
    ).drop("opens")


def run_summary(events: DataFrame, gap_minutes: int = GAP_MINUTES) -> DataFrame:
    """Batch form of ``run_summary_stream`` over all runs, closed or not."""
    runs = _with_run_start(_slots(events, gap_minutes), gap_minutes).groupBy("user_id", "run_start").agg(
        F.sum("n_steps").alias("n_steps"), F.sum("tool_calls").alias("tool_calls"),
        F.min("first_ts").cast("timestamp").alias("first_ts"), F.max("last_ts").cast("timestamp").alias("last_ts"),
        F.bool_or("final_reached").alias("final_reached"), F.bool_or("had_error").alias("had_error"),
    )
    return runs.select(
        "user_id", "run_start", "n_steps", "tool_calls", _elapsed_ms().alias("elapsed_ms"), "final_reached", "had_error",
        "last_ts",
    )


def run_steps(events: DataFrame, gap_minutes: int = GAP_MINUTES) -> DataFrame:
    """The ordered steps of every run, one row per event with its position in the run.

    Positions are put together from three counts: within the second, of earlier seconds of
    the slot, of earlier slots of the run. No window holds more than one second of one
    user's events, the seconds of one slot, or the slots of the calendar.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    timed = events.withColumn("slot", _slot(gap_minutes)).withColumn("second", F.floor(micros / 1_000_000))
    numbered = timed.withColumn(
        "in_second", F.row_number().over(W.partitionBy("user_id", "second").orderBy("ts", "event_id"))
    )
    seconds = timed.groupBy("user_id", "slot", "second").agg(F.count(F.lit(1)).alias("c"))
    in_slot = W.partitionBy("user_id", "slot").orderBy("second").rowsBetween(W.unboundedPreceding, -1)
    seconds = seconds.withColumn("before_second", F.coalesce(F.sum("c").over(in_slot), F.lit(0))).drop("c")
    slots = _with_run_start(_slots(events, gap_minutes), gap_minutes)
    in_run = W.partitionBy("user_id", "run_start").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    slots = slots.withColumn("before_slot", F.coalesce(F.sum("n_events").over(in_run), F.lit(0)))
    offsets = seconds.join(slots.select("user_id", "slot", "run_start", "before_slot"), ["user_id", "slot"]).select(
        "user_id", "second", "run_start", (F.col("before_slot") + F.col("before_second")).alias("before")
    )
    return numbered.join(offsets, ["user_id", "second"]).select(
        "user_id", "run_start", (F.col("before") + F.col("in_second")).alias("position"), "event_id", "ts", "node",
        kind_of().alias("kind"), step_status().alias("status"),
    )


def run_completion(summaries: DataFrame) -> DataFrame:
    """How each run ended: ``final``, or ``error`` when it failed or never reached an answer."""
    return summaries.withColumn(
        "outcome", F.when(F.col("final_reached") & ~F.col("had_error"), "final").otherwise("error")
    ).withColumn(
        "reason", F.when(~F.col("final_reached"), "no final answer").when(F.col("had_error"), "step failed")
    )


def stream_session(spark: SparkSession) -> SparkSession:
    """A session of its own for streams, with the state store and the local merge of sessions they need; the caller's settings stay as they are."""
    own = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.ansi.enabled"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    return own


_OPEN = "events STRING"
_EVENTS_A_ROW = 1000  # of state
_CLOSED = "user_id BIGINT, start BIGINT, stop BIGINT, type STRING, final_node STRING, message STRING, steps ARRAY<STRING>, tool_calls BIGINT"


class _OpenRuns(StatefulProcessor):
    """The events of a user's open runs, and a timer for the earliest end among them.

    New events are appended to the state without reading it, as JSON lists of ``micros, event_id, node, message, terminal, tool``: a state
    row for each event would be converted and sent by itself, which took most of the time. It is read when the watermark passes that end: all closed runs
    leave it at once and the timer moves to the next end, so that a user costs a call for each watermark that closes runs, not
    for each run. The state holds what a user did within the delay of the watermark and the gap. A run that grows by later
    events ends later than its timer, never earlier.
    """

    def __init__(self, gap_micros: int):
        self.gap = gap_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", _OPEN)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        new = sorted(r[-6:] for r in rows if r[-6] is not None)
        if new:
            self.open.appendList(self._packed(new))
            self.handle.registerTimer(self._end(self._runs(new)[0]))
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        events, now = sorted(e for (part,) in self.open.get() for e in json.loads(part)), timerValues.getCurrentWatermarkInMs()
        runs = self._runs(events)
        closed = [run for run in runs if self._end(run) <= now]
        left = events[sum(map(len, closed)) :]
        if left and closed:
            self.open.put(self._packed(left))
        elif closed:
            self.open.clear()
        if left:
            self.handle.registerTimer(self._end(runs[len(closed)]))
        for run in closed:
            yield self._closed(key, run)

    def close(self) -> None:
        pass

    @staticmethod
    def _packed(events: list) -> list[tuple[str]]:
        return [(json.dumps(events[low : low + _EVENTS_A_ROW]),) for low in range(0, len(events), _EVENTS_A_ROW)]

    def _end(self, run: list) -> int:
        return -(-(run[-1][0] + self.gap) // 1000)

    def _runs(self, events: list) -> list[list]:
        cuts = [i for i, (a, b) in enumerate(pairwise(events), 1) if b[0] - a[0] >= self.gap]
        return [events[a:b] for a, b in pairwise([0, *cuts, len(events)]) if a < b]

    @staticmethod
    def _closed(key: tuple, run: list) -> Row:
        answers = [e for e in run if e[4]]
        failures = [e[3] for e in run if e[3] is not None]
        return Row(
            user_id=key[0], start=run[0][0], stop=run[-1][0], type="final" if answers else "error", final_node=answers[-1][2] if answers else None,
            message=None if answers else (failures[-1] if failures else NO_ANSWER), steps=[e[2] for e in run], tool_calls=sum(e[5] for e in run),
        )


def run_final_stream(events: DataFrame, gap_minutes: int = GAP_MINUTES, delay: str = DELAY) -> DataFrame:
    """Exactly one ``final`` or ``error`` row for each run, when the watermark has passed its end.

    For streams of a ``stream_session``. A run that answered is ``final``, with the last terminal node; one that never did is
    ``error``, with the last message of its events or, if none has one, ``NO_ANSWER``. The row has the run's steps in order of time and event, elapsed
    time and tool calls. Events without a time are left out. The state of a user is the events of the last ``delay`` and gap; timers close
    runs whether or not the user ever comes back.
    """
    timed = events.select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("bigint").alias("user_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"),
        "event_id", "node", "message", is_terminal().alias("terminal"), (~is_terminal() & tool_of().isNotNull()).alias("tool"))
    rows = timed.withWatermark("ts", delay).groupBy("user_id").transformWithState(
        _OpenRuns(gap_minutes * 60_000_000), T.StructType.fromDDL(_CLOSED), "append", "EventTime")
    return rows.select(
        "user_id", F.timestamp_micros("start").alias("run_start"), "type", "final_node", "message", "steps",
        F.floor((F.col("stop") - F.col("start")) / 1000).alias("elapsed_ms"), "tool_calls")


def run_metrics_stream(events: DataFrame, width: str = "1 day", delay: str = DELAY, delivered_once: bool = True) -> DataFrame:
    """Live event counts and error rates per time window and node kind.

    ``delivered_once=False`` drops events whose ``event_id`` came before. Ids are held for ``delay`` of event time after their event, which
    is as long as a second delivery can come without being late itself.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    if not delivered_once:
        timed = timed.dropDuplicatesWithinWatermark(["event_id"])
    return (
        timed.groupBy(F.window("ts", width).alias("w"), kind_of().alias("kind"))
        .agg(
            F.count(F.lit(1)).alias("n_events"),
            F.count_if(step_status() == "error").alias("n_errors"),
        )
        .select(
            F.col("w.start").alias("window_start"), "kind", "n_events", "n_errors",
            F.round(F.col("n_errors") / F.col("n_events"), 4).alias("error_rate"),
        )
    )


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Append-mode stream worked off to parquet; what it emitted, as a batch."""
    q = stream.writeStream.format("parquet").outputMode("append").option("path", path).option(
        "checkpointLocation", checkpoint
    ).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_updates_to_end(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> DataFrame:
    """Update-mode stream worked off; the last state of every key, as a batch.

    Each micro-batch overwrites its own folder, so a repeated one changes nothing.
    """
    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    q = stream.writeStream.foreachBatch(store).outputMode("update").option(
        "checkpointLocation", checkpoint
    ).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = stream.sparkSession.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(path)
    others = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("last")).select(*keys, "last.*")


def read_events(spark: SparkSession, schema, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Parquet file or folder as a stream, oldest files first.

    A stream takes a plain path for a folder only, so the last name is given as a pattern
    that matches just itself.
    """
    folder, name = path.rstrip("/").rsplit("/", 1)
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{folder}/[{name[0]}]{name[1:]}")
