"""Repair of damaged conversations by Hirschberg's divide and conquer over four states.

A repaired conversation is a walk through four states: nothing yet, after a system turn, after a user turn, after an
assistant turn. Every row is a *step table*: which states it leads to from each state, at what cost, by which edits.
Forward costs from the first row and backward costs from the last one meet in the middle; the cheapest crossing, and of
several the one with the ASCII-least edits before it, splits the walk in two, and each half is solved alike. Only cost
vectors of four numbers and the crossings are held.

The costs of a stretch of rows from each state to each other are a step table too. So a conversation of any length
is cut into stretches, each turned into a table by the task that holds it; the same procedure over the tables gives
the crossings between stretches, and the tasks then solve their stretches independently.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tablescout.llm.common import removed, written

STRETCH_ROWS, STRETCH_BYTES = 1 << 15, 4 << 20
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
KNOWN = 50_000

# States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.
_NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
_TURN = {0: 2, 1: 2, 2: 3, 3: 2}  # where an inserted or re-roled turn leads
_ROLE = {2: "user", 3: "assistant"}
_LEGAL = {"su", "ua", "au"}

Table = list[list[tuple[int, int, int]]]  # for each state: (next state, cost, place of the edits in ASCII order)


def _moves(symbol: str) -> list[dict[int, tuple[int, str]]]:
    """Cheapest (cost, edits) from each state to each other over one row: inserts, then what happens to the row.

    Symbols: the initial of the role if legal, else ``o``, in upper case if the row is truncated; ``x`` for rows
    that must go; ``$`` for the end of the conversation.
    """
    out = []
    for start in range(4):
        best: dict[int, tuple[int, str]] = {}
        state, cost, edits = start, 0, ""
        for _ in range(3):
            ways = []
            if symbol == "$":
                ways = [(state, 0, "")] if state in (0, 3) else []
            else:
                ways.append((state, DELETE, "D"))
                if symbol != "x":
                    more = TRUNCATED if symbol.isupper() else 0
                    ways.append((_TURN[state], REROLE + more, "R"))
                    kept = _NEXT.get(symbol.lower(), {}).get(state)
                    if kept is not None:
                        ways.append((kept, more, "K"))
            for end, price, edit in ways:
                best[end] = min(best.get(end, (1 << 60, "")), (cost + price, edits + edit))
            state, cost, edits = _TURN[state], cost + INSERT, edits + "I"
        out.append(best)
    return out


def _table(moves: list[dict[int, tuple[int, str]]]) -> Table:
    table = []
    for best in moves:
        order = sorted(e for _, e in best.values())
        table.append([(q, c, order.index(e)) for q, (c, e) in best.items()])
    return table


MOVES = {s: _moves(s) for s in "suaoSUAOx$"}
TABLES = {s: _table(m) for s, m in MOVES.items()}


def _forward(tables, vector: dict[int, tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """Per state (cost, place in ASCII order of the edits that lead there), after the tables.

    Edits up to the same row never begin with one another, so they are ordered by the walk before the last step, and
    by that step where the walks are the same.
    """
    for table in tables:
        new: dict[int, tuple[int, int, int]] = {}
        for p, (cost, rank) in vector.items():
            for q, price, place in table[p]:
                key = (cost + price, rank, place)
                if q not in new or key < new[q]:
                    new[q] = key
        order = sorted((rank, place) for _, rank, place in new.values())
        vector = {q: (c, order.index((r, o))) for q, (c, r, o) in new.items()}
    return vector


def _backward(tables, costs: dict[int, int]) -> dict[int, int]:
    for table in reversed(tables):
        costs = {p: min(c + costs[q] for q, c, _ in table[p] if q in costs) for p in range(4) if any(q in costs for q, _, _ in table[p])}
    return costs


def crossings(tables: list[Table], start: int, end: int) -> list[int]:
    """States before, between and after the tables on the cheapest walk, ASCII-least edits first among equals."""
    states = [start] * len(tables) + [end]
    open_ = [(0, len(tables))]
    while open_:
        low, high = open_.pop()
        if high - low < 2:
            continue
        middle = (low + high) // 2
        ahead = _forward(tables[low:middle], {states[low]: (0, 0)})
        behind = _backward(tables[middle:high], {states[high]: 0})
        states[middle] = min((c + behind[s], rank, s) for s, (c, rank) in ahead.items() if s in behind)[2]
        open_ += [(low, middle), (middle, high)]
    return states


def _last(tables: list[Table]) -> tuple[int, int]:
    """Cost of the cheapest walk from the start and the state it ends in."""
    cost, _, state = min((c, rank, s) for s, (c, rank) in _forward(tables, {0: (0, 0)}).items())
    return cost, state


def edits(symbols: str, start: int, end: int) -> str:
    """The audit of a stretch of rows between two states."""
    states = crossings([TABLES[s] for s in symbols], start, end)
    return "".join(MOVES[s][p][q][1] for s, p, q in zip(symbols, states, states[1:]))


def solved(symbols: str) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    symbols += "$"
    cost, end = _last([TABLES[s] for s in symbols])
    return cost, edits(symbols, 0, end)


def _stretch_table(symbols: str) -> tuple[list[int], list[int]]:
    """Costs (-1: no way) and places from each state to each other over a stretch, flattened."""
    costs, places = [-1] * 16, [0] * 16
    tables = [TABLES[s] for s in symbols]
    for p in range(4):
        for q, (c, rank) in _forward(tables, {p: (0, 0)}).items():
            costs[4 * p + q], places[4 * p + q] = c, rank
    return costs, places


def _unflattened(costs: list[int], places: list[int]) -> Table:
    return [[(q, costs[4 * p + q], places[4 * p + q]) for q in range(4) if costs[4 * p + q] >= 0] for p in range(4)]


def _repaired(symbols: str, roles: list[str], texts: list[str], audit: str, state: int) -> str | None:
    """``role:text`` lines after the edits; None if no row is left. Roles and texts are those of rows other than ``x``."""
    lines, row, kept = [], 0, 0
    for edit in audit:
        if edit == "I":
            state = _TURN[state]
            lines.append(_ROLE[state] + ":")
            continue
        symbol = symbols[row]
        row += 1
        if edit == "K":
            state = _NEXT[symbol.lower()][state]
            lines.append(f"{roles[kept]}:{texts[kept]}")
        elif edit == "R":
            state = _TURN[state]
            lines.append(f"{_ROLE[state]}:{texts[kept]}")
        kept += symbol != "x"
    return "\n".join(lines) if lines else None


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows ``conv_id, turn, role, text, copies`` after damage by a checksum of conversation and turn, equal rows as one.

    Of every 20 checksums 0 drops the row, 1 empties its text, 2 takes its full stops, exclamation and question marks, 3 repeats it, 4 makes
    its role user. Nulls are one space in the checksum, in roles and in texts. Dropped rows stay as a mark of their
    conversation (no copies).
    """
    def space(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    given = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), fault.alias("fault"))
    gone = F.col("fault") == 0
    rows = given.select(
        "conv_id", F.when(~gone, F.col("turn")).alias("turn"),
        F.when(gone, "").when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(gone | (F.col("fault") == 1), "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(gone, 0).when(F.col("fault") == 3, 2).otherwise(1).alias("copies"))
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))


def _judged(rows: DataFrame) -> DataFrame:
    """Rows with ``blank``, ``cut`` (truncated) and ``first`` (no equal role and text in an earlier turn of its conversation)."""
    keys = [F.xxhash64("conv_id", "role", "text").alias("h1"), F.xxhash64(F.lit(7), "text", "role", "conv_id").alias("h2")]
    seen = rows.where("copies > 0").select(*keys, "turn").groupBy("h1", "h2").agg(
        F.count("*").alias("n"), F.min("turn").alias("least"), F.bool_or(F.col("turn").isNull()).alias("unplaced"))
    seen = seen.where("n > 1").drop("n")
    out = rows.select("*", *keys).join(seen, ["h1", "h2"], "left")
    return out.select(
        "conv_id", "turn", "role", "text", "copies",
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut"),
        (F.col("unplaced").isNull() | F.col("turn").isNull() | (~F.col("unplaced") & (F.col("turn") == F.col("least")))).alias("first"))


_COUNTS = ["blank", "duplicate", "truncated", "illegal"]
_RESULT = ["gaps", *_COUNTS, "cost", "audit", "repaired_sha256"]
_RESULT_TYPES = "gaps long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", cost long, audit string, repaired_sha256 string"
_STRETCH_TYPES = ("part long, seq long, whole boolean, low long, high long, turns long, opening string, closing string, symbols string, "
                  "roles array<string>, texts array<string>, costs array<long>, places array<long>")


class _Stretch:
    """Rows of one conversation that follow each other, as far as read."""

    def __init__(self):
        self.symbols, self.roles, self.texts, self.bytes = [], [], [], 0
        self.low = self.high = self.opening = self.closing = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn, role: str, text: str, copies: int, blank: bool, cut: bool, first: bool) -> None:
        initial = role[:1]
        if self.closing is None:
            self.opening = initial
        else:
            self.illegal += self.closing + initial not in _LEGAL
        self.closing = initial
        self.illegal += copies - 1
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        if blank:
            self.blank += copies
        else:
            self.duplicate += copies - first
        if blank or not first:
            self.symbols.append("x" * copies)
            return
        self.truncated += cut
        symbol = initial if initial and initial in "sua" else "o"
        self.symbols.append((symbol.upper() if cut else symbol) + "x" * (copies - 1))
        self.roles.append(role)
        self.texts.append(text)
        self.bytes += len(text) + len(role)

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def _batch(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def _stretches(schema: pa.Schema):
    """Sorted rows to one row for each whole conversation, or for each stretch of one that may go on beyond the task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, known = TaskContext.get().partitionId(), 0, {}
        out, held, opened = [], 0, False
        now, conv, border = None, None, True

        def closed(whole: bool) -> None:
            nonlocal seq, held
            symbols = "".join(now.symbols)
            row = {"conv_id": conv, "part": part, "seq": seq, "whole": whole, **{c: getattr(now, c) for c in _COUNTS}}
            seq += 1
            if whole:
                if symbols not in known:
                    if len(known) >= KNOWN:
                        known.clear()
                    known[symbols] = solved(symbols)
                row["cost"], row["audit"] = known[symbols]
                left = _repaired(symbols, now.roles, now.texts, row["audit"], 0)
                row |= {"gaps": now.gaps(), "repaired_sha256": hashlib.sha256((left or "").encode()).hexdigest()}
            else:
                costs, places = _stretch_table(symbols)
                row |= {"symbols": symbols, "costs": costs, "places": places,
                        **{n: getattr(now, n) for n in ("low", "high", "turns", "opening", "closing", "roles", "texts")}}
                held += now.bytes
            held += len(symbols) + 200
            out.append(row)

        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "copies", "blank", "cut", "first")]
            for key, turn, role, text, copies, blank, cut, first in zip(*columns):
                if not opened or key != conv:
                    if opened:
                        closed(not border)
                        border = False
                    now, conv, opened = _Stretch(), key, True
                while copies:
                    few = min(copies, STRETCH_ROWS)
                    now.add(turn, role, text, few, blank, cut, first)
                    copies, first = copies - few, False
                    if now.bytes >= STRETCH_BYTES or len(now.symbols) >= STRETCH_ROWS or few == STRETCH_ROWS:
                        closed(False)
                        border, now = True, _Stretch()
                if held >= STRETCH_BYTES:
                    yield _batch(schema, out)
                    out, held = [], 0
        if opened:
            closed(False)
        if out:
            yield _batch(schema, out)

    return run


def _crossed(schema: pa.Schema):
    """The stretches of one conversation to the states they lie between; totals of the conversation on the last one."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("part", "ascending"), ("seq", "ascending")]).to_pylist()
        tables = [_unflattened(r["costs"], r["places"]) for r in rows] + [TABLES["$"]]
        cost, end = _last(tables)
        states = crossings(tables, 0, end)
        total = {c: sum(r[c] for r in rows) for c in _COUNTS}
        placed = [r for r in rows if r["low"] is not None]
        turns = sum(r["turns"] for r in placed) - sum(a["high"] == b["low"] for a, b in zip(placed, placed[1:]))
        gaps = placed[-1]["high"] - placed[0]["low"] + 1 - turns if placed else 0
        filled = [r for r in rows if r["closing"] is not None]
        total["illegal"] += sum(a["closing"] + b["opening"] not in _LEGAL for a, b in zip(filled, filled[1:]))
        out = [{"conv_id": r["conv_id"], "part": r["part"], "seq": r["seq"], "start": p, "end": q} for r, p, q in zip(rows, states, states[1:])]
        out[-1] |= {"tail": end, "gaps": gaps, "cost": cost, **total}
        return pa.Table.from_batches([_batch(schema, out)])

    return run


_TOTALS = "gaps long, cost long, " + ", ".join(f"{c} long" for c in _COUNTS)
_CROSSED = f"part long, seq long, start int, end int, tail int, {_TOTALS}"
_PIECES = f"part long, seq long, piece_audit string, piece string, {_TOTALS}"


def _pieces(schema: pa.Schema):
    """Each stretch solved between its two states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                audit = edits(row["symbols"], row["start"], row["end"])
                if row["tail"] is not None:
                    audit += MOVES["$"][row["end"]][row["tail"]][1]
                piece = _repaired(row["symbols"], row["roles"], row["texts"], audit, row["start"])
                yield _batch(schema, [row | {"piece_audit": audit, "piece": piece}])

    return run


def _assembled(schema: pa.Schema):
    """Sorted pieces to one row for each conversation; texts go through the hash one piece at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, sha, empty = [], hashlib.sha256(), True
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                audit.append(row["piece_audit"])
                if row["piece"] is not None:
                    sha.update(("" if empty else "\n").encode() + row["piece"].encode())
                    empty = False
                if row["cost"] is not None:  # the last piece of its conversation
                    yield _batch(schema, [row | {"audit": "".join(audit), "repaired_sha256": sha.hexdigest()}])
                    audit, sha, empty = [], hashlib.sha256(), True

    return run


def repaired(conversations: DataFrame) -> DataFrame:
    """Faults of every damaged conversation and its cheapest repair.

    ``conversations(conv_id, turn, role, text)`` is damaged as ``damaged`` tells; further columns are ignored. Rows are taken by turn (nulls first),
    rows of one turn by role and text. Returns one row per ``conv_id`` (null is one too): ``gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256``. Texts are read whole. Conversations without rows after damage have zeros, an empty audit and the
    hash of the empty string; an empty table gives no rows.

    Equal rows are counted before the shuffle and sorted as one, so copies cannot fill a task; conversations are cut where tasks or ``STRETCH_ROWS`` end. The hash of a
    repaired conversation is one value over its whole text, which one task reads piece by piece.
    """
    kind = conversations.schema["conv_id"].dataType.simpleString()

    def kinds(columns: str) -> tuple[pa.Schema, T.StructType]:
        schema = T.StructType.fromDDL(f"conv_id {kind}, {columns}")
        return to_arrow_schema(schema), schema

    rows = written(damaged(conversations.select("conv_id", "turn", "role", "text")))
    order = ["conv_id", "turn", "role", "text"]
    sorted_rows = _judged(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    arrow, schema = kinds(f"{_RESULT_TYPES}, {_STRETCH_TYPES}")
    stretches = written(sorted_rows.mapInArrow(_stretches(arrow), schema))
    removed(rows)
    open_ = stretches.where("not whole")
    crossed = open_.select("conv_id", "part", "seq", "costs", "places", "low", "high", "turns", "opening", "closing", *_COUNTS)
    arrow, schema = kinds(_CROSSED)
    crossed = crossed.groupBy("conv_id").applyInArrow(_crossed(arrow), schema)
    joined = open_.select("part", "seq", "symbols", "roles", "texts").join(crossed, ["part", "seq"])
    arrow, schema = kinds(_PIECES)
    pieces = joined.mapInArrow(_pieces(arrow), schema)
    pieces = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    whole = stretches.where("whole").select("conv_id", *_RESULT)
    arrow, schema = kinds(_RESULT_TYPES)
    return whole.unionByName(pieces.mapInArrow(_assembled(arrow), schema))
