"""Conversation repair against a plain dynamic program that keeps whole audits."""

import hashlib
import random
import re
import zlib

import pytest
from brute import frame, prose

from tablescout.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
EMPTY = hashlib.sha256(b"").hexdigest()


def plain(rows):
    """All rows of one conversation, one by one: every (cost, audit, lines) worth keeping for each state."""
    damaged = []
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        damaged += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    damaged.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    count, seen, faults = {"blank": 0, "duplicate": 0, "truncated": 0}, set(), []
    for _, role, text in damaged:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
        seen.add((role, text))
        faults.append(fault)
        if fault:
            count[fault] += 1
    turns = [t for t, _, _ in damaged if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(damaged, damaged[1:]))
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    states = {"": (0, "", [])}

    def with_inserts(states):
        out = dict(states)
        for _ in range(3):
            for s, (c, a, lines) in list(out.items()):
                t = after[s][-1]
                new = (c + 5, a + "I", [*lines, {"u": "user:", "a": "assistant:"}[t]])
                out[t] = min(out.get(t, new), new)
        return out

    for (_, role, text), fault in zip(damaged, faults):
        new = {}
        for s, (c, a, lines) in with_inserts(states).items():
            ways = [(s, 2, "D", [])]
            if fault not in ("blank", "duplicate"):
                more = 5 if fault else 0
                t = after[s][-1]
                ways.append((t, 1 + more, "R", [{"u": "user", "a": "assistant"}[t] + ":" + text]))
                if role[:1] and role[:1] in after[s]:
                    ways.append((role[:1], more, "K", [f"{role}:{text}"]))
            for t, price, edit, line in ways:
                way = (c + price, a + edit, lines + line)
                new[t] = min(new.get(t, way), way)
        states = new
    cost, audit, lines = min(w for s, w in with_inserts(states).items() if s in ("", "a"))
    return (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def expected(rows):
    convs = {}
    for r in rows:
        convs.setdefault(r[0], []).append(r)
    return sorted(((c, *plain(own)) for c, own in convs.items()), key=repr)


def got(df):
    return sorted((tuple(r) for r in repair.repaired(df).collect()), key=repr)


def random_rows(seed, conversations, turns):
    rng = random.Random(seed)
    rows = []
    for c in range(conversations):
        said = [prose(rng.randrange(40), 3) + rng.choice([".", "!", "", " ", "?\n"]) for _ in range(4)]
        for t in range(rng.randrange(1, turns)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "User", None])
            text = rng.choice([*said, prose(rng.randrange(10**6), 4) + ".", prose(rng.randrange(10**6), 4) + ".", "", " \t", None])
            rows.append((rng.choice([c, c, c, c, c, c, None]) if seed == 3 else c, rng.choice([t, t, t, t + 5, None, 0]), role, text))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_every_conversation(spark, seed):
    rows = random_rows(seed, 60, 14)
    assert got(frame(spark, rows, SCHEMA)) == expected(rows)


@pytest.mark.parametrize("rows", [3, 1])
def test_cut_into_stretches(spark, monkeypatch, rows):
    monkeypatch.setattr(repair, "STRETCH_ROWS", rows)
    given = random_rows(4, 25, 40)
    assert got(frame(spark, given, SCHEMA)) == expected(given)


def test_table_of_the_smallest_size(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert got(df) == expected(rows)


def test_one_long_conversation_and_many_copies(spark):
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), prose(rng.randrange(3000), 3) + rng.choice([".", ".", ""])) for t in range(6000)]
    rows += [(2, 7, "user", "again.")] * 5000 + [(2, 8, "assistant", "again.")]
    assert got(frame(spark, rows, SCHEMA)) == expected(rows)


def test_nothing_left_and_empty_tables(spark):
    turn = next(t for t in range(200) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    assert got(frame(spark, [(5, turn, "user", "Hi.")], SCHEMA)) == [(5, 0, 0, 0, 0, 0, 0, "", EMPTY)]
    assert got(frame(spark, [], SCHEMA)) == []


def test_clashing_columns_and_very_long_texts(spark):
    text = prose(3, 200_000)
    rows = [(1, 0, "user", text + "?", 1, "x"), (1, 1, "assistant", text, 2, None), (1, 2, "assistant", text + ".", None, "y")]
    names = ["copies long", "audit string"]
    df = frame(spark, rows, ", ".join([SCHEMA, *names]))
    assert got(df) == expected([r[:4] for r in rows])
    assert got(df.withColumnsRenamed({"copies": "h1", "audit": "whole"})) == expected([r[:4] for r in rows])


def test_least_audit_by_trying_all():
    """Short symbol strings against every sequence of edits."""
    def walks(symbols, state, cost, audit, inserts):
        if not symbols:
            if state in (0, 3):
                yield cost, audit
        else:
            yield from walks(symbols[1:], state, cost + 2, audit + "D", 0)
            if symbols[0] != "x":
                more = 5 if symbols[0].isupper() else 0
                yield from walks(symbols[1:], repair._TURN[state], cost + 1 + more, audit + "R", 0)
                kept = repair._NEXT.get(symbols[0].lower(), {}).get(state)
                if kept is not None:
                    yield from walks(symbols[1:], kept, cost + more, audit + "K", 0)
        if inserts < 2:
            yield from walks(symbols, repair._TURN[state], cost + 5, audit + "I", inserts + 1)

    rng = random.Random(1)
    for _ in range(60):
        symbols = "".join(rng.choice("suaoUAx") for _ in range(rng.randrange(6)))
        assert repair.solved(symbols) == min(walks(symbols, 0, 0, "", 0))
