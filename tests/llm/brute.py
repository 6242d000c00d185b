"""Plain versions of the operators, and small tables that hold the awkward cases."""

import re

SMALL_TABLES = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
GOLDEN = "the quick brown fox jumps over the lazy dog and runs away from every hunter in the green wood "


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def prose(seed, n):
    """n words of invented prose, the same for a seed."""
    out, state = [], seed * 2654435761 % 2**32 or 1
    for _ in range(n):
        state = (1103515245 * state + 12345) % 2**31
        out.append("".join("aeioukmnprst"[(state >> s) % 12] for s in (4, 8, 12, 16, 20)[: 2 + state % 4]))
    return " ".join(out)


def components(nodes, linked):
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}
