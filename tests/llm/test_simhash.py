import re

import pytest
import xxhash
from brute import WORD, components, frame, prose

from tablescout.llm.components import connected_components
from tablescout.llm.simhash import ball_links, fingerprints_of, near_duplicates, one_of_each


def fingerprint(text, width=3):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    values = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def expected(rows):
    prints = [(i, fingerprint(t)) for i, t in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a][1] ^ prints[b][1]).bit_count() <= 2]
    root = components(range(len(rows)), pairs)
    least = {}
    for n, r in root.items():
        if rows[n][0] is not None:
            least[r] = min(least.get(r, rows[n][0]), rows[n][0])
    return sorted(((i, f"{p:016x}", least.get(root[n])) for n, (i, p) in enumerate(prints)), key=repr)


def test_awkward_rows(spark):
    long = prose(1, 900)
    words = long.split(" ")
    rows = [
        (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (5, "One Two"), (6, "one  two"), (7, "ÉCOLE é x b c"),
        (8, long), (9, long.upper()), (10, long), (10, long), (None, long), (None, "alone in the world"), (11, "a\x1cb c d e"),
    ]
    rows += [(20 + i, " ".join([*words[: 40 * i], "changed", *words[40 * i + 1 :]])) for i in range(20)]
    rows += [(50 + i, prose(i + 2, i)) for i in range(40)]
    got = sorted((tuple(r) for r in near_duplicates(frame(spark, rows)).collect()), key=repr)
    assert got == expected(rows)


def test_table_of_the_smallest_size(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = sorted((tuple(r) for r in near_duplicates(docs).collect()), key=repr)
    assert got == expected([tuple(r) for r in docs.collect()])


def test_empty_table(spark):
    assert near_duplicates(frame(spark, [])).collect() == []


@pytest.mark.parametrize("width", [1, 2, 5])
def test_other_widths(width):
    texts = [prose(i, i) for i in range(9)]
    got = fingerprints_of([t.encode() for t in texts], width)
    assert [int(g) & (2**64 - 1) for g in got] == [fingerprint(t, width) for t in texts]


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_links_connect_all_within_the_radius(spark, radius):
    values = [0, -1, 1, 3, 7, 15, 31, 2**62, -(2**63), -(2**63) + 5, 1 << 40, (1 << 40) + 6, (1 << 40) + 63]
    pairs = [(a, b) for a in values for b in values if 0 < ((a ^ b) & (2**64 - 1)).bit_count() <= radius]
    links = [tuple(r) for r in ball_links(frame(spark, [(v,) for v in values], "simhash long"), radius).collect()]
    assert components(values, links) == components(values, pairs)
    assert set(links) <= set(pairs)


def test_components_of_a_chain_a_star_and_a_ring(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)]
    links += [(5, 5), (3, 2), (3, 2), (None, 4)]
    got = {r.node: r.component for r in connected_components(frame(spark, links, "a long, b long")).collect()}
    nodes = {n for pair in links for n in pair if n is not None}
    want = components(nodes, [p for p in links if None not in p])
    assert got == {n: c for n, c in want.items() if n != c}


def test_one_row_of_each_group_stays_as_it_is(spark):
    a, b = prose(1, 400), prose(2, 400)
    rows = [(5, a, "x"), (3, a, None), (3, a, None), (9, b, "y"), (None, b, "z"), (None, prose(3, 80), "n"), (7, prose(4, 90), "p"), (7, prose(5, 90), "q")]
    docs = frame(spark, rows, "doc_id long, text string, key string")
    got = sorted((tuple(r) for r in one_of_each(docs).collect()), key=repr)
    assert got == sorted([rows[1], rows[3], *rows[5:]], key=repr)
    assert one_of_each(docs.limit(0)).collect() == []


def test_a_column_called_like_the_key(spark):
    df = frame(spark, [(1, "a b c", "x"), (2, "a b c", "y"), (3, "d", None)], "doc_id long, text string, _key string")
    assert sorted(map(tuple, one_of_each(df).collect())) == [(1, "a b c", "x"), (3, "d", None)]
    assert one_of_each(df.limit(0)).collect() == []
