import hashlib
from collections import defaultdict

import pytest
from brute import GOLDEN, WORD, frame, prose

from tablescout.llm import suffixes
from tablescout.llm.suffixes import repeat_report, without_repeats


def report(rows, length):
    """Windows of all texts counted one by one."""
    places = defaultdict(int)
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, t in texts:
        for p in range(len(t) - length + 1):
            places[t[p : p + length]] += 1
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if places[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for p in range(len(t)) if gone[p] and (not p or not gone[p - 1]))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def awkward():
    a, b, c = prose(1, 300), prose(2, 300), prose(3, 250)
    rows = [
        (0, a), (1, a), (2, a[:700] + b[:800]), (3, b), (4, None), (5, ""), (6, "x" * 399), (7, "x" * 400), (8, "x" * 401),
        (9, c + "é" * 600 + c), (10, "ab" * 500), (11, GOLDEN * 30), (12, GOLDEN * 3 + c[:450] + prose(4, 90)),
        (13, a[:650] + "Z" + a[651:]), (14, prose(5, 120) + a[100:501] + prose(6, 120)), (15, prose(7, 120) + a[100:499] + prose(8, 120)),
        (16, a), (16, a), (None, prose(9, 200)), (None, prose(9, 200)), (None, None), (17, c[200:900] + a[50:1000] + c[:777]),
    ]
    rows += [(20 + i, prose(100 + i, 40 + i) + b[i * 7 : 500 + i * 9] + prose(200 + i, 30)) for i in range(30)]
    return rows


def test_every_window_of_every_text(spark):
    rows = awkward()
    got = sorted((tuple(r) for r in repeat_report(frame(spark, rows)).collect()), key=repr)
    assert got == report(rows, 400)


@pytest.mark.parametrize("length", [240, 1000])
def test_other_lengths(spark, length):
    rows = awkward()[:18]
    got = sorted((tuple(r) for r in repeat_report(frame(spark, rows), length).collect()), key=repr)
    assert got == report(rows, length)


def test_table_of_the_smallest_size(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = sorted((tuple(r) for r in repeat_report(docs).collect()), key=repr)
    assert got == report([tuple(r) for r in docs.collect()], 400)


def test_texts_longer_than_a_piece(spark):
    text = prose(1, 250_000)
    rows = [(1, text), (2, prose(2, 90) + "#" + text[400_000:700_000]), (3, "y" * 1_100_000)]
    got = {r.doc_id: r for r in repeat_report(frame(spark, rows)).collect()}
    assert [got[i].n_removed for i in (1, 2, 3)] == [300_000, 300_000, 1_100_000]


def test_empty_table(spark):
    assert repeat_report(frame(spark, [])).collect() == []


def test_cut_texts_keep_columns_and_whole_characters(spark):
    shared = "é" * 300
    rows = [(1, "aa" + shared + "b", "k", 3), (2, "xé" + shared + "cc", None, None), (3, None, "n", 1)]
    docs = frame(spark, rows, "doc_id long, text string, key string, spans int")
    got = sorted(tuple(r) for r in without_repeats(docs).collect())
    assert got == [(1, "aab", "k", 3), (2, "xcc", None, None), (3, None, "n", 1)]


def without_passages(texts, n=50):
    """Windows of n words of all texts counted one by one; words in repeated ones go, with the space between them."""
    words = {i: list(WORD.finditer(t)) for i, t in texts.items()}
    places = defaultdict(int)
    for found in words.values():
        for p in range(len(found) - n + 1):
            places[tuple(w.group() for w in found[p : p + n])] += 1
    out = {}
    for i, t in texts.items():
        found, gone = words[i], set()
        for p in range(len(found) - n + 1):
            if places[tuple(w.group() for w in found[p : p + n])] > 1:
                gone.update(range(p, p + n))
        cut, kept, at = sorted(gone), [], 0
        for k in cut:
            if k - 1 not in gone:
                kept.append(t[at : found[k].start()])
            at = found[k].end()
        out[i] = "".join(kept) + t[at:]
    return out


@pytest.mark.parametrize("words", [50, 24, 131])
def test_every_passage_of_every_text(spark, words):
    parts = [prose(100 + i, k).split() for i, k in enumerate((23, 24, 49, 50, 51, 55, 60, 70, 131, 400))]
    texts = {i: prose(i, 20 + i).replace(" ", " \n" if i % 2 else "  ") + " " + " ".join(parts[i % 10]) + " " + prose(300 + i, i) for i in range(40)}
    texts |= {50: "x " * 49, 51: "y " * 50, 52: "z " * 51, 53: "", 54: " \t", 55: "ab ba " * 200, 56: GOLDEN * 12, 57: "é" * 90 + " " + " ".join(parts[6])}
    df = frame(spark, [(i, t, "k", 7, "s") for i, t in texts.items()], "doc_id long, text string, _key string, _spans int, key string")
    got = suffixes.without_passages(df, words)
    assert got.columns == df.columns
    assert {r.doc_id: r.text for r in got.collect()} == without_passages(texts, words)
    assert {(r._key, r._spans, r.key) for r in got.collect()} == {("k", 7, "s")}


def test_passages_of_nulls_copies_and_very_long_texts(spark):
    long = prose(7, 120_000)
    rows = [(1, None), (None, None), (2, long), (3, "front " + long[300_000:400_000]), (None, prose(8, 60)), (None, prose(8, 60)), (4, prose(9, 60)), (4, prose(9, 60))]
    got = suffixes.without_passages(frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.text or "-") for r in got if r.doc_id not in (2, 3)) == [(0, "-"), (0, "-"), (0, "-"), (1, "-"), (4, "-"), (4, "-")]
    assert next(len(r.text) for r in got if r.doc_id == 3) < 30
    assert suffixes.without_passages(frame(spark, [])).collect() == []


def test_spans_of_clashing_columns(spark):
    shared = prose(1, 300)
    df = frame(spark, [(1, shared + "a", 5, "x"), (2, "b" + shared, 6, None)], "doc_id long, text string, _spans int, _key string")
    assert sorted(map(tuple, without_repeats(df).collect())) == [(1, "a", 5, "x"), (2, "b", 6, None)]
