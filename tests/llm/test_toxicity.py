"""Nearest labelled examples against plain cosines over every example, and held-out accuracy."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from brute import SMALL_TABLES, frame, prose

from tablescout.llm import toxicity
from tablescout.llm.toxicity import Index, examples, scored, terms_of

HELD = "crc32(cast(doc_id AS string)) % 3 = 1"
LABELS = "doc_id long, toxic int"


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 1


def fixture(n=400):
    rng, rows, labels = random.Random(5), [], []
    for i in range(n):
        bad = i % 5 == 0
        words = prose(i, 40 + i % 90).split()
        for _ in range(rng.randrange(2, 5) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["zorgish", "blatverd", "Zorgishly", "MUPP"]))
        rows.append((i, " ".join(words)))
        if i % 3 != 2:
            labels.append((i, int(bad)))
    return rows, labels


@pytest.mark.parametrize("seed", range(6))
def test_index_finds_the_nearest(seed):
    rng = np.random.default_rng(seed)
    terms, vectors = 30, []
    for _ in range(500):
        t = np.sort(rng.choice(terms, rng.integers(0, 7), replace=False))
        w = rng.integers(1, 4, len(t)).astype(float)
        vectors.append((t, w / max(np.sqrt((w * w).sum()), 1e-9)))
    index = Index(vectors, terms, block=16)
    dense = np.zeros((500, terms))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    read = 0
    for q in range(0, 500, 9):
        t, w = vectors[q]
        without = np.array([q, (q * 7) % 500]) if q % 2 else None
        cos = np.round(dense[:, t] @ w, toxicity.DIGITS)
        if without is not None:
            cos[without] = 0
        want = sorted((-c, i) for i, c in enumerate(cos) if c > 0)[:15]
        index.looked = 0
        numbers, cosines = index.nearest(t, w, 15, without)
        read += index.looked
        assert numbers.tolist() == [i for _, i in want]
        assert cosines.tolist() == [-c for c, _ in want]
    assert read < 0.9 * 56 * (500 // 16 + 1)


def plain_terms(text):
    words = re.findall(r"[a-z0-9\x80-\U0010FFFF]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))
    out = Counter(w.encode() for w in words)
    out.update(b"*" + w.encode()[:6] for w in words if len(w.encode()) > 6)
    if words:
        out[b"*"] = len(words)
    return out


def plain_scores(rows, labels):
    """Vocabulary, frequencies, cosines and votes with loops over dictionaries; the curve is fitted by gradient."""
    marks = {}
    for i, toxic in labels:
        if toxic in (0, 1):
            marks[i] = max(toxic, marks.get(i, 0))
    known = {i: t for i, t in rows if i in marks and not held(i)}
    count = {0: Counter(), 1: Counter()}
    for i, t in known.items():
        count[marks[i]].update(set(plain_terms(t)))
    n, bad = len(known), sum(marks[i] for i in known)
    good, vocabulary = n - bad, {b"*"}
    for term in count[0] | count[1]:
        a, b = count[1][term], count[0][term]
        if 3 <= a + b < n and max(abs(a * good - b * bad) - n / 2, 0) ** 2 * n / ((a + b) * (n - a - b) * good * bad) >= 15:
            vocabulary.add(term)
    frequency = Counter(t for _, text in rows for t in set(plain_terms(text)) & vocabulary)
    idf = {t: math.log((len(rows) + 1) / (frequency[t] + 1)) + 1 for t in vocabulary}

    def unit(text):
        v = {t: (1 + math.log(c)) * idf[t] for t, c in plain_terms(text).items() if t in vocabulary}
        size = math.sqrt(sum(x * x for x in v.values())) or 1
        return {t: x / size for t, x in v.items()}

    ids = sorted(known)
    vectors = {i: unit(known[i]) for i in ids}
    base = bad / n

    def vote(v, text=None):
        cos = sorted((-round(sum(x * vectors[i].get(t, 0) for t, x in v.items()), 8), -marks[i], i) for i in ids if text is None or known[i] != text)
        best = [(-c, -m) for c, m, _ in cos[:15] if c < 0]
        return (sum(c * m for c, m in best) + base) / (sum(c for c, _ in best) + 1), max((c for c, _ in best), default=0.0), cos[:16]

    return vote, unit, known, marks


def test_vocabulary_frequencies_and_votes(spark):
    rows, labels = fixture()
    vote, unit, known, marks = plain_scores(rows, labels)
    docs = frame(spark, rows)
    built = examples(docs, docs.where(f"not {HELD}"), frame(spark, labels, LABELS))
    for i, text in rows[::7]:
        v = unit(text)
        terms, weights = built.vector((text or "").encode())
        names = list(built.number)
        assert {names[t]: pytest.approx(w, abs=1e-12) for t, w in zip(terms, weights)} == v
        numbers, cosines = built.index.nearest(terms, weights, 15)
        share, nearest, around = vote(v)
        assert [round(c, 8) for c in cosines.tolist()] == [-c for c, _, _ in around[:15]]
        if around[14][0] != around[15][0]:  # no tie at the last neighbour
            assert built.features(numbers, cosines) == (pytest.approx(share, abs=1e-6), pytest.approx(nearest, abs=1e-6))
    want = [vote(unit(text), text) for text in known.values()]
    curve = toxicity.fitted_curve(np.array([w[0] for w in want]), np.array([w[1] for w in want]), np.array([marks[i] for i in known], float))
    assert np.allclose(curve, built.curve, atol=0.35)


def test_planted_words_are_caught(spark):
    rows, labels = fixture()
    got = {r.doc_id: r for r in scored(frame(spark, rows), frame(spark, labels, LABELS), HELD).collect()}
    assert len(got) == len(rows)
    judged = [(got[i].predicted, i % 5 == 0) for i in got if held(i)]
    assert sum(p and t for p, t in judged) >= 0.9 * sum(t for _, t in judged)
    assert sum(p and not t for p, t in judged) <= 0.02 * len(judged)
    assert all(got[i].held_out == held(i) and 0 <= got[i].score <= 1 and got[i].predicted == (got[i].score >= 0.7) for i in got)
    caught = next(r for r in got.values() if r.predicted and r.held_out)
    assert all(i % 5 == 0 for i in caught.evidence[:1]) and len(caught.evidence) == 3
    assert any(t.strip("*").startswith(("zorg", "blat", "mupp")) for t in caught.evidence_terms)


def test_labels_of_held_out_rows_change_nothing(spark):
    rows, labels = fixture(200)
    docs = frame(spark, rows)
    flipped = [(i, 1 - t if held(i) else t) for i, t in labels]
    one, other = (sorted(map(tuple, scored(docs, frame(spark, x, LABELS), HELD).collect()), key=repr) for x in (labels, flipped))
    assert one == other


def test_awkward_rows(spark):
    rows, labels = fixture(200)
    more = [(None, "zorgish blatverd mupp"), (None, None), (1000, None), (1001, ""), (1002, " \n"), (1003, "zorgish " * 100_000), (0, rows[0][1]), (0, rows[0][1]), (1004, "ÉÉ 12")]
    marks = [*labels, (1000, 1), (1001, 0), (0, 0), (1003, None), (None, 1), (1002, 7)]
    names = "doc_id long, text string, toxic string, place long, copy string"
    df = frame(spark, [(*r, "x", 1, None) for r in rows + more], names)
    got = scored(df, frame(spark, marks, LABELS), HELD).collect()
    assert len(got) == len(rows) + len(more)
    empty = {r.score for r in got if r.doc_id in (1000, 1001, 1002) or (r.doc_id is None and not r.evidence)}
    assert len(empty) == 1
    assert len({(r.score, tuple(r.evidence)) for r in got if r.doc_id == 0}) == 1


@pytest.mark.parametrize("labels", [[], [(1, 0), (2, 0)], [(1, None)]])
def test_nothing_to_learn(spark, labels):
    got = scored(frame(spark, [(1, "a b"), (2, None), (3, "c")]), frame(spark, labels, LABELS), HELD).collect()
    assert [(r.score, r.predicted, r.evidence) for r in got] == [(0.0, 0, [])] * 3


def test_empty_table(spark):
    assert scored(frame(spark, []), frame(spark, [], LABELS), HELD).collect() == []


def test_terms():
    assert terms_of("Réeuxment, anon! ANON".encode()) == {"réeuxment".encode(): 1, b"anon": 2, b"*": 3, b"*" + "réeux".encode(): 1}
    assert terms_of(b" .,") == {}


def test_held_out_rows_of_the_given_tables(spark):
    d = SMALL_TABLES.replace("sf0.001", "sf0.1")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = scored(spark.read.parquet(f"{d}/documents.parquet"), labels, HELD).join(labels, "doc_id").where("held_out").toPandas()
    toxic = got[got.toxic == 1]
    assert toxic.predicted.mean() >= 0.85
    assert got[got.toxic == 0].predicted.mean() <= 0.01
