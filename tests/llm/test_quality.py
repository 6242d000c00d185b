import numpy as np
import pytest
from brute import WORD, frame, prose

from tablescout.llm.quality import COUNTS, FEATURES, good_documents, quality_report
from tablescout.llm.trees import Trees, grown


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated)


def failed(c):
    return c[0] < 50 or 100 * c[4] > 50 * c[0]


ROWS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "a\na\na\n\n \n \nb"), (5, "a b c a b c a b"), (6, "é è|<é> # \x0b x\x1cy"), (7, prose(1, 49)), (8, prose(1, 50)),
    (9, "\n".join([prose(2, 12)] * 30)), (10, prose(3, 400)), (10, prose(3, 400)), (None, prose(4, 80)), (11, "x x x x x"), (12, "w " * 300),
    (13, "line \nline\nline \n" + prose(5, 60)), (14, "    " + prose(6, 3000)),
]


def test_counts_and_rules(spark):
    labels = frame(spark, [], "doc_id long, quality int, toxic int")
    got = sorted((tuple(r)[:7] for r in quality_report(frame(spark, ROWS), labels).collect()), key=repr)
    assert got == sorted(((i, *counts(t), failed(counts(t))) for i, t in ROWS), key=repr)


def test_without_labels_the_rules_decide(spark):
    labels = frame(spark, [(8, 1), (10, None), (None, 0), (9, 7)], "doc_id long, quality int")
    assert all(r.kept != r.base_failed for r in quality_report(frame(spark, ROWS), labels).collect())


def test_held_out_labels(spark, sf_dir):
    sf_dir = sf_dir.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    report = {r.doc_id: r for r in quality_report(docs, labels.where("doc_id % 2 = 0")).collect()}
    assert [tuple(report[d.doc_id][c] for c in COUNTS) for d in docs.collect()] == [counts(d.text) for d in docs.collect()]
    rest = [(report[r.doc_id], r.quality) for r in labels.where("doc_id % 2 = 1").collect()]
    good, bad = [r for r, q in rest if q], [r for r, q in rest if not q]
    assert np.mean([r.kept or r.base_failed for r in good]) >= 0.97
    assert np.mean([r.kept for r in bad]) <= 0.2


def test_filter_keeps_rows_as_they_are(spark):
    docs = frame(spark, [(i, t, "n", i) for i, t in ROWS], "doc_id long, text string, n_words string, doc int")
    labels = frame(spark, [], "doc_id long, quality int")
    got = sorted(map(tuple, good_documents(docs, labels).collect()), key=repr)
    assert got == sorted(((i, t, "n", i) for i, t in ROWS if not failed(counts(t))), key=repr)
    assert good_documents(docs.limit(0), labels).collect() == []


def test_trees_follow_the_data_and_the_constraints():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 4))
    y = (rng.random(3000) < 1 / (1 + np.exp(-(2 * x[:, 0] - 3 * np.abs(x[:, 1]) + np.sin(4 * x[:, 2]))))).astype(float)
    trees = grown(x, y, np.array([1, 0, -1, 0]))
    p = trees.probability(x)
    assert np.mean((p > 0.5) == y) > 0.8
    grid = np.linspace(-3, 3, 200)
    for row in x[:50]:
        for feature, sign in ((0, 1), (2, -1)):
            line = np.repeat(row[None], 200, 0)
            line[:, feature] = grid
            assert (sign * np.diff(trees.logit(line)) >= -1e-9).all()


def test_scoring_equals_walking_the_nodes():
    rng = np.random.default_rng(4)
    trees = Trees(rng.integers(0, 3, (5, 7)), rng.normal(size=(5, 7)), rng.normal(size=(5, 8)), 0.3)
    x = rng.normal(size=(40, 3))
    for row, got in zip(x, trees.logit(x)):
        total = 0.3
        for f, c, leaf in zip(trees.feature, trees.cut, trees.leaf):
            node = 0
            while node < 7:
                node = 2 * node + (2 if row[f[node]] > c[node] else 1)
            total += leaf[node - 7]
        assert got == pytest.approx(total)


def test_signs_cover_known_features():
    assert set(FEATURES.values()) == {0, -1}
