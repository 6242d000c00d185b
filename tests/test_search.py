import numpy as np
import pytest
from helpers import rows
from pyspark.sql import functions as F

from tablescout.functions.vectors import cosine
from tablescout.operators import nearest
from tablescout.operators import search as S
from tablescout.plans import search_queries as Q
from tablescout.sources import catalog as C


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    corpus = rng.standard_normal((300, 8))
    corpus[100:200] = corpus[100]  # a third of the rows is one vector
    corpus[7] = 0
    return corpus, rng.standard_normal((9, 8))


@pytest.fixture(scope="module")
def frames(spark, vectors):
    corpus, queries = vectors
    c = spark.createDataFrame([(i, [float(x) for x in v], f"t{i}") for i, v in enumerate(corpus)], "id BIGINT, embedding ARRAY<DOUBLE>, tag STRING")
    q = spark.createDataFrame([(f"q{i}", [float(x) for x in v]) for i, v in enumerate(queries)], "qid STRING, vector ARRAY<DOUBLE>")
    return q, c.repartition(5)


def brute(vectors, k):
    corpus, queries = vectors
    unit = corpus / np.maximum(np.linalg.norm(corpus, axis=1, keepdims=True), 1e-300)
    out = set()
    for qi, q in enumerate(queries):
        cos = np.round(unit @ (q / np.linalg.norm(q)), 12)
        out |= {(f"q{qi}", r + 1, int(i)) for r, i in enumerate(np.lexsort((np.arange(len(cos)), -cos))[:k])}
    return out


def found(hits):
    return {(r.qid, r["rank"], r.id) for r in hits.collect()}


@pytest.mark.parametrize("k", [1, 5, 150, 400])
def test_top_k_is_exact(frames, vectors, k):
    assert found(S.vector_top_k(*frames, k=k, keep=["tag"])) == brute(vectors, k)


@pytest.mark.parametrize(("numbers", "cells"), [(400, None), (400, 1), (10**6, 7), (10**6, 40), (64, 200)])
def test_large_sides_go_by_cells_and_parts(frames, vectors, monkeypatch, numbers, cells):
    monkeypatch.setattr(nearest, "NUMBERS", numbers)  # so many vector numbers fit a task
    hits = S.vector_top_k(*frames, k=5, keep=["tag"], cells=cells)
    assert found(hits) == brute(vectors, 5)
    assert all(r.tag == f"t{r.id}" for r in hits.collect())


def clusters(spark, n, spread, dims=16, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((25, dims))
    rows = centres[np.arange(n) % 25] + spread * rng.standard_normal((n, dims))
    asked = centres[np.arange(60) % 25] + spread * rng.standard_normal((60, dims))
    c = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "id BIGINT, embedding ARRAY<DOUBLE>")
    q = spark.createDataFrame([(f"q{i}", [float(x) for x in v]) for i, v in enumerate(asked)], "qid STRING, vector ARRAY<DOUBLE>")
    return c, q, (rows, asked)


def test_few_cells_are_looked_into_on_clustered_rows(spark):
    c, q, vectors = clusters(spark, 2000, 0.1)
    cells = nearest.cells_of(c, cells=25)
    hits, visited = nearest.search(q, cells)
    assert found(hits) == brute(vectors, 5)
    assert len(cells.rows) >= 15
    looked = [len(r._cells) for r in visited.collect()]
    assert len(looked) == 60 and sum(looked) / 60 < 0.2 * len(cells.rows)


def test_one_query_and_one_row_many_times(spark, monkeypatch):
    """A third of both sides is one vector; zero, null and infinite vectors on both sides."""
    monkeypatch.setattr(nearest, "NUMBERS", 300)
    c, q, (rows_, asked) = clusters(spark, 300, 0.5, dims=4)
    rows_[::3], asked[::3] = rows_[0], rows_[0]
    rows_[5], asked[5] = 0, 0
    c = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows_)] + [(900, None), (901, [float("nan")] * 4), (902, [float("inf"), 0.0, 0.0, 0.0])], c.schema)
    q = spark.createDataFrame([(f"q{i}", [float(x) for x in v]) for i, v in enumerate(asked)] + [("null", None), ("nan", [float("nan")] * 4)], q.schema)
    unit, ask = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) for m in (rows_, asked))
    want = set()
    for i, a in enumerate(ask):
        cos = np.round(unit @ a, 12)
        want |= {(f"q{i}", r + 1, int(x)) for r, x in enumerate(np.lexsort((np.arange(len(cos)), -cos))[:3])}
    assert found(S.vector_top_k(q, c, k=3, cells=6)) == want
    only_zero = c.where("id = 5")
    assert {(r.qid, r.id, r.score) for r in S.vector_top_k(q, only_zero, k=2, cells=3).collect()} == {(f"q{i}", 5, 0.5) for i in range(60)}


def test_no_queries_no_corpus(frames):
    q, c = frames
    assert S.vector_top_k(q.limit(0), c).count() == 0
    assert S.vector_top_k(q, c.where("id < 0")).count() == 0


def test_scores_are_clamped_and_filtered_last(spark):
    c = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0])], "id INT, embedding ARRAY<DOUBLE>")
    q = spark.createDataFrame([(1, [2.0, 0.0])], "qid INT, vector ARRAY<DOUBLE>")
    hits = S.vector_top_k(q, c, k=3)
    assert [r.score for r in hits.orderBy("rank").collect()] == [1.0, 0.5, 0.0]
    assert S.similarity_filter(hits, 0.5).count() == 2


def test_cosine_expression(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>")
    assert [round(r[0], 9) for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == [0.96, 0.0]


def test_approximate_recall(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    corpus = e.select(F.col("vec_id").alias("id"), "embedding")
    queries = e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    exact = S.vector_top_k(queries, corpus)
    approx = S.vector_top_k_approx(queries, corpus, S.random_planes(64, 6, 64))
    assert S.recall(approx, exact).first()["recall"] >= 0.95


def test_vectors_of_another_length_are_an_error(spark):
    c = spark.createDataFrame([(1, [1.0, 0.0, 2.0]), (2, [0.0, 1.0, 1.0, 4.0, 1.0])], "id INT, embedding ARRAY<DOUBLE>").coalesce(1)
    q = spark.createDataFrame([(1, [2.0, 0.0, 1.0, 1.0])], "qid INT, vector ARRAY<DOUBLE>")
    with pytest.raises(Exception, match="numbers among those of 4"):
        S.vector_top_k(q, c).collect()


@pytest.fixture(scope="module")
def tables(spark):
    wide = spark.createDataFrame([], ", ".join(f"status_{i} INT" for i in range(20)))
    cat = None
    for server, database in (("a", "one"), ("a", "two"), ("b", "one")):
        part = C.catalog(spark, {
            "orders": spark.createDataFrame([], "o_id INT, o_status INT"), "wide_status": wide,
            "100%_sure": spark.createDataFrame([], "x INT"), "x1": spark.createDataFrame([], "y INT"),
        }, server, database)
        cat = part if cat is None else cat.unionByName(part)
    notes = spark.createDataFrame([("x1", "Holds ORDER lines"), ("orders", None)], "table_name STRING, table_description STRING")
    return S.searchable(cat, notes)


@pytest.fixture(scope="module")
def questions(spark):
    texts = ["order status?", "где найти", "100%_", "zzz", "STATUS", "x", "status_1, order", ""]
    texts += ["order status?"] * 8  # half of all questions are one text
    return spark.createDataFrame(list(enumerate(texts)), "qid BIGINT, text STRING")


def test_like_signs_are_literal(spark, tables):
    words = spark.createDataFrame([("100%",), ("o%d",), ("o_status",), ("o_id\no_status",)], "keyword STRING")
    got = {(r.keyword, r.table_name) for r in S.keyword_search(words, tables).collect()}
    assert got == {("100%", "100%_sure"), ("o_status", "orders")}


def everywhere(*found):
    """(table, score) pairs in rank order, each for the three sources in turn, cut at five."""
    sources = (("a", "one"), ("a", "two"), ("b", "one"))
    return [(*source, table, score) for table, score in found for source in sources][:5]


# What the questions find in the tables above, by hand.
EXPECTED = {
    "order status?": everywhere(("wide_status", 1.0), ("orders", 0.3), ("x1", 0.0)),  # orders by its name first, x1 by its note
    "где найти": [],
    "100%_": everywhere(("100%_sure", 0.3)),
    "zzz": [],
    "STATUS": everywhere(("wide_status", 1.0), ("orders", 0.2)),
    "x": everywhere(("x1", 0.3), ("100%_sure", 0.2)),  # a name against a column
    "status_1, order": everywhere(("wide_status", 1.0), ("orders", 0.3)),  # eleven columns begin with status_1
    "": everywhere(("wide_status", 1.0), ("orders", 0.7)),  # the empty word is in every name
}


def test_first_seen_order(questions, tables):
    got = rows(S.keyword_hits(questions, tables), "qid", "rank", "server", "database", "table_name", "score")
    want = [(q.qid, i + 1, *hit) for q in questions.collect() for i, hit in enumerate(EXPECTED[q.text])]
    assert got == sorted(want, key=repr)


def test_best_score_option(spark):
    found = spark.createDataFrame(
        [(1, 0, "s", "d", "t", "", ["c"], 1, 0.2), (1, 1, "s", "d", "t", "", ["c"], 5, 1.0)],
        "qid INT, seq INT, server STRING, database STRING, table_name STRING, description STRING, columns ARRAY<STRING>, matching_columns INT, score DOUBLE",
    )
    assert S.first_seen_dedup(found).first().score == 0.2
    assert S.first_seen_dedup(found, best=True).first().score == 1.0


def test_fallback_paths(spark, questions, tables):
    index = spark.createDataFrame(
        [("d1", [1.0, 0.0], "s", "d", "t1", "", ["a"]), ("d2", [-1.0, 0.0], "s", "d", "t2", "", ["b"])],
        "doc_id STRING, embedding ARRAY<DOUBLE>, server STRING, database STRING, table_name STRING, description STRING, columns ARRAY<STRING>",
    )
    asked = questions.withColumn("vector", F.array(F.lit(1.0), F.lit(0.0)))
    hits, status = S.search_with_fallback(asked, index, tables)
    assert {r.table_name for r in hits.collect()} == {"t1"} and {r.status for r in status.collect()} == {"success"}
    # an empty vector answer stays empty
    hits, status = S.search_with_fallback(asked, index, tables, threshold=1.1)
    assert hits.count() == 0 and {r.status for r in status.collect()} == {"empty"}
    for empty in (None, index.limit(0)):
        hits, status = S.search_with_fallback(asked, empty, tables)
        assert {r.qid: r.status for r in status.collect()}[3] == "empty" and hits.where("qid = 0").count() > 0

    def no_model(df):
        raise RuntimeError("index not built")

    def broken(df):
        raise ValueError("broken")

    assert S.search_with_fallback(questions, index, tables, encode=no_model)[0].where("qid = 0").count() > 0

    def no_model_in_a_task(df):
        def run(batches):
            raise RuntimeError("model not there")
            yield

        return df.withColumn("vector", F.array(F.lit(1.0))).mapInPandas(run, "qid long, text string, vector array<double>")

    assert S.search_with_fallback(questions, index, tables, encode=no_model_in_a_task)[0].where("qid = 0").count() > 0
    hits, status = S.search_with_fallback(questions, index, tables, encode=broken)
    assert hits.count() == 0 and {(r.status, r.error) for r in status.collect()} == {("error", "broken")}


def test_contexts(spark):
    hits = spark.createDataFrame(
        [(1, r, "s", "d", f"t{r}", "" if r == 2 else "about", 0.5, [f"c{i}" for i in range(20)]) for r in range(1, 8)],
        "qid INT, rank INT, server STRING, database STRING, table_name STRING, description STRING, score DOUBLE, columns ARRAY<STRING>",
    )
    questions = spark.createDataFrame([(1,), (2,)], "qid INT")
    report = spark.createDataFrame(
        [("t1", 2, "b", "int", True, False, True, None), ("t1", 1, "a", "varchar(5)", False, False, False, "note")],
        "table_name STRING, column_id INT, column_name STRING, type_text STRING, is_nullable BOOLEAN, is_pk BOOLEAN, is_fk BOOLEAN, description STRING",
    )
    details = S.schema_detail(report).withColumn("qid", F.lit(1)).drop("table_name")
    got = {r.qid: r.context for r in S.search_context(questions, hits, details).collect()}
    lines = got[1].split("\n")
    assert lines[:3] == ["Найденные таблицы (по поиску):", "  Таблица: t1 [d]", "  Описание: about"]
    assert lines[3] == "  Колонки: " + ", ".join(f"c{i}" for i in range(15))
    assert lines[5] == "  Описание: нет" and "t6" not in got[1]
    assert lines[-3:] == ["Детальная схема таблицы t1:", "  - a (varchar(5)): note", "  - b (int) [FK, NULL]"]
    assert got[2] == "Информация о схеме БД не найдена."
    cited = S.collect_sources(hits, spark.createDataFrame([(1, "s", "d", "t2"), (2, "s", "d", "t9")], "qid INT, server STRING, database STRING, table_name STRING"))
    assert {(r.qid, r.table_name, r.pos.part) for r in cited.collect()} == {*[(1, f"t{i}", 0) for i in range(1, 8)], (2, "t9", 1)}


def test_result_context(spark):
    data = spark.createDataFrame([(1, i, None if i == 2 else f"v{i}") for i in range(1, 8)] + [(2, 1, "x")], "run INT, k INT, v STRING")
    lines = S.row_lines(data, "run", ["k"], ["k", "v"], max_rows=6)
    runs = spark.createDataFrame([(1, "success", None), (2, "success", "late"), (3, "empty", None), (4, "error", None), (5, None, None)], "run INT, exec_status STRING, error STRING")
    full = runs.join(lines, "run", "left").withColumn("exec_message", F.lit("bad column"))
    got = {r.run: r.context for r in S.result_context(full).collect()}
    assert got[1] == "Данные из БД (6 строк, обрезано до 5):\n  • k: 1, v: v1\n  • k: 2, v: None\n  • k: 3, v: v3\n  • k: 4, v: v4\n  • k: 5, v: v5"
    assert got[2] == "Данные из БД (1 строк):\n  • k: 1, v: x\n\nОшибка агента: late"
    assert got[3] == "Запрос выполнен, но данных не найдено."
    assert got[4] == "Ошибка выполнения запроса: bad column"


def _gaussian(spark, n, centres=None, seed=5):
    rng = np.random.default_rng(seed)
    data = rng.standard_normal((n, 16))
    if centres is not None:
        data = centres[rng.integers(0, len(centres), n)] + 0.05 * data
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id INT, embedding ARRAY<DOUBLE>")


@pytest.mark.parametrize("clustered, most", [(True, 0.25), (False, 0.8)])
def test_learned_cells_recall_and_share(spark, clustered, most):
    centres = np.random.default_rng(1).standard_normal((24, 16)) if clustered else None
    corpus = _gaussian(spark, 3000, centres)
    queries = corpus.where("id % 30 = 0").selectExpr("id AS qid", "embedding AS vector")
    cells = nearest.cells_of(corpus, cells=24)
    hits, visits = nearest.search_probed(queries, cells, nearest.probes_for(queries, cells, 0.96))
    exact = S.vector_top_k(queries, corpus)
    assert S.recall(hits, exact).first()["recall"] >= 0.95
    assert nearest.scored_share(visits, cells) <= most
    every, _ = nearest.search_probed(queries, cells, probes=10_000)
    assert rows(every, "qid", "rank", "id") == rows(exact, "qid", "rank", "id")


def test_learned_cells_with_awkward_vectors(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0])], "id INT, embedding ARRAY<DOUBLE>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("inf"), 1.0])], "qid INT, vector ARRAY<DOUBLE>")
    hits, visits = nearest.search_probed(queries, nearest.cells_of(corpus, cells=2), probes=1)
    assert rows(hits, "qid", "id") == [(1, 1), (2, 1)] and visits.count() == 2
    zeros = nearest.cells_of(corpus.where("id = 2"), cells=2)
    assert rows(nearest.search_probed(queries, zeros, probes=1)[0], "qid", "id") == [(1, 2), (2, 2)]


def test_registered_learned_cells_recall(spark, sf_dir):
    corpus = Q.corpus(spark, sf_dir)
    queries = corpus.where("id % 100 = 0").select(F.col("id").alias("qid"), F.col("embedding").alias("vector"))
    assert S.recall(Q.vector_top_k_cells(spark, sf_dir), S.vector_top_k(queries, corpus)).first()["recall"] >= 0.9
