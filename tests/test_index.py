import json

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tablescout.operators import index as I
from tablescout.sources import catalog as C
from tablescout.sources import tables as T
from tablescout.sources.sinks import IndexStore, save_run_results, save_run_summary


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame([(f"d{i}", f"text {i}" if i != 3 else "  ") for i in range(6)], "doc_id STRING, text STRING")


def counts(df):
    return dict(rows(df))


def test_second_run_indexes_nothing(spark, docs, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    assert store.is_empty() and store.read() is None
    assert counts(I.incremental_index(store, docs)) == {"indexed": 5, "error": 1}
    assert counts(I.incremental_index(store, docs)) == {"skipped": 5, "error": 1}
    assert store.read().count() == 5


def test_only_new_documents_are_encoded(spark, docs, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    store.replace(docs.limit(2).withColumn("embedding", F.array(F.lit(0.0).cast("float"))))
    I.incremental_index(store, docs, lambda df: df.withColumn("embedding", F.array(F.lit(1.0).cast("float"))))
    assert rows(store.read().select("doc_id", F.col("embedding")[0])) == [
        ("d0", 0.0), ("d1", 0.0), ("d2", 1.0), ("d4", 1.0), ("d5", 1.0),
    ]
    I.incremental_index(store, docs, lambda df: df.withColumn("embedding", F.array(F.lit(2.0).cast("float"))), force=True)
    assert {r[0] for r in store.read().select(F.col("embedding")[0]).collect()} == {2.0}


def test_upsert_replaces_by_id(spark, docs, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    store.replace(docs)
    store.upsert(spark.createDataFrame([("d1", "new"), ("d9", "more")], "doc_id STRING, text STRING"))
    got = dict(rows(store.read()))
    assert got["d1"] == "new" and got["d9"] == "more" and len(got) == 7


def test_index_if_empty(spark, docs, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    assert counts(I.index_if_empty(store, docs)) == {"indexed": 5, "error": 1}
    assert counts(I.index_if_empty(store, docs)) == {"already_built": 0}
    assert I.index_stats(store.read(), collection="c").first().asDict() == {"total_documents": 5, "collection": "c"}


def test_document_text(spark):
    tables = {"debt": spark.createDataFrame([], "id INT NOT NULL, status INT"), "bank": spark.createDataFrame([], "name STRING")}
    cat = C.catalog(spark, tables, "prod", "db", {"status": "code"})
    descriptions = spark.createDataFrame([("debt", "Loans"), ("bank", None)], "table_name STRING, table_description STRING")
    knowledge = spark.createDataFrame(
        [("debt", " Money owed.\n", ["loan", "credit"], ["debt.bank_id -> bank.id"], {"status": ("see dict", "join")}, None)],
        T.KNOWLEDGE_SCHEMA,
    )
    got = {r.doc_id: r for r in I.schema_documents(cat, descriptions, knowledge).collect()}
    assert got["prod__db__debt"].text == (
        "Таблица: debt\nБаза данных: db\nОписание: Loans\nБизнес-смысл: Money owed.\n"
        "Синонимы и бизнес-термины: loan, credit\nСвязи с другими таблицами:\n  debt.bank_id -> bank.id\n"
        "Поля-справочники (enum):\n  - status: see dict\nКолонки:\n  - id (int, NOT NULL)\n  - status (int, NULL): code"
    )
    assert got["prod__db__bank"].text == "Таблица: bank\nБаза данных: db\nОписание: нет описания\nКолонки:\n  - name (varchar, NULL)"
    assert got["prod__db__debt"]["columns"] == "id, status"


def test_whitelist(spark):
    t = spark.createDataFrame([("a",), ("b",)], "table_name STRING")
    assert rows(I.index_whitelist(t, ["b"])) == [("a", "skipped"), ("b", "indexed")]
    assert {r.action for r in I.index_whitelist(t, []).collect()} == {"indexed"}


def test_user_encoder_sees_prefixed_batches(spark, docs):
    def factory():
        return lambda texts: [[len(t), t.startswith("passage: ")] for t in texts]

    got = I.encode_with(docs, factory).orderBy("doc_id").first()
    assert got.embedding == [len("passage: text 0"), 1.0]


def test_default_encoder_gives_unit_vectors(spark, docs):
    out = I.encode_default(docs, I.fit_default_encoder(docs, dims=32))
    norms = {r.doc_id: sum(x * x for x in r.embedding) for r in out.collect()}
    assert norms["d0"] == pytest.approx(1.0, abs=1e-5) and norms["d3"] == 0.0


def test_knowledge_file(spark, tmp_path):
    path = tmp_path / "knowledge.json"
    path.write_text(json.dumps([{"table_name": "debt", "synonyms": ["долг"], "relationships": ["a -> b"],
                                 "enum_fields": {"status": {"description": "code"}}}]), encoding="utf-8")
    known = T.load_knowledge(spark, str(path))
    assert rows(T.knowledge_entries(known)) == [("debt", "enum", "status"), ("debt", "relationship", "a -> b"), ("debt", "synonym", "долг")]
    path.write_text("{ not json", encoding="utf-8")
    assert T.load_knowledge(spark, str(path)).count() == 0
    assert T.load_knowledge(spark, str(tmp_path / "none.json")).count() == 0


def test_cases(spark, tmp_path):
    path = tmp_path / "cases.json"
    path.write_text(json.dumps([
        {"id": "a", "category": "data", "success_criteria": ["sql_executed"]}, {"id": "b", "category": "unsafe"},
    ]))
    assert T.load_cases(spark, str(path)).count() == 2
    assert T.load_cases(spark, str(path), category="data").first().success_criteria == ["sql_executed"]
    with pytest.raises(ValueError):
        T.load_cases(spark, str(path), category="data", case_id="b")


def test_federation_skips_what_cannot_be_read(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "one"))
    spark.range(2).withColumn("extra", F.lit("x")).write.parquet(str(tmp_path / "two"))
    out, status = T.federate(spark, [
        T.Source("s1", "d", "t", str(tmp_path / "one")), T.Source("s2", "d", "t", str(tmp_path / "gone")),
        T.Source("s2", "d2", "t", str(tmp_path / "two")),
    ])
    assert rows(out, "server", "id", "extra") == [("s1", 0, None), ("s1", 1, None), ("s1", 2, None), ("s2", 0, "x"), ("s2", 1, "x")]
    assert [(r.server, r.status) for r in status.collect()] == [("s1", "success"), ("s2", "error"), ("s2", "success")]
    no_driver = T.Source("s", "d", "t", fmt="jdbc", options={"url": "jdbc:nothing:x"})
    assert T.federate(spark, [no_driver])[1].first().status == "error"
    nothing, status = T.federate(spark, [T.Source("s", "d", "t", str(tmp_path / "gone"))])
    assert nothing is None and status.first().error == "PATH_NOT_FOUND"


def test_jdbc_options():
    s = T.Source("s", "d", "debt", fmt="jdbc", options={"url": "jdbc:x"})
    assert T.jdbc_options(s) == {"url": "jdbc:x", "dbtable": "debt"}
    assert T.jdbc_options(s, "SELECT 1")["query"] == "SELECT 1"
    split = T.Source("s", "d", "debt", fmt="jdbc", options={"partitionColumn": "id", "numPartitions": "8"})
    options = T.jdbc_options(split, "SELECT 1")
    assert options["dbtable"] == "(SELECT 1) AS q" and "query" not in options


def test_run_results_are_kept_by_date(spark, tmp_path):
    cases = spark.createDataFrame([("2024-01-01", 1, True), ("2024-01-02", 2, False)], "run_date STRING, case_id INT, passed BOOLEAN")
    save_run_results(cases, str(tmp_path / "runs"))
    save_run_results(cases.where("case_id = 2"), str(tmp_path / "runs"))
    assert spark.read.json(str(tmp_path / "runs")).count() == 3
    assert (tmp_path / "runs" / "run_date=2024-01-01").is_dir()
    save_run_summary(cases.agg(F.count("*").alias("total")), str(tmp_path / "summary"), model="none")
    r = spark.read.json(str(tmp_path / "summary")).first()
    assert (r.metrics.total, r.run_meta.model) == (2, "none")


def test_equal_ids_in_one_batch_are_one_document(spark, tmp_path):
    docs = spark.createDataFrame([("a", "one"), ("a", "two"), ("b", "three"), ("a", None)], "doc_id STRING, text STRING")
    store = IndexStore(spark, str(tmp_path / "index"))
    assert rows(I.incremental_index(store, docs)) == [("error", 1), ("indexed", 2), ("skipped", 1)]
    assert sorted(r.doc_id for r in store.read().collect()) == ["a", "b"]
    store.upsert(spark.createDataFrame([("b", "x"), ("b", "y"), ("c", "z")], "doc_id STRING, text STRING"))
    assert sorted(r.doc_id for r in store.read().collect()) == ["a", "b", "c"]


def test_upsert_leaves_other_buckets_alone(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"), buckets=8)
    store.upsert(spark.range(200).select(F.col("id").cast("string").alias("doc_id"), F.lit("old").alias("text")))
    before = store.parts()
    files = {p: sorted(f.name for f in (tmp_path / "index" / p[1] / f"_index_bucket={p[0]}").iterdir()) for p in before}
    assert sorted(b for b, _ in before) == list(range(8))
    one = spark.createDataFrame([("7", "new", 1)], "doc_id STRING, text STRING, rank INT")
    hit = one.select(store.bucket()).first()[0]
    store.upsert(one)
    after = store.parts()
    assert sorted(set(before) - set(after)) == [p for p in before if p[0] == hit] and len(after) == 8
    assert {p: sorted(f.name for f in (tmp_path / "index" / p[1] / f"_index_bucket={p[0]}").iterdir()) for p in before} == files
    got = {r.doc_id: (r.text, r["rank"]) for r in store.read().collect()}
    assert got == {**{str(i): ("old", None) for i in range(200)}, "7": ("new", 1)}


def test_compaction_and_empty_writes(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"), buckets=2)
    docs = spark.range(20).select(F.col("id").cast("string").alias("doc_id"), F.lit("x").alias("text"))
    store.replace(docs.limit(0))
    assert store.is_empty() and store.read().columns == ["doc_id", "text"]
    store.append(docs)
    store.append(docs.withColumn("doc_id", F.concat(F.lit("b"), "doc_id")))
    assert len(store.parts()) == 4
    store.upsert(docs.limit(0))
    assert len(store.parts()) == 4
    stored = rows(store.read())
    store.compact()
    assert len(store.parts()) == 2 and rows(store.read()) == stored and len(stored) == 40
    store = IndexStore(spark, str(tmp_path / "index"), buckets=5)  # the first write's number counts
    store.upsert(docs.withColumn("text", F.lit("y")))
    assert {b for b, _ in store.parts()} == {0, 1}
    assert sorted(r.text for r in store.read().collect()) == ["x"] * 20 + ["y"] * 20


def test_broken_knowledge_entries_are_reported(spark, tmp_path):
    path = tmp_path / "knowledge.json"
    entries = [
        {"table_name": "debt", "synonyms": ["owed"], "enum_fields": {"status": {"description": "code"}}}, {"synonyms": ["x"]},
        {"table_name": "a", "synonyms": "owed"}, 5, None, {"table_name": "b", "synonyms": None, "more": 1},
    ]
    path.write_text(json.dumps(entries), encoding="utf-8")
    known, status = T.read_knowledge(spark, str(path))
    assert rows(known, "table_name", "synonyms") == [("b", None), ("debt", ["owed"])]
    assert rows(T.knowledge_entries(known)) == [("debt", "enum", "status"), ("debt", "synonym", "owed")]
    assert rows(status) == sorted([
        (0, "debt", "ok", None), (1, None, "unnamed", None), (2, "a", "bad_field", "synonyms"), (3, None, "malformed", None),
        (4, None, "malformed", None), (5, "b", "ok", None),
    ], key=repr)
    path.write_text("[{ not json", encoding="utf-8")
    known, status = T.read_knowledge(spark, str(path))
    assert known.count() == 0 and rows(status, "status") == [("malformed",)]
    path.write_text('{"table_name": "a"}\n\n{"table_name": \n', encoding="utf-8")
    known, status = T.read_knowledge(spark, str(path), multi_line=False)
    assert rows(known, "table_name") == [("a",)] and rows(status, "status") == [("malformed",), ("ok",)]
