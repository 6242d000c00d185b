"""Queries for search-index building, sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tablescout.operators import index as I
from tablescout.operators import profile as P
from tablescout.operators import runlog as L
from tablescout.operators import search as S
from tablescout.plans import knowledge_data as K
from tablescout.plans.derived import duckdb_cte, view
from tablescout.plans.profile_queries import ALL_TABLES, all_tables, observed
from tablescout.plans.registry import query
from tablescout.plans.runlog_queries import SCORED
from tablescout.session import shared_dir
from tablescout.sources.sinks import IndexStore, save_run_results, upserted
from tablescout.sources.tables import Source, federate, knowledge_entries, load, load_cases, read_knowledge, read_source


def fresh_path(spark, name):
    """A new folder for one run in the shared working folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("source_jdbc", """
SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total_sum FROM orders GROUP BY o_custkey
""")
def source_jdbc(spark, d):
    """The (server, database, SQL) read on the parquet form of the reader; no database here."""
    source = Source("local", "main", "orders", f"{d}/orders.parquet")
    return read_source(spark, source, """
        SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total_sum FROM orders GROUP BY o_custkey""")


def _parties(spark, d):
    sources = [
        Source("crm", "sales", "customer", f"{d}/customer.parquet"),
        Source("erp", "purchasing", "supplier", f"{d}/supplier.parquet"),
        Source("erp", "archive", "old_supplier", f"{d}/old_supplier.parquet"),
    ]

    def shape(df):
        prefix = df.columns[0].split("_")[0]
        return df.toDF(*[c.removeprefix(f"{prefix}_").replace("custkey", "key").replace("suppkey", "key") for c in df.columns])

    return federate(spark, sources, shape)


@query("source_federated", """
SELECT 'crm' AS server, 'sales' AS database, c_custkey AS key, c_name AS name, c_nationkey AS nationkey,
       c_acctbal AS acctbal, c_mktsegment AS mktsegment FROM customer
UNION ALL SELECT 'erp', 'purchasing', s_suppkey, s_name, s_nationkey, s_acctbal, NULL FROM supplier
""")
def source_federated(spark, d):
    return _parties(spark, d)[0]


@query("source_federated_status", """
SELECT 'crm' AS server, 'sales' AS database, 'customer' AS table_name, 'success' AS status, count(*) AS n_rows FROM customer
UNION ALL SELECT 'erp', 'purchasing', 'supplier', 'success', count(*) FROM supplier
UNION ALL SELECT 'erp', 'archive', 'old_supplier', 'error', 0
""")
def source_federated_status(spark, d):
    rows, status = _parties(spark, d)
    counts = rows.groupBy("server", "database").agg(F.count(F.lit(1)).alias("n"))
    return status.join(counts, ["server", "database"], "left").select(
        "server", "database", "table_name", "status", F.coalesce("n", F.lit(0)).alias("n_rows")
    )


ENUMS = [(t, c) for t, _, _, _, enums in K.KNOWLEDGE for c in enums]


@query("source_knowledge", "WITH entries AS " + K.sql_values(
    [(t, "synonym", s) for t, _, syn, _, _ in K.KNOWLEDGE for s in syn]
    + [(t, "relationship", r) for t, _, _, rel, _ in K.KNOWLEDGE for r in rel], "table_name, kind, entry"
) + ", counts AS (" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in ALL_TABLES) + """)
SELECT table_name, kind, entry, n_rows FROM entries JOIN counts USING (table_name)
""" + "".join(
    f" UNION ALL SELECT '{t}', 'enum', concat('{c}', '=', coalesce({c}, '')), count(*) FROM {t} GROUP BY {c}" for t, c in ENUMS
))
def source_knowledge(spark, d):
    """Knowledge entries with the rows they speak of: of the table, or of each code of an enum field."""
    entries = knowledge_entries(K.knowledge(spark))
    out = entries.where("kind <> 'enum'").join(
        P.table_row_counts(all_tables(spark, d)).select("table_name", F.col("exact_rows").alias("n_rows")), "table_name"
    ).select("table_name", "kind", "entry", "n_rows")
    for r in entries.where("kind = 'enum'").collect():  # one row per described field
        codes = load(spark, d, r["table_name"]).groupBy(r["entry"]).agg(F.count(F.lit(1)).alias("n_rows"))
        out = out.union(codes.select(
            F.lit(r["table_name"]), F.lit("enum"),
            F.concat(F.lit(r["entry"] + "="), F.coalesce(F.col(r["entry"]), F.lit(""))), "n_rows",
        ))
    return out


# One knowledge entry for each customer, every 7th cut short, every 11th with a name in place of a list, every 13th without its table.
@query("source_knowledge_file", """
SELECT CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN NULL ELSE c_name END AS table_name,
  CASE WHEN c_custkey % 7 = 0 THEN 'malformed' WHEN c_custkey % 11 = 0 THEN 'bad_field' WHEN c_custkey % 13 = 0 THEN 'unnamed' ELSE 'ok' END AS status,
  CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 11 = 0 THEN 'synonyms' END AS problem,
  CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 AND c_custkey % 13 <> 0 THEN c_mktsegment END AS synonyms
FROM customer
""")
def source_knowledge_file(spark, d):
    """Entries written as lines, some of them broken, and read back: the usable ones with their synonyms, all with a status."""
    path = fresh_path(spark, "knowledge")
    key = F.col("c_custkey")
    name = F.when(key % 13 != 0, F.col("c_name"))
    good = F.to_json(F.struct(name.alias("table_name"), F.array("c_mktsegment").alias("synonyms")))
    odd = F.to_json(F.struct(name.alias("table_name"), F.col("c_mktsegment").alias("synonyms")))
    line = F.when(key % 11 == 0, odd).otherwise(good)
    line = F.when(key % 7 == 0, F.substring(line, 1, 20)).otherwise(line)
    load(spark, d, "customer").select(line.alias("value")).write.text(path)
    entries, status = read_knowledge(spark, path, multi_line=False)
    used = entries.select("table_name", F.array_join("synonyms", ",").alias("synonyms"))
    ok = status.where("status = 'ok'").join(used, "table_name").select("table_name", "status", "problem", "synonyms")
    return ok.unionByName(status.where("status <> 'ok'").select("table_name", "status", "problem"), allowMissingColumns=True)


@query("sink_index_buckets", """
SELECT doc_id % 3 = 0 AS renewed, count(*) AS n_documents, sum(length(coalesce(text, ''))) AS n_chars, 0 AS rewritten_elsewhere
FROM documents GROUP BY 1
""")
def sink_index_buckets(spark, d):
    """All documents indexed, a third upserted bucket by bucket, then compacted; buckets without incoming ids keep their folders."""
    store = IndexStore(spark, fresh_path(spark, "index"))
    docs = documents(spark, d)
    store.replace(docs.withColumn("version", F.lit("old")))
    before = set(store.parts())
    store.upsert(docs.where("doc_id % 3 = 0").withColumn("version", F.lit("new")))
    touched = {r[0] for r in docs.where("doc_id % 3 = 0").select(store.bucket().alias("b")).distinct().collect()}  # at most 64
    elsewhere = len({p for p in before - set(store.parts()) if p[0] not in touched})
    store.compact()
    return store.read().groupBy((F.col("version") == "new").alias("renewed")).agg(
        F.count(F.lit(1)).alias("n_documents"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("n_chars"),
        F.lit(elsewhere).alias("rewritten_elsewhere"),
    )


@query("source_cases", duckdb_cte("run_log") + """
SELECT CAST(case_id AS VARCHAR) AS id, category, expected_type AS expected_query_type,
       array_to_string(expected_tools, ',') AS expected_tools, len(criteria) AS n_criteria FROM run_log WHERE category = 'data'
""")
def source_cases(spark, d):
    """Cases written as JSON lines to the shared folder and read back by category."""
    path = fresh_path(spark, "cases")
    view(spark, d, "run_log").select(
        F.col("case_id").cast("string").alias("id"), "category", F.col("expected_type").alias("expected_query_type"),
        "expected_tools", F.col("expected_terms").alias("expected_answer_contains"),
        F.col("criteria").alias("success_criteria"),
    ).write.json(path)
    return load_cases(spark, path, category="data", multi_line=False).select(
        "id", "category", "expected_query_type", F.array_join("expected_tools", ",").alias("expected_tools"),
        F.size("success_criteria").alias("n_criteria"),
    )


@query("sink_run_results", SCORED + """
SELECT strftime(ts, '%Y-%m-%d') AS run_date, category, count(*) AS total, count_if(passed) AS passed,
       round(sum(latency_s), 2) AS total_time_s FROM scored GROUP BY 1, 2
""")
def sink_run_results(spark, d):
    """Scored cases written per run date, read back and counted."""
    path = fresh_path(spark, "runs")
    cases = L.score_case(view(spark, d, "run_log")).select(
        F.date_format("ts", "yyyy-MM-dd").alias("run_date"), "case_id", "category", "passed", "got_type",
        "steps", "tools_used", "latency_s", "error", "results",
    )
    save_run_results(cases, path)
    stored = spark.read.schema("run_date STRING, case_id BIGINT, category STRING, passed BOOLEAN, latency_s DOUBLE").json(path)
    return stored.groupBy("run_date", "category").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"),
        F.round(F.sum("latency_s"), 2).alias("total_time_s"),
    )


WHITELIST = ["orders", "lineitem", "customer", "events"]


@query("index_whitelist", "WITH " + " counts AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in ALL_TABLES
) + f""")
SELECT table_name, n_rows, CASE WHEN table_name IN ({", ".join(f"'{t}'" for t in WHITELIST)}) THEN 'indexed' ELSE 'skipped' END AS action FROM counts
""")
def index_whitelist(spark, d):
    counts = P.table_row_counts(all_tables(spark, d)).select("table_name", F.col("exact_rows").alias("n_rows"))
    return I.index_whitelist(counts, WHITELIST)


KNOWLEDGE_SQL = "knowledge AS " + K.sql_values(
    [(t, (biz or "").strip(), ", ".join(syn), "\n".join("  " + r for r in rel),
      "\n".join(f"  - {k}: {v}" for k, v in sorted(enums.items())), len(syn), len(rel)) for t, biz, syn, rel, enums in K.KNOWLEDGE],
    "table_name, biz, syn, rel, enums, n_syn, n_rel",
)

DOCS_SQL = K.catalog_sql() + ", " + K.descriptions_sql() + ", " + KNOWLEDGE_SQL + r""",
column_lines AS (SELECT table_name, string_agg(concat('  - ', column_name, ' (', data_type, ', ',
    CASE WHEN is_nullable THEN 'NULL' ELSE 'NOT NULL' END, ')', CASE WHEN coalesce(description, '') <> '' THEN concat(': ', description) ELSE '' END),
    chr(10) ORDER BY column_id) AS lines, string_agg(column_name, ', ' ORDER BY column_id) AS columns FROM catalog GROUP BY table_name),
docs AS (SELECT concat('local__main__', c.table_name) AS doc_id, concat_ws(chr(10),
    concat('Таблица: ', c.table_name), 'База данных: main', concat('Описание: ', coalesce(table_description, 'нет описания')),
    CASE WHEN biz <> '' THEN concat('Бизнес-смысл: ', biz) END,
    CASE WHEN syn <> '' THEN concat('Синонимы и бизнес-термины: ', syn) END,
    CASE WHEN rel <> '' THEN concat('Связи с другими таблицами:', chr(10), rel) END,
    CASE WHEN enums <> '' THEN concat('Поля-справочники (enum):', chr(10), enums) END, 'Колонки:', lines) AS text,
  c.table_name, coalesce(table_description, '') AS description, columns
FROM column_lines c LEFT JOIN descriptions d USING (table_name) LEFT JOIN knowledge k USING (table_name))
"""


def schema_docs(spark, d):
    return I.schema_documents(observed(spark, d, ("nulls",)), K.descriptions(spark), K.knowledge(spark))


@query("schema_documents", "WITH " + DOCS_SQL + "SELECT doc_id, text, table_name, description, columns FROM docs")
def schema_documents(spark, d):
    return schema_docs(spark, d).select("doc_id", "text", "table_name", "description", "columns")


@query("knowledge_enrich", "WITH " + K.catalog_sql() + ", " + KNOWLEDGE_SQL + """
SELECT table_name, column_name, is_nullable, coalesce(biz, '') AS business_description, coalesce(n_syn, 0) AS n_synonyms,
       coalesce(n_rel, 0) AS n_relationships FROM catalog LEFT JOIN knowledge USING (table_name)
""")
def knowledge_enrich(spark, d):
    return I.knowledge_enrich(observed(spark, d, ("nulls",)), K.knowledge(spark)).select(
        "table_name", "column_name", "is_nullable", "business_description",
        F.size("synonyms").alias("n_synonyms"), F.size("relationships").alias("n_relationships"),
    )


def documents(spark, d):
    return load(spark, d, "documents").select("doc_id", "text", "lang")


def labelled(spark, d):
    """The part of the documents an earlier run has indexed: those that carry labels."""
    return documents(spark, d).join(load(spark, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi")


BLANK = "trim(coalesce(text, '')) = ''"


@query("incremental_index", f"""
SELECT CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'skipped' WHEN {BLANK} THEN 'error' ELSE 'indexed' END AS action,
       count(*) AS n_documents FROM documents GROUP BY 1
""")
def incremental_index(spark, d):
    store = IndexStore(spark, fresh_path(spark, "index"))
    store.replace(labelled(spark, d))
    return I.incremental_index(store, documents(spark, d))


@query("incremental_index_force", f"""
SELECT CASE WHEN {BLANK} THEN 'error' ELSE 'indexed' END AS action, count(*) AS n_documents FROM documents GROUP BY 1
""")
def incremental_index_force(spark, d):
    store = IndexStore(spark, fresh_path(spark, "index"))
    store.replace(labelled(spark, d))
    return I.incremental_index(store, documents(spark, d), force=True)


@query("index_if_empty", f"""
SELECT 'first' AS run, CASE WHEN {BLANK} THEN 'error' ELSE 'indexed' END AS action, count(*) AS n_documents FROM documents GROUP BY 2
UNION ALL SELECT 'second', 'already_built', 0
""")
def index_if_empty(spark, d):
    store = IndexStore(spark, fresh_path(spark, "index"))
    first = I.index_if_empty(store, documents(spark, d))
    second = I.index_if_empty(store, documents(spark, d))
    return first.select(F.lit("first").alias("run"), "*").union(second.select(F.lit("second"), "*"))


@query("sink_index", """
SELECT doc_id, 'old' AS version, length(text) AS n_chars FROM documents
  WHERE doc_id IN (SELECT doc_id FROM labels) AND lang <> 'en'
UNION ALL SELECT doc_id, 'new', length(text) FROM documents WHERE lang = 'en'
""")
def sink_index(spark, d):
    """Index of the labelled documents, upserted with the English ones and read back."""
    store = IndexStore(spark, fresh_path(spark, "index"))
    store.replace(labelled(spark, d).withColumn("version", F.lit("old")))
    store.upsert(documents(spark, d).where("lang = 'en'").withColumn("version", F.lit("new")))
    return store.read().select("doc_id", "version", F.length("text").alias("n_chars"))


@query("index_stats", """
SELECT count(*) AS total_documents, 'documents' AS collection, 'hashed words' AS encoder, 7 AS knowledge_tables FROM documents
""")
def index_stats(spark, d):
    n_known = F.lit(len(K.KNOWLEDGE))
    return I.index_stats(documents(spark, d), collection="documents", encoder="hashed words").withColumn("knowledge_tables", n_known)


def _vectors_sql(source: str, key: str, prefix: str, name: str) -> str:
    """CTEs that end in ``name(key, embedding)`` for the texts of ``source``."""
    return f"""{name}_words AS (SELECT {key}, unnest(regexp_extract_all(lower('{prefix}' || coalesce(text, '')), '{I.HASHED_WORD}')) AS word FROM {source}),
{name}_cells AS (SELECT {key}, ('0x' || substr(md5(word), 1, 8))::UBIGINT % 64 AS bucket, 1 + ln(count(*)) AS w FROM {name}_words GROUP BY ALL),
{name}_lengths AS (SELECT {key}, sqrt(sum(w * w)) AS length FROM {name}_cells GROUP BY {key}),
{name} AS (SELECT l.{key}, list(coalesce(c.w, 0) / l.length ORDER BY r.b) AS embedding FROM {name}_lengths l CROSS JOIN range(64) r(b)
  LEFT JOIN {name}_cells c ON c.{key} = l.{key} AND c.bucket = r.b GROUP BY l.{key})"""


@query("encode_passages", "WITH " + _vectors_sql("documents", "doc_id", I.PASSAGE, "vectors") + """
SELECT doc_id, generate_subscripts(embedding, 1) - 1 AS cell, round(unnest(embedding), 6) AS value FROM vectors
""")
def encode_passages(spark, d):
    encoded = I.encode_hashed(documents(spark, d), "doc_id")
    return encoded.select("doc_id", F.posexplode("embedding").alias("cell", "value")).select(
        "doc_id", F.col("cell").cast("bigint").alias("cell"), F.round("value", 6).alias("value"))


TEXT_THRESHOLD = 0.62


@query("text_search", duckdb_cte("questions") + ", " + DOCS_SQL + ", " + _vectors_sql("docs", "doc_id", I.PASSAGE, "passages") + ", "
       + _vectors_sql("questions", "qid", I.QUERY, "asked") + f""",
pairs AS (SELECT qid, doc_id AS id, round(list_cosine_similarity(a.embedding, p.embedding), 12) AS cos FROM asked a, passages p),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cos DESC, id) AS rank FROM pairs)
SELECT qid, rank, id, greatest(0.0, least(1.0, round(1 - (1 - cos) / 2, 3))) AS score FROM ranked
WHERE rank <= 5 AND greatest(0.0, least(1.0, round(1 - (1 - cos) / 2, 3))) >= {TEXT_THRESHOLD}
""")
def text_search(spark, d):
    """Questions as texts to the nearest schema documents, both encoded, then the threshold."""
    passages = I.encode_hashed(schema_docs(spark, d), "doc_id").withColumnRenamed("doc_id", "id")
    asked = I.encode_hashed(view(spark, d, "questions"), "qid", I.QUERY).withColumnRenamed("embedding", "vector")
    return S.similarity_filter(S.vector_top_k(asked, passages), TEXT_THRESHOLD).select("qid", "rank", "id", "score")
