"""Queries for vector and keyword search and the texts built from them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tablescout.functions.text import STOP_WORDS, escape_like
from tablescout.functions.vectors import mean_vectors
from tablescout.operators import nearest as N
from tablescout.operators import search as S
from tablescout.plans import knowledge_data as K
from tablescout.plans.derived import duckdb_cte, view
from tablescout.plans.profile_queries import all_tables
from tablescout.plans.registry import query
from tablescout.sources import catalog as C
from tablescout.sources.tables import load

DIMS = 64
THRESHOLD = 0.7


def centroids(spark, d):
    """One query vector per label: the mean of its embeddings."""
    means = mean_vectors(load(spark, d, "embeddings"), "label", "embedding", DIMS)
    return means.select(F.col("label").alias("qid"), F.col("embedding").alias("vector"))


def corpus(spark, d):
    return load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


CENTROIDS_SQL = """
cells AS (SELECT label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
means AS (SELECT label, i, avg(v) AS a FROM cells GROUP BY label, i),
centroids AS (SELECT label AS qid, list(a ORDER BY i) AS vector FROM means GROUP BY label)"""

RANKED_SQL = CENTROIDS_SQL + """,
scored AS (SELECT qid, vec_id AS id, label, round(list_cosine_similarity(vector, CAST(embedding AS DOUBLE[])), 12) AS cos
           FROM centroids, embeddings),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cos DESC, id) AS rank,
                  greatest(0.0, least(1.0, round(1 - (1 - cos) / 2, 3))) AS score FROM scored)
"""


@query("vector_top_k", "WITH " + RANKED_SQL + "SELECT qid, rank, id, label, score FROM ranked WHERE rank <= 5")
def vector_top_k(spark, d):
    hits = S.vector_top_k(centroids(spark, d), corpus(spark, d), keep=["label"])
    return hits.select("qid", "rank", "id", "label", "score")


@query("similarity_filter", "WITH " + RANKED_SQL + f"SELECT qid, rank, id, score FROM ranked WHERE rank <= 50 AND score >= {THRESHOLD}")
def similarity_filter(spark, d):
    hits = S.vector_top_k(centroids(spark, d), corpus(spark, d), k=50)
    return S.similarity_filter(hits, THRESHOLD).select("qid", "rank", "id", "score")


TABLES, BITS = 8, 4


def formula_planes() -> np.ndarray:
    """Directions from a formula that SQL can repeat."""
    t, b, i = np.meshgrid(np.arange(TABLES), np.arange(BITS), np.arange(DIMS), indexing="ij")
    x = np.sin(12.9898 * (t + 1) + 78.233 * (b + 1) + 37.719 * (i + 1)) * 43758.5453
    return x - np.floor(x) - 0.5


@query("vector_top_k_approx", "WITH " + CENTROIDS_SQL + f""",
cells_of AS (SELECT t, b, i, sin(12.9898 * (t + 1) + 78.233 * (b + 1) + 37.719 * (i + 1)) * 43758.5453 AS x
  FROM range({TABLES}) r(t), range({BITS}) s(b), range({DIMS}) u(i)),
planes AS (SELECT t, b, list(x - floor(x) - 0.5 ORDER BY i) AS plane FROM cells_of GROUP BY t, b),
vectors AS (SELECT 'q' AS side, qid AS id, CAST(vector AS DOUBLE[]) AS v FROM centroids
  UNION ALL SELECT 'c', vec_id, CAST(embedding AS DOUBLE[]) FROM embeddings),
codes AS (SELECT side, id, t, sum(CASE WHEN list_inner_product(v, plane) > 0 THEN 1 << b ELSE 0 END) AS code FROM vectors, planes GROUP BY side, id, t),
pairs AS (SELECT DISTINCT q.id AS qid, c.id AS id FROM codes q JOIN codes c ON q.t = c.t AND q.code = c.code AND q.side = 'q' AND c.side = 'c'),
scored AS (SELECT p.qid, p.id, round(list_cosine_similarity(q.v, c.v), 12) AS cos FROM pairs p
  JOIN vectors q ON q.side = 'q' AND q.id = p.qid JOIN vectors c ON c.side = 'c' AND c.id = p.id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cos DESC, id) AS rank FROM scored)
SELECT qid, rank, id, greatest(0.0, least(1.0, round(1 - (1 - cos) / 2, 3))) AS score FROM ranked WHERE rank <= 5
""")
def vector_top_k_approx(spark, d):
    hits = S.vector_top_k_approx(centroids(spark, d), corpus(spark, d), formula_planes())
    return hits.select("qid", "rank", "id", "score")


CELLS, RECALL = 32, 0.95


@query("vector_top_k_cells")
def vector_top_k_cells(spark, d):
    """Every hundredth vector searched in as many of its nearest learned cells as a sample of queries needs; the exact search is ``vector_top_k``."""
    rows = corpus(spark, d)
    queries = rows.where("id % 100 = 0").select(F.col("id").alias("qid"), F.col("embedding").alias("vector"))
    cells = N.cells_of(rows, ["label"], CELLS, DIMS)
    hits, _ = N.search_probed(queries, cells, N.probes_for(queries, cells, RECALL))
    return hits.select("qid", "rank", "id", "label", "score")


STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"

KEYWORDS_SQL = duckdb_cte("questions") + rf""", tokens AS (
SELECT qid, text, list_filter(string_split_regex(translate(lower(text), '?,', '  '), '\s+'),
  lambda t: length(t) > 2 AND NOT list_contains({STOP_SQL}, t)) AS kept FROM questions),
asked AS (SELECT qid, text, CASE WHEN len(kept) > 0 THEN kept ELSE [text] END AS keywords FROM tokens)
"""


@query("extract_keywords", KEYWORDS_SQL + "SELECT qid, array_to_string(keywords, '|') AS keywords FROM asked")
def extract_keywords(spark, d):
    out = S.extract_keywords(view(spark, d, "questions"))
    return out.select("qid", F.array_join("keywords", "|").alias("keywords"))


@query("escape_like", duckdb_cte("questions") + r"""
SELECT qid, replace(replace(replace(text, '/', '//'), '%', '/%'), '_', '/_') AS escaped FROM questions
""")
def escape(spark, d):
    return view(spark, d, "questions").select("qid", escape_like(F.col("text")).alias("escaped"))


def search_tables(spark, d):
    cat = C.catalog(spark, all_tables(spark, d), K.SERVER, K.DATABASE, K.COLUMN_NOTES)
    return S.searchable(cat, K.descriptions(spark))


MATCH_SQL = KEYWORDS_SQL + ", " + K.catalog_sql(observed=False) + ", " + K.descriptions_sql() + r""",
words AS (SELECT qid, unnest(keywords) AS keyword, generate_subscripts(keywords, 1) - 1 AS seq FROM asked),
patterns AS (SELECT DISTINCT keyword, '%' || replace(replace(replace(keyword, '/', '//'), '%', '/%'), '_', '/_') || '%' AS pattern FROM words),
tabs AS (SELECT DISTINCT table_name FROM catalog),
names AS (SELECT t.table_name, coalesce(any_value(e.table_description), '') AS description,
    string_agg(c.column_name, ', ' ORDER BY c.column_id) AS columns_list
  FROM tabs t JOIN catalog c USING (table_name) LEFT JOIN descriptions e USING (table_name) GROUP BY t.table_name),
places AS (SELECT table_name, table_name AS said, 0 AS is_column FROM names UNION ALL SELECT table_name, description, 0 FROM names
  UNION ALL SELECT table_name, column_name, 1 FROM catalog),
counted AS (SELECT p.keyword, a.table_name, sum(a.is_column)::BIGINT AS matching_columns
  FROM patterns p JOIN places a ON a.said ILIKE p.pattern ESCAPE '/' GROUP BY p.keyword, a.table_name),
matches AS (SELECT keyword, table_name, description, columns_list, matching_columns FROM counted JOIN names USING (table_name)),
scored AS (SELECT *, round(CASE WHEN contains(lower(table_name), lower(keyword)) THEN least(least(matching_columns / 5, 1.0) + 0.3, 1.0)
    ELSE least(matching_columns / 5, 1.0) END, 2) AS score FROM matches),
seen AS (SELECT w.qid, w.seq, s.*, row_number() OVER (PARTITION BY w.qid, s.table_name
    ORDER BY w.seq, s.matching_columns DESC) AS nth FROM words w JOIN scored s USING (keyword)),
hits AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seq, matching_columns DESC, table_name) AS rank FROM seen WHERE nth = 1)
"""


def words(spark, d):
    return S.question_keywords(view(spark, d, "questions"))


@query("keyword_search", MATCH_SQL + "SELECT keyword, table_name, description, columns_list, matching_columns FROM matches")
def keyword_search(spark, d):
    return S.keyword_search(words(spark, d), search_tables(spark, d)).select(
        "keyword", "table_name", "description", F.array_join("columns", ", ").alias("columns_list"), "matching_columns"
    )


@query("keyword_score", MATCH_SQL + "SELECT keyword, table_name, matching_columns, score FROM scored")
def keyword_score(spark, d):
    return S.keyword_score(S.keyword_search(words(spark, d), search_tables(spark, d))).select(
        "keyword", "table_name", "matching_columns", "score"
    )


def hits(spark, d):
    return S.keyword_hits(view(spark, d, "questions"), search_tables(spark, d))


@query("first_seen_dedup", MATCH_SQL + "SELECT qid, rank, table_name, score FROM hits WHERE rank <= 5")
def first_seen_dedup(spark, d):
    return hits(spark, d).select("qid", "rank", "table_name", "score")


def _index(spark, d):
    return load(spark, d, "embeddings").select(
        F.concat(F.lit("vec_"), F.lpad(F.col("vec_id").cast("string"), 12, "0")).alias("doc_id"), "embedding",
        F.lit("local").alias("server"), F.lit("main").alias("database"),
        F.concat(F.lit("t"), "vec_id").alias("table_name"), F.lit("").alias("description"),
        F.array(F.concat(F.lit("label_"), "label")).alias("columns"),
    )


@query("search_with_fallback", "WITH " + RANKED_SQL + """
SELECT 'vector' AS path, CAST(qid AS BIGINT) AS qid, rank, concat('t', id) AS table_name, score, concat('label_', label) AS columns
FROM ranked WHERE rank <= 5 AND score >= 0.3
""")
def search_with_fallback(spark, d):
    """Filled index: the vector path answers."""
    asked = centroids(spark, d).withColumn("qid", F.col("qid").cast("bigint"))
    found, _ = S.search_with_fallback(asked, _index(spark, d), search_tables(spark, d))
    return found.select(F.lit("vector").alias("path"), "qid", "rank", "table_name", "score", F.array_join("columns", ", ").alias("columns"))


@query("search_with_fallback_empty", MATCH_SQL + """
SELECT q.qid, CASE WHEN count(h.qid) > 0 THEN 'success' ELSE 'empty' END AS status, count(h.qid) AS n_hits,
       coalesce(string_agg(h.table_name, ', ' ORDER BY h.rank), '') AS tables_found
FROM questions q LEFT JOIN hits h ON h.qid = q.qid AND h.rank <= 5 GROUP BY q.qid
""")
def search_with_fallback_empty(spark, d):
    """Empty index: keywords answer; status and tables per question."""
    found, status = S.search_with_fallback(view(spark, d, "questions"), None, search_tables(spark, d))
    tables = S._joined(found, "qid", "rank", "table_name", ", ")
    counts = found.groupBy("qid").agg(F.count(F.lit(1)).alias("n_hits"))
    return status.join(tables, "qid", "left").join(counts, "qid", "left").select(
        "qid", "status", F.coalesce("n_hits", F.lit(0)).alias("n_hits"), F.coalesce("table_name", F.lit("")).alias("tables_found")
    )


@query("search_context", MATCH_SQL + """,
entries AS (SELECT qid, rank, concat('  Таблица: ', table_name, ' [main]', chr(10), '  Описание: ',
    CASE WHEN description <> '' THEN description ELSE 'нет' END, chr(10), '  Колонки: ',
    array_to_string(list_slice(string_split(columns_list, ', '), 1, 15), ', ')) AS entry FROM hits WHERE rank <= 5)
SELECT q.qid, coalesce('Найденные таблицы (по поиску):' || chr(10) || string_agg(entry, chr(10) ORDER BY rank),
                       'Информация о схеме БД не найдена.') AS context
FROM questions q LEFT JOIN entries e USING (qid) GROUP BY q.qid
""")
def search_context(spark, d):
    return S.search_context(view(spark, d, "questions"), hits(spark, d))


@query("result_context", """
WITH numbered AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn,
                         count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
runs AS (SELECT o_custkey, any_value(n) AS n, string_agg(concat('  • o_orderkey: ', o_orderkey, ', o_orderstatus: ', o_orderstatus,
    ', o_orderpriority: ', o_orderpriority), chr(10) ORDER BY rn) AS lines FROM numbered WHERE rn <= 5 GROUP BY o_custkey)
SELECT c_custkey, CASE WHEN lines IS NULL THEN 'Запрос выполнен, но данных не найдено.' ELSE
  concat('Данные из БД (', least(n, 10), ' строк', CASE WHEN n > 10 THEN ', обрезано до 5' ELSE '' END, '):', chr(10), lines) END AS context
FROM customer LEFT JOIN runs ON o_custkey = c_custkey
""")
def result_context(spark, d):
    """One run per customer asking for their orders, capped at ten rows."""
    lines = S.row_lines(
        load(spark, d, "orders"), "o_custkey", ["o_orderkey"], ["o_orderkey", "o_orderstatus", "o_orderpriority"], max_rows=10
    ).withColumnRenamed("o_custkey", "c_custkey")
    runs = load(spark, d, "customer").select("c_custkey").join(lines, "c_custkey", "left").withColumn(
        "exec_status", F.when(F.col("lines").isNull(), "empty").otherwise("success")
    )
    return S.result_context(runs).select("c_custkey", "context")


# Runs that end in each of the ways a result text can have, by the customer's key.
RUN_ENDS = """c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 'orders (score=0.3), nation (score=0.2)' END AS tables_found,
  CASE WHEN c_custkey % 6 = 1 THEN c_mktsegment END AS schema_table, c_custkey % 9 AS schema_columns,
  CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 100 END AS schema_rows, CASE WHEN c_custkey % 6 = 2 THEN c_name END AS explanation,
  CASE WHEN c_custkey % 6 = 3 THEN 'error' WHEN c_custkey % 6 = 4 THEN 'empty' END AS exec_status,
  CASE WHEN c_custkey % 10 < 8 THEN c_name END AS exec_message, CASE WHEN c_custkey % 7 = 0 THEN 'late' WHEN c_custkey % 7 = 1 THEN '' END AS error"""
SCHEMA_SQL = S.SCHEMA.replace("'", "''")


@query("result_context_ends", f"""
WITH runs AS (SELECT {RUN_ENDS} FROM customer),
parts AS (SELECT c_custkey, concat_ws(chr(10) || chr(10), '{S.FOUND}' || tables_found,
  '{SCHEMA_SQL}' || schema_table || chr(39) || ': ' || schema_columns || '{S.SCHEMA_COLUMNS}' || coalesce(schema_rows::VARCHAR, '?') || '{S.SCHEMA_ROWS}',
  '{S.GENERATED}' || explanation, CASE exec_status WHEN 'empty' THEN '{S.NO_DATA}' WHEN 'error' THEN '{S.EXECUTION_FAILED}' || exec_message END,
  CASE WHEN error <> '' THEN '{S.AGENT_FAILED}' || error END) AS text FROM runs)
SELECT c_custkey, CASE WHEN text <> '' THEN text ELSE '{S.NO_RESULTS}' END AS context FROM parts
""")
def result_context_ends(spark, d):
    """Texts of runs that found tables, read a schema, wrote SQL, failed, found nothing, or broke off."""
    runs = spark.sql(f"SELECT {RUN_ENDS} FROM {{customer}}", customer=load(spark, d, "customer"))
    empty = runs.withColumns({"lines": F.lit(None).cast("string"), "row_count": F.lit(0), "truncated": F.lit(False)})
    return S.result_context(empty).select("c_custkey", "context")


@query("collect_sources", MATCH_SQL + """, read AS (
SELECT qid, 'orders' AS table_name FROM questions WHERE text LIKE 'Order%' UNION ALL
SELECT qid, 'conversations' FROM questions WHERE text LIKE 'zzz%'),
cited AS (SELECT qid, table_name, 0 AS part, rank FROM hits WHERE rank <= 5 UNION ALL SELECT qid, table_name, 1, 1 FROM read),
firsts AS (SELECT qid, table_name, min(part * 1000 + rank) AS pos FROM cited GROUP BY qid, table_name)
SELECT qid, 'local' AS server, 'main' AS database, table_name, pos // 1000 AS part, pos % 1000 AS rank FROM firsts
""")
def collect_sources(spark, d):
    q = view(spark, d, "questions")
    table = F.when(F.col("text").startswith("Order"), "orders").when(F.col("text").startswith("zzz"), "conversations")
    read = q.select("qid", F.lit("local").alias("server"), F.lit("main").alias("database"), table.alias("table_name")).where(
        "table_name IS NOT NULL"
    )
    return S.collect_sources(hits(spark, d), read).select(
        "qid", "server", "database", "table_name", F.col("pos.part").alias("part"), F.col("pos.rank").alias("rank")
    )
