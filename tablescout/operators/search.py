"""Search for batches of questions: exact and approximate vector top-k, keywords, contexts."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.errors import PythonException
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescout.functions import text as X
from tablescout.functions.vectors import arrow_matrix, cosine, unit_rows
from tablescout.operators.nearest import TOP_K, _rank, vector_top_k
from tablescout.session import small_frame

MIN_SIMILARITY = 0.3


def random_planes(tables: int, bits: int, dims: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((tables, bits, dims))


def buckets(df: DataFrame, vector: str, planes: np.ndarray) -> DataFrame:
    """A row for each hash table, with the bucket of the row's vector in it: the signs of its projections read as bits."""
    tables, bits, dims = planes.shape

    def code(batches):
        for batch in batches:
            signs = (unit_rows(arrow_matrix(batch.column(vector), dims)) @ planes.reshape(-1, dims).T > 0).reshape(-1, tables, bits)
            codes = signs @ (1 << np.arange(bits))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, tables), pa.int32()), pa.array(codes.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "_codes"])

    schema = T.StructType([*df.schema.fields, T.StructField("_codes", T.ArrayType(T.LongType()))])
    coded = df.where(F.col(vector).isNotNull()).mapInArrow(code, schema)
    return coded.select(*df.columns, F.posexplode("_codes").alias("_table", "_bucket"))


def vector_top_k_approx(
    queries: DataFrame, corpus: DataFrame, planes: np.ndarray, k: int = TOP_K, keep: list[str] | None = None
) -> DataFrame:
    """Nearest rows among those sharing a hash bucket with the query in at least one table.

    ``planes`` are random directions (tables, bits, dimensions). More tables find more of the true neighbours; more bits look at
    fewer rows. Queries and corpus meet by an equi join on (table, bucket), where Spark splits hot buckets; every
    (query, row) pair is scored once.
    """
    keep = keep or []
    asked = buckets(queries.select("qid", "vector"), "vector", planes).select("qid", "_table", "_bucket")
    held = buckets(corpus.select("id", "embedding"), "embedding", planes).select("id", "_table", "_bucket")
    pairs = asked.join(held, ["_table", "_bucket"]).select("qid", "id").distinct()
    scored = pairs.join(queries.select("qid", "vector"), "qid").join(corpus.select("id", "embedding", *keep), "id")
    scored = scored.withColumn("cos", F.round(cosine(F.col("vector"), F.col("embedding")), 12))
    return _rank(scored.select("qid", "id", *keep, "cos"), k)


def recall(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact hits the approximate search found."""
    found = exact.select("qid", "id").join(approx.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left")
    return found.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def similarity_filter(hits: DataFrame, threshold: float = MIN_SIMILARITY) -> DataFrame:
    """Keep scores at or above the threshold: after top-k and after rounding."""
    return hits.where(F.col("score") >= threshold)


# -- keyword search ---------------------------------------------------------------------


def extract_keywords(questions: DataFrame, text: str = "text") -> DataFrame:
    return questions.withColumn("keywords", X.keywords(F.col(text)))


def question_keywords(questions: DataFrame) -> DataFrame:
    """One row per question and keyword, in order."""
    # the outer form keeps the optimizer from testing the size of the list by building it again
    words = extract_keywords(questions).select("qid", F.posexplode_outer("keywords").alias("seq", "keyword"))
    return words.where("keyword IS NOT NULL")


def searchable(cat: DataFrame, descriptions: DataFrame) -> DataFrame:
    """One row per table: description and ordered column names."""
    # as many entries per table as it has columns
    columns = cat.groupBy("server", "database", "table_name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("column_id", "column_name"))), lambda c: c["column_name"]).alias("columns")
    )
    return columns.join(descriptions, "table_name", "left").select(
        "server", "database", "table_name", F.coalesce("table_description", F.lit("")).alias("description"), "columns"
    )


def _count_columns(pairs: DataFrame) -> DataFrame:
    word = F.lower("keyword")
    return pairs.withColumn("matching_columns", F.size(F.filter("columns", lambda c: F.contains(F.lower(c), word))))


def keyword_search(keywords: DataFrame, tables: DataFrame) -> DataFrame:
    """Tables whose name, description or a column contains the keyword.

    ``keywords``: a ``keyword`` column; each distinct one is looked up once, and the match is
    taken literally (as LIKE with escaped wildcards). Keywords reach tables by an equi join on the keyword's rarest group of up to
    three letters; of the tables so met, those that hold the whole keyword stay.
    """
    words = keywords.select("keyword").distinct().withColumn("_word", F.lower("keyword"))
    word = F.col("_word")
    holds = F.contains(F.lower("table_name"), word) | F.contains(F.lower("description"), word) | F.exists(
        "columns", lambda c: F.contains(F.lower(c), word))
    return _count_columns(_by_grams(words, tables).where(holds)).drop("_word")


def _by_grams(words: DataFrame, tables: DataFrame) -> DataFrame:
    """Pairs sharing the keyword's rarest three letters (all of them if it is shorter)."""
    def grams(text, size):
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (size - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))

    keys = ["server", "database", "table_name"]
    texts = F.concat(F.array("table_name", "description"), F.col("columns"))
    in_tables = (
        tables.select(*keys, F.explode(F.transform(texts, F.lower)).alias("t"))
        .select(*keys, F.explode(F.concat(
            F.array(F.lit("")), grams(F.col("t"), 1), grams(F.col("t"), 2), grams(F.col("t"), 3)
        )).alias("gram"))
        .distinct()
    )
    frequency = in_tables.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    low = F.col("_word")
    own = F.when(F.length(low) >= 3, grams(low, 3)).otherwise(F.array(low))
    candidates = words.select("keyword", "_word", F.explode(F.array_distinct(own)).alias("gram"))
    # a group of letters no table has rules the keyword out
    rarest = candidates.join(frequency, "gram", "left").groupBy("keyword", "_word").agg(
        F.min_by("gram", F.coalesce("n", F.lit(0))).alias("gram"), F.min(F.coalesce("n", F.lit(0))).alias("n")
    ).where("n > 0").drop("n")
    return rarest.join(in_tables, "gram").drop("gram").join(tables, keys)


def keyword_score(matches: DataFrame) -> DataFrame:
    """A fifth per matching column, 0.3 more for the table name, at most 1."""
    by_columns = F.least(F.col("matching_columns") / 5.0, F.lit(1.0))
    named = F.contains(F.lower("table_name"), F.lower("keyword"))
    score = F.when(named, F.least(by_columns + 0.3, F.lit(1.0))).otherwise(by_columns)
    return matches.withColumn("score", F.round(score, 2))


def first_seen_dedup(scored: DataFrame, k: int = TOP_K, best: bool = False) -> DataFrame:
    """One row per question and table: the first seen in source, keyword, count, name order.

    Then the ``k`` best scores per question, earlier seen first on ties. ``best`` keeps the
    highest score of a table instead of the first. The first of a table is found by an aggregate that map tasks
    combine, and the ranking keeps ``k`` rows per question in every task before it moves them.
    """
    keys = ["qid", "server", "database", "table_name"]
    seen = [F.col("seq"), -F.col("matching_columns")]
    order = F.struct(*([-F.col("score")] if best else []), *seen)
    rest = [c for c in scored.columns if c not in keys]
    one = scored.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_first"))
    one = one.select(*keys, "_first.*").select(scored.columns)
    ranked = W.partitionBy("qid").orderBy(F.col("score").desc(), "server", "database", "seq", F.col("matching_columns").desc(), "table_name")
    return one.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def keyword_hits(questions: DataFrame, tables: DataFrame, k: int = TOP_K) -> DataFrame:
    """Questions to ranked tables by keywords.

    Names and scores of the distinct keywords' matches meet the questions by keyword; descriptions and columns are added to the
    final hits. How the sides of each join are moved, and hot keywords split, is left to Spark's adaptive plan.
    """
    words = question_keywords(questions)
    scored = keyword_score(keyword_search(words, tables)).drop("description", "columns")
    ranked = first_seen_dedup(words.join(scored, "keyword"), k).drop("seq", "keyword", "matching_columns")
    return ranked.join(tables, ["server", "database", "table_name"])


def _raised(error: PythonException) -> str | None:
    """Class of the exception a task ended with: the last line of its traceback names it, after whatever led to it."""
    lines = re.findall(r"^(?:\w+\.)*(\w+(?:Error|Exception))(?=:|\s*$)", str(error), re.MULTILINE)
    return lines[-1] if lines else None


HIT_COLUMNS = ["qid", "rank", "server", "database", "table_name", "description", "score", "columns"]


def search_with_fallback(
    questions: DataFrame, index: DataFrame | None, tables: DataFrame, k: int = TOP_K,
    threshold: float = MIN_SIMILARITY, encode=None,
) -> tuple[DataFrame, DataFrame]:
    """Vector search if the index holds documents, else keyword search; hits and status rows.

    ``questions``: (qid, text) and, unless ``encode`` adds it, ``vector``. A RuntimeError of the
    vector path, also one raised in a task that encodes the questions, leads to keywords, any other failure to status error.
    The questions are encoded before this returns, so their failures are seen here. An empty vector answer stays empty.
    """
    def by_keywords():
        return keyword_hits(questions, tables, k).select(*HIT_COLUMNS)

    spark = questions.sparkSession
    try:
        if index is None or index.isEmpty():
            hits = by_keywords()
        else:
            try:
                asked = encode(questions) if encode else questions
                corpus = index.withColumnRenamed("doc_id", "id")
                found = vector_top_k(asked, corpus, k, ["server", "database", "table_name", "description", "columns"])
                hits = similarity_filter(found, threshold).select(*HIT_COLUMNS)
            except (RuntimeError, PythonException) as e:
                if isinstance(e, PythonException) and _raised(e) != "RuntimeError":
                    raise
                hits = by_keywords()
    except Exception as e:  # noqa: BLE001 - the answer to a batch is its status, not a crash
        empty = small_frame(spark, [], "qid BIGINT, rank INT, server STRING, database STRING, table_name STRING, "
                                          "description STRING, score DOUBLE, columns ARRAY<STRING>")
        status = questions.select("qid", F.lit("error").alias("status"), F.lit(str(e)).alias("error"))
        return empty, status
    counts = hits.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    status = questions.select("qid").join(counts, "qid", "left").select(
        "qid", F.when(F.col("n") > 0, "success").otherwise("empty").alias("status"), F.lit(None).cast("string").alias("error")
    )
    return hits, status


# -- texts built from results --------------------------------------------------------------


# Wording of the context texts.
FOUND_HEADER = "Найденные таблицы (по поиску):"
NOTHING_FOUND = "Информация о схеме БД не найдена."
NO_RESULTS = "Результатов нет."
NO_DATA = "Запрос выполнен, но данных не найдено."
DETAIL_HEADER = "\nДетальная схема таблицы "
TABLE, DESCRIPTION, NO_DESCRIPTION, COLUMNS = "  Таблица: ", "]\n  Описание: ", "нет", "\n  Колонки: "
FOUND, SCHEMA, SCHEMA_COLUMNS, SCHEMA_ROWS = "Найденные таблицы: ", "Схема таблицы '", " колонок, ~", " строк"
GENERATED, DATA, DATA_ROWS, DATA_CUT = "SQL сгенерирован. ", "Данные из БД (", " строк", ", обрезано до 5"
EXECUTION_FAILED, AGENT_FAILED, ROW_MARK = "Ошибка выполнения запроса: ", "Ошибка агента: ", "  • "


def _joined(parts, key, order, text, sep):
    """Texts of at most a few rows per key, joined in order."""
    return parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("p")).select(
        key, F.array_join(F.transform("p", lambda x: x[text]), sep).alias(text)
    )


def schema_detail(columns: DataFrame) -> DataFrame:
    """Per table one text listing its columns with type, PK / FK / NULL flags and description.

    ``columns`` is the success part of ``table_schema_report``.
    """
    flags = F.array_compact(F.array(
        F.when(F.col("is_pk"), "PK"), F.when(F.col("is_fk"), "FK"), F.when(F.col("is_nullable"), "NULL")
    ))
    line = F.concat(
        F.lit("  - "), "column_name", F.lit(" ("), "type_text", F.lit(")"),
        F.when(F.size(flags) > 0, F.concat(F.lit(" ["), F.array_join(flags, ", "), F.lit("]"))).otherwise(""),
        F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(": "), "description")).otherwise(""),
    )
    lines = _joined(columns.withColumn("detail", line), "table_name", "column_id", "detail", "\n")
    return lines.withColumn(
        "detail", F.concat(F.lit(DETAIL_HEADER), "table_name", F.lit(":\n"), "detail")
    )


def search_context(questions: DataFrame, hits: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """Per question the text about its first five hits, fifteen columns each.

    ``details``: optional (qid, detail) with the structure of a table read for the question.
    """
    entry = F.concat(
        F.lit(TABLE), "table_name", F.lit(" ["), "database", F.lit(DESCRIPTION),
        F.when(F.coalesce("description", F.lit("")) != "", F.col("description")).otherwise(NO_DESCRIPTION),
        F.lit(COLUMNS), F.array_join(F.slice("columns", 1, 15), ", "),
    )
    shown = hits.where(F.col("rank") <= 5).select("qid", "rank", entry.alias("found"))
    out = questions.select("qid").join(_joined(shown, "qid", "rank", "found", "\n"), "qid", "left")
    parts = [F.when(F.col("found").isNotNull(), F.concat(F.lit(FOUND_HEADER + "\n"), "found"))]
    if details is not None:
        out = out.join(details, "qid", "left")
        parts.append(F.col("detail"))
    text = F.concat_ws("\n", *parts)
    return out.select("qid", F.when(text != "", text).otherwise(NOTHING_FOUND).alias("context"))


def row_lines(rows: DataFrame, run: str, order_by: list, columns: list[str], shown: int = 5, max_rows: int = 100) -> DataFrame:
    """Per run the text of its first rows as ``name: value`` pairs, with the capped row count.

    Each task keeps only ``shown`` rows per run before the shuffle; rows are counted apart.
    """
    w = W.partitionBy(run).orderBy(*order_by)
    pairs = F.concat_ws(", ", *[
        F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("None"))) for c in columns
    ])
    top = rows.select(run, F.concat(F.lit(ROW_MARK), pairs).alias("lines"), F.row_number().over(w).alias("_n")).where(F.col("_n") <= shown)
    texts = _joined(top, run, "_n", "lines", "\n")
    counts = rows.groupBy(run).agg(F.count(F.lit(1)).alias("n"))
    return texts.join(counts, run).select(
        run, "lines", F.least(F.col("n"), F.lit(max_rows)).alias("row_count"), (F.col("n") > max_rows).alias("truncated")
    )


def result_context(runs: DataFrame) -> DataFrame:
    """Text of what a run produced, from the columns it has among: tables_found,
    schema_table/schema_columns/schema_rows, explanation, exec_status/lines/row_count/truncated/exec_message, error."""
    has = set(runs.columns)
    parts = []
    if "tables_found" in has:
        parts.append(F.when(F.col("tables_found") != "", F.concat(F.lit(FOUND), "tables_found")))
    if "schema_table" in has:
        parts.append(F.concat(
            F.lit(SCHEMA), "schema_table", F.lit("': "), F.col("schema_columns").cast("string"), F.lit(SCHEMA_COLUMNS),
            F.coalesce(F.col("schema_rows").cast("string"), F.lit("?")), F.lit(SCHEMA_ROWS),
        ))
    if "explanation" in has:
        parts.append(F.concat(F.lit(GENERATED), "explanation"))
    if "exec_status" in has:
        data = F.concat(
            F.lit(DATA), F.col("row_count").cast("string"), F.lit(DATA_ROWS),
            F.when(F.col("truncated"), DATA_CUT).otherwise(""), F.lit("):\n"), "lines",
        )
        failed = F.concat(F.lit(EXECUTION_FAILED), "exec_message") if "exec_message" in has else F.lit(None)
        parts.append(F.when(F.col("exec_status") == "success", data).when(F.col("exec_status") == "empty", NO_DATA)
                     .when(F.col("exec_status").isNotNull(), failed))
    if "error" in has:
        parts.append(F.when(F.col("error") != "", F.concat(F.lit(AGENT_FAILED), "error")))
    text = F.concat_ws("\n\n", *parts)
    return runs.withColumn("context", F.when(text != "", text).otherwise(NO_RESULTS))


def collect_sources(hits: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """Tables a run cites: search hits, then the table whose structure was read; first mention kept."""
    cited = hits.select("qid", "server", "database", "table_name", F.struct(F.lit(0).alias("part"), "rank").alias("pos"))
    if schemas is not None:
        cited = cited.unionByName(schemas.select(
            "qid", "server", "database", "table_name", F.struct(F.lit(1).alias("part"), F.lit(1).alias("rank")).alias("pos")
        ))
    return cited.groupBy("qid", "server", "database", "table_name").agg(F.min("pos").alias("pos"))
