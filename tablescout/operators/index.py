"""Search documents from a catalog, their incremental indexing, and their vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescout.session import small_frame
from tablescout.sources.sinks import IndexStore

PASSAGE, QUERY = "passage: ", "query: "
HASHED_WORD = r"[\p{L}\p{N}_]+"


def doc_id():
    return F.concat_ws("__", "server", "database", "table_name")


def index_whitelist(tables: DataFrame, keep: list[str]) -> DataFrame:
    """Mark tables as indexed or skipped; an empty list keeps all."""
    listed = F.col("table_name").isin(keep) if keep else F.lit(True)
    return tables.withColumn("action", F.when(listed, "indexed").otherwise("skipped"))


def knowledge_enrich(cat: DataFrame, knowledge: DataFrame) -> DataFrame:
    """Left join with the knowledge of a table; tables nobody described get empty lists.

    Both sides have one row per table or column of a schema; Catalyst broadcasts the
    knowledge side when its size allows.
    """
    return cat.join(knowledge.drop("field_hints"), "table_name", "left").withColumns({
        "business_description": F.coalesce(F.trim(F.regexp_replace("business_description", r"\s+$", "")), F.lit("")),
        "synonyms": F.coalesce("synonyms", F.array().cast("array<string>")),
        "relationships": F.coalesce("relationships", F.array().cast("array<string>")),
    })


def schema_documents(cat: DataFrame, descriptions: DataFrame, knowledge: DataFrame) -> DataFrame:
    """One search text per table: header, meaning, synonyms, relationships, codes, columns.

    Sections without content are left out (NULL parts of ``concat_ws``).
    """
    note = F.coalesce("description", F.lit(""))
    line = F.concat(
        F.lit("  - "), F.col("column_name"), F.lit(" ("), F.col("data_type"), F.lit(", "),
        F.when(F.col("is_nullable"), "NULL").otherwise("NOT NULL"), F.lit(")"),
        F.when(note != "", F.concat(F.lit(": "), note)).otherwise(""),
    )
    # as many entries per table as it has columns
    columns = cat.groupBy("server", "database", "table_name").agg(
        F.array_sort(F.collect_list(F.struct("column_id", "column_name", line.alias("line")))).alias("cols")
    )
    full = knowledge_enrich(columns.join(descriptions, "table_name", "left"), knowledge)
    enums = F.transform(
        F.array_sort(F.map_entries("enum_fields")),
        lambda e: F.concat(F.lit("  - "), e["key"], F.lit(": "), F.coalesce(e["value"]["description"], F.lit(""))),
    )
    description = F.coalesce("table_description", F.lit(""))

    def section(title, lines):
        return F.when(F.size(lines) > 0, F.concat_ws("\n", F.lit(title), F.array_join(lines, "\n")))

    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Таблица: "), "table_name"),
        F.concat(F.lit("База данных: "), "database"),
        F.concat(F.lit("Описание: "), F.when(description != "", description).otherwise("нет описания")),
        F.when(F.col("business_description") != "", F.concat(F.lit("Бизнес-смысл: "), "business_description")),
        F.when(F.size("synonyms") > 0, F.concat(F.lit("Синонимы и бизнес-термины: "), F.array_join("synonyms", ", "))),
        section("Связи с другими таблицами:", F.transform("relationships", lambda r: F.concat(F.lit("  "), r))),
        section("Поля-справочники (enum):", enums),
        F.lit("Колонки:"),
        F.array_join(F.transform("cols", lambda c: c["line"]), "\n"),
    )
    return full.select(
        doc_id().alias("doc_id"), text.alias("text"), "table_name", "server", "database",
        description.alias("description"),
        F.array_join(F.transform("cols", lambda c: c["column_name"]), ", ").alias("columns"),
    )


def incremental_actions(docs: DataFrame, existing: DataFrame | None, force: bool = False) -> DataFrame:
    """Every document with what happens to it: indexed, skipped (known id) or error (no text).

    Of several documents with one id in the batch, one is indexed and the others are skipped.
    """
    # looked at before the join, so that counting actions moves ids and flags, not texts
    marked = docs.withColumn("_broken", F.coalesce(F.trim("text"), F.lit("")) == "")
    known = F.lit(False)
    if existing is not None and not force:
        marked = marked.join(existing.select("doc_id", F.lit(True).alias("_known")), "doc_id", "left")
        known = F.coalesce("_known", F.lit(False))
    first = W.partitionBy("doc_id").orderBy("_broken", F.xxhash64(*docs.columns))
    marked = marked.withColumn("_again", F.row_number().over(first) > 1)
    action = F.when(known, "skipped").when(F.col("_broken"), "error").when(F.col("_again"), "skipped").otherwise("indexed")
    return marked.withColumn("action", action).drop("_known", "_broken", "_again")


def action_counts(actions: DataFrame) -> DataFrame:
    return actions.groupBy("action").agg(F.count(F.lit(1)).alias("n_documents"))


def incremental_index(
    store: IndexStore, docs: DataFrame, encode: Callable[[DataFrame], DataFrame] | None = None, force: bool = False
) -> DataFrame:
    """Index the documents the store does not hold yet; counts per action.

    Only new rows are encoded; ``force`` rebuilds everything. Counts come from comparing
    with the index as it was before.
    """
    before = store.read()
    actions = incremental_actions(docs, before, force)
    new = actions.where("action = 'indexed'").drop("action")
    if encode:
        new = encode(new)
    if force or before is None:
        store.replace(new)
    else:
        store.append(new)
    return action_counts(actions)


def index_if_empty(
    store: IndexStore, docs: DataFrame, encode: Callable[[DataFrame], DataFrame] | None = None, force: bool = False
) -> DataFrame:
    """Build only an index that has no documents yet."""
    if not force and not store.is_empty():
        return small_frame(docs.sparkSession, [("already_built", 0)], "action STRING, n_documents BIGINT")
    return incremental_index(store, docs, encode, force)


def index_stats(index: DataFrame, **settings: str) -> DataFrame:
    fixed = [F.lit(v).alias(k) for k, v in settings.items()]
    return index.agg(F.count(F.lit(1)).alias("total_documents")).select("*", *fixed)


def encode_hashed(texts: DataFrame, key: str, prefix: str = PASSAGE, text: str = "text", dims: int = 64) -> DataFrame:
    """``key`` and a unit ``embedding`` of hashed words of the prefixed text, by DataFrame functions that need no model and no fit.

    A word goes to the bucket its MD5 names; a bucket weighs one plus the logarithm of its count. Words are counted map-side. Rows of one ``key`` are one text.
    """
    words = F.regexp_extract_all(F.lower(F.concat(F.lit(prefix), F.coalesce(F.col(text), F.lit("")))), F.lit(HASHED_WORD), F.lit(0))
    bucket = F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("bigint") % dims
    counted = texts.select(key, F.explode(words).alias("word")).groupBy(key, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    weighed = counted.select(key, "bucket", (1 + F.log("n")).alias("w")).groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("bucket", "w"))).alias("cells"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    cell = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(dims - 1).cast("bigint")),
                       lambda b: F.coalesce(F.try_element_at("cells", b), F.lit(0.0)) / F.col("length"))
    return weighed.select(key, cell.alias("embedding"))


def encode_with(
    texts: DataFrame,
    encoder_factory: Callable[[], Callable[[list[str]], list[list[float]]]],
    prefix: str = PASSAGE,
    text: str = "text",
) -> DataFrame:
    """Add ``embedding`` by a user's encoder, built once per task and fed whole batches."""
    schema = T.StructType([*texts.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])
    names = [f.name for f in schema.fields]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_factory()
        for batch in batches:
            texts_of = batch.column(names.index(text)).to_pylist()
            vectors = np.asarray(encoder([prefix + (t or "") for t in texts_of]), np.float32).reshape(batch.num_rows, -1)
            ends = pa.array(np.arange(batch.num_rows + 1) * vectors.shape[1], pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(vectors.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=names)

    return texts.mapInArrow(encode, schema)


def fit_default_encoder(texts: DataFrame, text: str = "text", dims: int = 256) -> PipelineModel:
    """Hashed words weighted by rarity, scaled to unit length; needs no model file."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[^\p{L}\p{N}_]+"),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dims),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="_unit"),
    ]).fit(texts.where(F.col(text).isNotNull()).select(text))


def encode_default(texts: DataFrame, encoder: PipelineModel) -> DataFrame:
    """Add ``embedding`` by the default encoder, inside the JVM; a text without words gives zeros."""
    stages = encoder.transform(texts.na.fill("", ["text"]))
    return stages.withColumn("embedding", vector_to_array("_unit", "float32")).drop("_words", "_tf", "_idf", "_unit")
