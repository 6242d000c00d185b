"""Readers for single tables, (server, database, SQL) sources, knowledge files and test cases."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescout.session import small_frame

KNOWLEDGE_SCHEMA = T.StructType([
    T.StructField("table_name", T.StringType()),
    T.StructField("business_description", T.StringType()),
    T.StructField("synonyms", T.ArrayType(T.StringType())),
    T.StructField("relationships", T.ArrayType(T.StringType())),
    T.StructField("enum_fields", T.MapType(T.StringType(), T.StructType([
        T.StructField("description", T.StringType()),
        T.StructField("how_to_decode", T.StringType()),
    ]))),
    T.StructField("field_hints", T.MapType(T.StringType(), T.StringType())),
])

CASE_SCHEMA = """
id STRING, category STRING, description STRING, input STRING, expected_query_type STRING,
expected_tools ARRAY<STRING>, expected_answer_contains ARRAY<STRING>, must_execute_sql BOOLEAN,
success_criteria ARRAY<STRING>
"""


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class Source:
    """One table of one database of one server.

    ``fmt`` is a Spark reader format. For ``jdbc`` give ``options`` with the url and, to
    split the read, ``partitionColumn/lowerBound/upperBound/numPartitions``.
    """

    server: str
    database: str
    table: str
    path: str | None = None
    fmt: str = "parquet"
    options: dict[str, str] = field(default_factory=dict)


def jdbc_options(source: Source, query: str | None = None) -> dict[str, str]:
    """Reader options: a split read names ``dbtable``, a plain one may push ``query`` down."""
    options = dict(source.options)
    split = "partitionColumn" in options
    if query is None:
        options["dbtable"] = source.table
    elif split:
        options["dbtable"] = f"({query}) AS q"
    else:
        options["query"] = query
    return options


def read_source(spark: SparkSession, source: Source, query: str | None = None) -> DataFrame:
    """Rows of a source; ``query`` is SQL naming the source's table."""
    if source.fmt == "jdbc":
        return spark.read.format("jdbc").options(**jdbc_options(source, query)).load()
    df = spark.read.format(source.fmt).options(**source.options).load(source.path)
    if query is None:
        return df
    df.createOrReplaceTempView(source.table)
    return spark.sql(query)


def federate(
    spark: SparkSession,
    sources: Iterable[Source],
    shape: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> tuple[DataFrame | None, DataFrame]:
    """Union of all readable sources tagged with their origin, and one status row per source.

    A source that cannot be read is reported and skipped. Columns missing in one source
    come out NULL.
    """
    rows, status = None, []
    for s in sources:
        try:
            df = shape(read_source(spark, s)).select(
                F.lit(s.server).alias("server"), F.lit(s.database).alias("database"), "*"
            )
        except PySparkException as e:
            status.append((s.server, s.database, s.table, "error", e.getCondition() or "READ_FAILED"))
            continue
        except Py4JJavaError as e:  # a driver that cannot connect
            status.append((s.server, s.database, s.table, "error", str(e.java_exception)))
            continue
        status.append((s.server, s.database, s.table, "success", None))
        rows = df if rows is None else rows.unionByName(df, allowMissingColumns=True)
    report = small_frame(spark, status, "server STRING, database STRING, table_name STRING, status STRING, error STRING"
    )
    return rows, report


def load_knowledge(spark: SparkSession, path: str) -> DataFrame:
    """Knowledge file (a JSON array); a missing or unreadable file gives no rows."""
    try:
        df = spark.read.schema(KNOWLEDGE_SCHEMA).option("mode", "DROPMALFORMED").json(path, multiLine=True)
        return df.where("table_name IS NOT NULL")
    except AnalysisException:
        return small_frame(spark, [], KNOWLEDGE_SCHEMA)


def read_knowledge(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """Knowledge entries that can be used, and one status row for every entry in the file.

    The file is a JSON array, or with ``multi_line=False`` one entry on each line. Status rows are (entry, table_name,
    status, problem). ``entry`` counts from 0 in an array; lines have no order in a distributed read and carry NULL.
    Status is ``ok``; ``malformed`` (no JSON, or no object); ``unnamed`` (no ``table_name``); or ``bad_field`` (a field that is not of
    its type, named in ``problem``). An array that is no JSON as a whole is one malformed entry. Blank lines are no entries. Only ``ok``
    entries are returned as rows of ``KNOWLEDGE_SCHEMA``. A missing file raises the reader's error.
    """
    text = spark.read.text(path, wholetext=multi_line).where("trim(value) <> ''")
    if multi_line:
        whole = text.select(F.try_parse_json("value").alias("v"))
        listed = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array(F.col("v")))
        entries = whole.select(F.posexplode(listed).alias("entry", "v"))
    else:
        entries = text.select(F.lit(None).cast("int").alias("entry"), F.try_parse_json("value").alias("v"))
    is_object = F.coalesce(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), F.lit(False))
    fields = KNOWLEDGE_SCHEMA.fields
    values = {f.name: F.try_variant_get("v", f"$.{f.name}", f.dataType.simpleString()) for f in fields}
    raw = {f.name: F.try_variant_get("v", f"$.{f.name}", "variant") for f in fields}
    wrong = F.array_compact(F.array(*[
        F.when(raw[n].isNotNull() & ~F.is_variant_null(raw[n]) & values[n].isNull(), F.lit(n)) for n in values
    ]))
    checked = entries.select("entry", is_object.alias("is_object"), wrong.alias("wrong"), *[values[n].alias(n) for n in values])
    status = (
        F.when(~F.col("is_object"), "malformed").when(F.size("wrong") > 0, "bad_field")
        .when(F.col("table_name").isNull(), "unnamed").otherwise("ok")
    )
    judged = checked.withColumn("status", status)
    problem = F.when(F.col("status") == "bad_field", F.array_join("wrong", ","))
    return (
        judged.where("status = 'ok'").select(*values),
        judged.select("entry", "table_name", "status", problem.alias("problem")),
    )


def knowledge_entries(knowledge: DataFrame) -> DataFrame:
    """Synonyms, relationships and enum fields as (table_name, kind, entry) rows."""
    def tagged(kind, values):
        return F.transform(
            F.coalesce(values, F.array()),
            lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("entry")),
        )

    entries = F.concat(
        tagged("synonym", F.col("synonyms")),
        tagged("relationship", F.col("relationships")),
        tagged("enum", F.map_keys("enum_fields")),
    )
    return knowledge.select("table_name", F.explode(entries).alias("e")).select("table_name", "e.*")


def load_cases(
    spark: SparkSession, path: str, category: str | None = None, case_id: str | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """Test cases, filtered; an empty selection is an error."""
    cases = spark.read.schema(CASE_SCHEMA).json(path, multiLine=multi_line)
    if category:
        cases = cases.where(F.col("category") == category)
    if case_id:
        cases = cases.where(F.col("id") == case_id)
    if cases.isEmpty():
        raise ValueError(f"no cases for category={category}, id={case_id}")
    return cases
