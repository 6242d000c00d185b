"""Catalog of tables as DataFrames: one row per column, with types, notes and observed facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescout.session import small_frame

CATALOG_SCHEMA = """
server STRING, database STRING, table_name STRING, column_id INT, column_name STRING, data_type STRING,
precision INT, scale INT, char_max_length STRING, is_nullable BOOLEAN, default_value STRING, description STRING
"""


def _type_facts(dt: T.DataType) -> tuple[str, int | None, int | None]:
    if isinstance(dt, T.DecimalType):
        return "decimal", dt.precision, dt.scale
    if isinstance(dt, T.StringType):
        return "varchar", None, None
    if isinstance(dt, T.TimestampNTZType):
        return "timestamp", None, None
    return dt.simpleString(), None, None


def catalog(
    spark: SparkSession,
    tables: dict[str, DataFrame],
    server: str = "local",
    database: str = "main",
    notes: dict[str, str] | None = None,
) -> DataFrame:
    """Columns of the given tables from their schemas alone; reads no data.

    ``notes`` maps column names to descriptions. Declared string lengths are taken from
    field metadata (``max_length``), defaults from ``default``.
    """
    rows = []
    for name, df in tables.items():
        for i, f in enumerate(df.schema.fields, 1):
            base, precision, scale = _type_facts(f.dataType)
            length = f.metadata.get("max_length")
            rows.append((
                server, database, name, i, f.name, base, precision, scale,
                None if length is None else str(length), f.nullable,
                f.metadata.get("default"), (notes or {}).get(f.name),
            ))
    return small_frame(spark, rows, CATALOG_SCHEMA)


def family(dt: T.DataType) -> str | None:
    """Kinds of key columns whose values can be compared with each other."""
    if isinstance(dt, (T.IntegralType, T.DecimalType)):
        return "number"
    if isinstance(dt, T.StringType):
        return "text"
    return "time" if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)) else None


FACTS = ("nulls", "chars", "bounds")


def column_facts(tables: dict[str, DataFrame], wanted: tuple[str, ...] = FACTS) -> DataFrame:
    """Observed facts, one row per column, from one map-side pass over each table.

    Row count, and of the ``wanted`` ones: NULL count, longest text, smallest and largest value of key columns (numbers in
    ``min_number, max_number``, others as text). A fact that is not wanted is NULL and not read for.
    """
    parts = []
    for name, df in tables.items():
        facts = []
        for i, f in enumerate(df.schema.fields, 1):
            c, kind = f"`{f.name}`", family(f.dataType)
            number, text = kind == "number" and "bounds" in wanted, kind in ("text", "time") and "bounds" in wanted
            chars = isinstance(f.dataType, T.StringType) and "chars" in wanted
            facts.append(f"""named_struct(
                'column_id', {i}, 'column_name', '{f.name}', 'family', {f"'{kind}'" if kind else "CAST(NULL AS STRING)"},
                'n_rows', count(1), 'n_nulls', {f"count(1) - count({c})" if "nulls" in wanted else "CAST(NULL AS BIGINT)"},
                'max_chars', CAST({f"max(length({c}))" if chars else "NULL"} AS INT),
                'min_number', CAST({f"min({c})" if number else "NULL"} AS DECIMAL(38, 6)),
                'max_number', CAST({f"max({c})" if number else "NULL"} AS DECIMAL(38, 6)),
                'min_text', CAST({f"min({c})" if text else "NULL"} AS STRING), 'max_text', CAST({f"max({c})" if text else "NULL"} AS STRING))""")
        parts.append(
            df.agg(F.expr(f"array({', '.join(facts)})").alias("facts"))
            .select(F.lit(name).alias("table_name"), F.inline("facts"))
        )
    return reduce(DataFrame.union, parts)


def observed_catalog(cat: DataFrame, facts: DataFrame) -> DataFrame:
    """Catalog whose nullability and text lengths are those seen in the data."""
    seen = facts.select("table_name", "column_name", "n_nulls", "max_chars")
    return cat.join(seen, ["table_name", "column_name"]).select(
        "server", "database", "table_name", "column_id", "column_name", "data_type", "precision", "scale",
        F.coalesce("char_max_length", F.col("max_chars").cast("string")).alias("char_max_length"),
        (F.col("n_nulls") > 0).alias("is_nullable"), "default_value", "description",
    )
