"""Catalog listings, row counts, and the keys and references nobody declared."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tablescout.functions.text import format_type
from tablescout.operators.keys import _comparable, candidate_keys, known_facts
from tablescout.session import small_frame


def catalog_tables(cat: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Tables with description and column counts. ``descriptions``: (table_name, table_description)."""
    counted = cat.groupBy("server", "database", "table_name").agg(
        F.count(F.lit(1)).alias("column_count"), F.count_if("is_nullable").alias("nullable_columns")
    )
    return counted.join(descriptions, "table_name", "left")


def catalog_columns(cat: DataFrame, table: str | None = None) -> DataFrame:
    rows = cat if table is None else cat.where(F.col("table_name") == table)
    return rows.select("table_name", "column_id", "column_name", "data_type", "is_nullable", "description")


def column_details(cat: DataFrame, table: str | None = None) -> DataFrame:
    rows = cat if table is None else cat.where(F.col("table_name") == table)
    printed = format_type(F.col("data_type"), F.col("char_max_length"), F.col("precision"), F.col("scale"))
    return rows.withColumn("type_text", printed)


def table_row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table; ``row_count`` shows an empty table as unknown, ``exact_rows`` as 0.

    One scan without columns over all tables and one small shuffle.
    """
    spark = next(iter(tables.values())).sparkSession
    names = small_frame(spark, [(t,) for t in tables], "table_name STRING")
    rows = reduce(DataFrame.union, [df.select(F.lit(t).alias("table_name")) for t, df in tables.items()])
    counts = rows.groupBy("table_name").agg(F.count(F.lit(1)).alias("row_count"))
    return names.join(counts, "table_name", "left").select(
        "table_name", "row_count", F.coalesce("row_count", F.lit(0)).alias("exact_rows")
    )


def facts_frame(spark: SparkSession, facts: dict) -> DataFrame:
    """Known facts as a table, for ``observed_catalog``."""
    names = ["table_name", "column_name", "n_nulls", "max_chars"]
    rows = [tuple(f[n] for n in names) for f in facts.values()]
    return small_frame(spark, rows, "table_name STRING, column_name STRING, n_nulls BIGINT, max_chars INT")


def shared_suffix(a, b):
    """Whether two names end alike: equal, or one is the other after an underscore, or both are after their first."""
    def tail(c):
        return F.regexp_replace(c, "^[^_]*_", "")

    return (a == b) | a.endswith(F.concat(F.lit("_"), b)) | b.endswith(F.concat(F.lit("_"), a)) | (
        F.contains(a, F.lit("_")) & F.contains(b, F.lit("_")) & (tail(a) == tail(b)))


def inclusion_dependencies(spark: SparkSession, tables: dict[str, DataFrame], facts=None, key_columns: set[tuple[str, str]] | None = None) -> DataFrame:
    """Columns whose every value occurs in a key column of the same kind (numbers, text, times), ranked.

    Pairs are first ruled out by the range of values. For the columns left, each value is reduced, map-side already, to the set of columns it
    occurs in, kept as bits; only the few different sets are then counted against the pairs. Ranked by ``same_suffix`` (see ``shared_suffix``),
    ``named`` (the column's name holds the referenced table's), and by the share of the key's values that is referred to.
    """
    facts = facts or known_facts(tables)
    if key_columns is None:
        keys = candidate_keys(spark, tables, max_width=1, facts=facts)
        key_columns = {(r["table_name"], r["key_columns"]) for r in keys.collect()}
    names = ["family", "min_number", "max_number", "min_text", "max_text"]
    listed = [(t, c, i, (t, c) in key_columns, *(f[n] for n in names)) for i, ((t, c), f) in enumerate(facts.items()) if f["family"]]
    columns = small_frame(spark, listed, "t STRING, c STRING, i INT, is_key BOOLEAN, family STRING, min_number DECIMAL(38, 6), max_number DECIMAL(38, 6), "
                                         "min_text STRING, max_text STRING")
    dep, ref = columns.alias("d"), columns.where("is_key").alias("r")
    within = """(d.t <> r.t OR d.c <> r.c) AND ((d.min_number >= r.min_number AND d.max_number <= r.max_number)
        OR (d.min_text >= r.min_text AND d.max_text <= r.max_text))"""
    pairs = dep.join(ref, F.expr("d.family = r.family AND " + within)).select(
        F.col("d.i").alias("dep"), F.col("r.i").alias("ref"), F.col("d.t").alias("dep_table"), F.col("d.c").alias("dep_column"),
        F.col("r.t").alias("ref_table"), F.col("r.c").alias("ref_column"))
    listed_pairs = pairs.collect()  # catalog rows only
    pairs = small_frame(spark, listed_pairs, pairs.schema)
    used = sorted({i for r in listed_pairs for i in (r["dep"], r["ref"])})
    bit = {i: n for n, i in enumerate(used)}
    words = [f"w{n}" for n in range(len(used) // 63 + 1)]
    parts = []
    for t in tables:
        cells = [
            F.struct(F.lit(fam).alias("family"), _comparable(c, fam).alias("value"),
                     *(F.lit(1 << (bit[i] % 63) if bit[i] // 63 == n else 0).cast("bigint").alias(w) for n, w in enumerate(words)))
            for name, c, i, _, fam, *_ in listed if name == t and i in bit
        ]
        if cells:
            parts.append(tables[t].select(F.inline(F.array(*cells))).where("value IS NOT NULL"))
    if not parts:
        parts = [spark.range(0).selectExpr("'' AS family", "'' AS value", *[f"0L AS {w}" for w in words])]
    per_value = reduce(DataFrame.union, parts).groupBy("family", "value").agg(*[F.bit_or(w).alias(w) for w in words])
    sets = per_value.groupBy(*words).agg(F.count(F.lit(1)).alias("n"))
    members = F.filter(F.array(*[F.when(F.getbit(F.col(words[n // 63]), F.lit(n % 63)) == 1, i) for i, n in bit.items()] or [F.lit(None).cast("int")]), lambda x: x.isNotNull())
    sets = sets.select(members.alias("cols"), "n")
    of_dep = sets.select(F.explode("cols").alias("dep"), "cols", "n")
    sizes = of_dep.groupBy("dep").agg(F.sum("n").alias("n_values"))
    common = of_dep.join(pairs.select("dep", "ref"), "dep").where(F.array_contains("cols", F.col("ref"))).groupBy("dep", "ref").agg(F.sum("n").alias("n_common"))
    named = F.contains(F.lower("dep_column"), F.lower("ref_table"))
    return (
        pairs.join(common, ["dep", "ref"])
        .join(sizes, "dep")
        .join(sizes.select(F.col("dep").alias("ref"), F.col("n_values").alias("ref_values")), "ref")
        .where(F.col("n_common") == F.col("n_values"))
        .select(
            "dep_table", "dep_column", "ref_table", "ref_column", shared_suffix(F.col("dep_column"), F.col("ref_column")).alias("same_suffix"),
            named.alias("named"), "n_values", F.round(F.col("n_values") / F.col("ref_values"), 6).alias("coverage"),
        )
        .orderBy(F.col("same_suffix").desc(), F.col("named").desc(), F.col("coverage").desc(), "dep_table", "dep_column", "ref_table", "ref_column")
    )


def references(included: DataFrame) -> DataFrame:
    """One referenced table per column that looks like a reference: ``dep_table, dep_column, ref_table, ref_column``.

    A column refers if its name ends like the key's or holds the other table's name; of several, the first in rank. Columns of a table
    do not refer to their own table.
    """
    rank = F.struct(F.col("same_suffix").cast("int") * -1, F.col("named").cast("int") * -1, -F.col("coverage"), "ref_table", "ref_column")
    likely = included.where("(same_suffix OR named) AND dep_table <> ref_table")
    return likely.groupBy("dep_table", "dep_column").agg(F.min_by(F.struct("ref_table", "ref_column"), rank).alias("r")).select(
        "dep_table", "dep_column", "r.*")


def orphan_check(tables: dict[str, DataFrame], relationships: list[tuple[str, str, str, str]]) -> DataFrame:
    """Rows breaking a relationship (child, child column, parent, parent column); NULL refers to nothing.

    One pass: each table is read once and gives a row for every relationship it is child or parent in, and equal
    keys of a relationship are added up map-side. A key shared by very many rows is one row for each task in the only shuffle
    of keys. Whole numbers are compared as such, whatever their width; other columns by their text.
    """
    if not relationships:
        raise ValueError("no relationships to check")

    def whole(table: str, column: str) -> bool:
        return isinstance(tables[table].schema[column].dataType, IntegralType)

    marks: dict[str, list[Column]] = {}
    for i, (child, fk, parent, pk) in enumerate(relationships):
        both = whole(child, fk) and whole(parent, pk)
        for table, column, is_child in ((child, fk, True), (parent, pk, False)):
            number = F.col(column).cast("bigint") if both else F.lit(None).cast("bigint")
            text = F.lit(None).cast("string") if both else F.col(column).cast("string")
            marks.setdefault(table, []).append(F.struct(
                F.lit(i).alias("rel"), number.alias("number"), text.alias("text"), F.lit(is_child).alias("is_child")))
    tagged = [tables[t].select(F.inline(F.array(*each))).where("number IS NOT NULL OR text IS NOT NULL") for t, each in marks.items()]
    keys = reduce(DataFrame.unionByName, tagged).groupBy("rel", "number", "text").agg(
        F.count_if("is_child").alias("n"), F.bool_and("is_child").alias("missing"))
    lost = F.col("missing") & (F.col("n") > 0)
    counted = keys.groupBy("rel").agg(
        F.sum("n").alias("n_refs"), F.coalesce(F.sum(F.when(lost, F.col("n"))), F.lit(0)).alias("n_orphan_rows"),
        F.count_if(lost).alias("n_orphan_keys"))
    spark = counted.sparkSession
    named = small_frame(spark, [(i, f"{c}.{fk}", f"{p}.{pk}") for i, (c, fk, p, pk) in enumerate(relationships)],
                        "rel INT, child STRING, parent STRING")
    return named.join(counted, "rel", "left").select(
        "child", "parent", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("n_refs", "n_orphan_rows", "n_orphan_keys")])


def table_schema_report(
    cat: DataFrame, row_counts: DataFrame, keys: DataFrame, references: DataFrame, requested: DataFrame
) -> DataFrame:
    """Structure of the requested tables: columns with key flags and row count; a message if unknown.

    A table's primary key is its first unique column, or else its first group of unique columns; ``refers_to`` names the key column a
    reference leads to, from ``references``.
    """
    first = keys.groupBy("table_name").agg(F.min_by("key_columns", F.struct("width", "key_columns")).alias("key_columns"))
    single = keys.where("width = 1").select("table_name", F.col("key_columns").alias("column_name"))
    first_single = cat.join(single, ["table_name", "column_name"]).groupBy("table_name").agg(F.min_by("column_name", "column_id").alias("one"))
    first_key = first.join(first_single, "table_name", "left").select(
        "table_name", F.explode(F.when(F.col("one").isNotNull(), F.array("one")).otherwise(F.split("key_columns", ","))).alias("column_name"), F.lit(True).alias("pk"))
    fks = references.select(
        F.col("dep_table").alias("table_name"), F.col("dep_column").alias("column_name"), F.lit(True).alias("fk"),
        F.concat_ws(".", "ref_table", "ref_column").alias("refers_to"))
    columns = (
        column_details(cat)
        .join(first_key, ["table_name", "column_name"], "left")
        .join(fks, ["table_name", "column_name"], "left")
    )
    known = F.col("column_name").isNotNull()
    return (
        requested.join(columns, "table_name", "left")
        .join(row_counts.select("table_name", "row_count"), "table_name", "left")
        .select(
            "table_name",
            F.when(known, "success").otherwise("empty").alias("status"),
            F.when(~known, F.concat(F.lit("table '"), "table_name", F.lit("' not found"))).alias("message"),
            "column_id", "column_name", "type_text", "is_nullable",
            F.when(known, F.coalesce("pk", F.lit(False))).alias("is_pk"),
            F.when(known, F.coalesce("fk", F.lit(False))).alias("is_fk"), "refers_to",
            "default_value", "description", "row_count",
        )
    )


def schema_docs_join(tables: DataFrame, columns: DataFrame, table_id: str, parent_id: str) -> DataFrame:
    """Documentation of columns joined to that of their tables."""
    return columns.join(tables.withColumnRenamed(table_id, parent_id), parent_id)
