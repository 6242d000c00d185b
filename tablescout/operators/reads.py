"""Read-only SQL under a row cap."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescout.functions.text import needs_row_cap
from tablescout.operators.audit import MAX_ROWS
from tablescout.session import small_frame


@dataclass(frozen=True)
class BoundedResult:
    """``rows`` is None when the text was refused; ``status`` is one row."""

    rows: DataFrame | None
    status: DataFrame


STATUS_SCHEMA = "sql STRING, status STRING, columns STRING, row_count BIGINT, truncated BOOLEAN, more_rows BOOLEAN, error STRING"


# Functions that call any method of the JVM.
CALLS_OUT = {"reflect", "java_method", "try_reflect"}
# Parts of a plan that run programs, or names that are only known once computed.
REFUSED_NODES = ("ScriptTransformation", "PlanWithUnresolvedIdentifier", "ExpressionWithUnresolvedIdentifier")


class RefusedQuery(ValueError):
    """The text is a query, but reaches beyond the tables and views of the session."""


def _nodes(tree) -> Iterator[dict]:
    if isinstance(tree, dict):
        yield tree
        tree = list(tree.values())
    if isinstance(tree, list):
        for part in tree:
            yield from _nodes(part)


def _names(text: str) -> list[str]:
    return text.strip("[]").split(", ")


def check_reach(spark: SparkSession, sql: str) -> None:
    """Refuse a query that calls JVM methods, runs programs, or reads files by path.

    The parsed text is looked at, before anything in it is resolved: a relation of several names must be a
    table or view the session knows, so ``parquet.`/path` `` is none.
    """
    parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql).toJSON()
    for node in _nodes(json.loads(parsed)):
        kind = str(node.get("class", "")).rsplit(".", 1)[-1]
        if kind.endswith(REFUSED_NODES):
            raise RefusedQuery(kind)
        if "Function" in kind and "nameParts" in node and _names(node["nameParts"])[-1].lower() in CALLS_OUT:
            raise RefusedQuery(node["nameParts"])
        if kind == "UnresolvedRelation":
            names = _names(node["multipartIdentifier"])
            if len(names) > 1 and not spark.catalog.tableExists(".".join(f"`{n.replace('`', '``')}`" for n in names)):
                raise RefusedQuery(node["multipartIdentifier"])


def as_subquery(spark: SparkSession, sql: str, args=None) -> DataFrame:
    """Parse ``sql`` in a place where only a query can stand, see ``check_reach`` for what else is refused.

    Commands would run at once if given to ``spark.sql`` directly; as a subquery they are
    syntax errors. The line breaks keep a trailing comment from swallowing the bracket.
    """
    wrapped = f"SELECT * FROM (\n{sql}\n) AS bounded"
    check_reach(spark, wrapped)
    return spark.sql(wrapped, args=args)


def bounded_read(spark: SparkSession, sql: str, args=None, max_rows: int = MAX_ROWS) -> BoundedResult:
    """At most ``max_rows`` rows of a query, with success / empty / error status.

    ``truncated`` follows the text rule (a cap was put in and reached); ``more_rows`` tells
    whether a further row really exists.
    """
    try:
        query = as_subquery(spark, sql, args)
    except (AnalysisException, ParseException, RefusedQuery) as e:
        condition = None if isinstance(e, RefusedQuery) else e.getCondition()
        refused = (sql, "error", None, None, None, None, condition or "REFUSED")
        return BoundedResult(None, small_frame(spark, [refused], STATUS_SCHEMA))
    rows = query.limit(max_rows)
    seen = query.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"))
    row_count = F.least(F.col("n"), F.lit(max_rows))
    status = seen.select(
        F.lit(sql).alias("sql"),
        F.when(F.col("n") > 0, "success").otherwise("empty").alias("status"),
        F.when(F.col("n") > 0, F.lit(", ".join(query.columns))).otherwise("").alias("columns"),
        row_count.cast("bigint").alias("row_count"),
        (needs_row_cap(F.lit(sql), max_rows) & (row_count == max_rows)).alias("truncated"),
        (F.col("n") > max_rows).alias("more_rows"),
        F.lit(None).cast("string").alias("error"),
    )
    return BoundedResult(rows, status)


def scalar_read(spark: SparkSession, sql: str, args=None) -> DataFrame:
    """First column of the first row as column ``value``; one NULL row if there is none."""
    query = as_subquery(spark, sql, args)
    names = ["value", *[f"c{i}" for i in range(1, len(query.columns))]]
    first = query.toDF(*names).select("value").limit(1)
    return first.agg(F.first("value").alias("value"))
