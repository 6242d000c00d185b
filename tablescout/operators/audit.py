"""Query-log audit: write statements, row caps, error texts. One map-side pass over the log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.functions import text as X

MAX_ROWS = 100


def find_mutations(log: DataFrame, sql: str = "sql") -> DataFrame:
    return log.withColumn("mutations", X.write_words(F.col(sql)))


def audit_readonly(log: DataFrame, sql: str = "sql", is_safe: str | None = None) -> DataFrame:
    """``readonly`` as run scoring sees it; a row without SQL passes."""
    clean = ~X.has_write_word(F.col(sql), X.SCORED_WRITE_WORDS)
    if is_safe:
        clean = clean & F.coalesce(F.col(is_safe), F.lit(False))
    return log.withColumn("readonly", F.when(F.col(sql).isNull(), F.lit(True)).otherwise(clean))


def audit_row_cap(log: DataFrame, sql: str = "sql", limit: int = MAX_ROWS) -> DataFrame:
    text = F.col(sql)
    return log.select(
        "*",
        X.own_row_cap(text).cast("bigint").alias("own_cap"),
        X.with_row_cap(text, limit).alias("capped_sql"),
        X.needs_row_cap(text, limit).alias("was_limited"),
    )


def error_triage(log: DataFrame, message: str = "error_text") -> DataFrame:
    text = F.col(message)
    return log.select(
        "*",
        X.is_rate_limit(text).alias("rate_limited"),
        X.retry_after(text).alias("retry_after_s"),
        X.retry_after_strict(text).alias("retry_after_strict_s"),
    )
