"""Join that keeps working when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TASK_ROWS = 1_000_000  # rows of one key that a task may get


def hot_keys(rows: DataFrame, on: list[str], task_rows: int = TASK_ROWS) -> DataFrame:
    """Keys with more than ``task_rows`` rows, and over how many tasks each is to be spread; NULL keys match nothing and are left out.

    There are at most as many of them as ``task_rows`` goes into the number of rows.
    """
    counts = rows.dropna(subset=on).groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > task_rows)
    return counts.select(*on, F.ceil(F.col("_n") / task_rows).cast("int").alias("_salts"))


def salted_join(
    left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", spread_by: list[str] | None = None, task_rows: int = TASK_ROWS
) -> DataFrame:
    """``left.join(right, on, how)`` for inner and left joins with hot keys on the left.

    Rows of a hot key are spread over as many salts as its count asks for, by a hash of ``spread_by``, and the
    matching right rows are repeated that often; all other rows keep salt 0. The hash is computed from row values,
    so a recomputed task places its rows where they were. Rows with a NULL key never meet the right side: a
    left join adds them at the end, and they are not shuffled. The hot keys are counted within the plan; their table, one millionth of the rows
    at most, is sent to every task.
    """
    if how not in ("inner", "left"):
        raise ValueError("only inner and left joins can be salted on the left")
    hot = F.broadcast(hot_keys(left, on, task_rows))
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on])
    spread = F.pmod(F.xxhash64(*(spread_by or left.columns)), F.coalesce("_salts", F.lit(1))).cast("int")
    salted_left = left.where(known).join(hot, on, "left").withColumn("_salt", spread).drop("_salts")
    copies = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    salted_right = right.join(hot, on, "left").withColumn("_salt", F.explode(copies)).drop("_salts")
    joined = salted_left.join(salted_right, [*on, "_salt"], how).drop("_salt")
    if how == "left":
        joined = joined.unionByName(left.where(~known), allowMissingColumns=True)
    return joined
