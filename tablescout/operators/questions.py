"""The look-up, decode, join and aggregate questions users ask of their tables.

Sums over a many-to-one join are taken per join key before the join, so a key holding a
large share of the rows is reduced map-side and never travels row by row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablescout.functions.text import blank_concat
from tablescout.operators.skew import salted_join
from tablescout.session import kept


def point_lookup(df: DataFrame, key: str, value, *columns: str) -> DataFrame:
    return df.where(F.col(key) == F.lit(value)).select(*columns)


def filter_limit(df: DataFrame, condition, order_by: list, n: int) -> DataFrame:
    """First ``n`` matching rows in a stated order."""
    return df.where(condition).orderBy(*order_by).limit(n)


def count_all(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def max_date(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.max(column).alias("last_date"))


def age_years(column, as_of):
    """Calendar-year boundaries crossed, as ``DATEDIFF(YEAR, ...)`` counts them."""
    return F.year(as_of) - F.year(column)


def older_than(df: DataFrame, column: str, years: int, as_of: str) -> DataFrame:
    return df.withColumn("years", age_years(F.col(column), F.lit(as_of).cast("date"))).where(
        F.col("years") > years
    )


def sum_per_person(persons: DataFrame, debts: DataFrame, person_key: str, debt_key: str, amount: str) -> DataFrame:
    """Each person that has debts, with their number and sum."""
    per_key = debts.groupBy(F.col(debt_key).alias(person_key)).agg(
        F.count(F.lit(1)).alias("n_debts"), F.sum(amount).alias("total_sum")
    )
    return persons.join(per_key, person_key)


def person_debts(persons: DataFrame, debts: DataFrame, person_key: str, debt_key: str) -> DataFrame:
    """One row per debt with the columns of its person."""
    return salted_join(debts.withColumnRenamed(debt_key, person_key), persons, [person_key])


def full_name(df: DataFrame, *parts) -> DataFrame:
    return df.withColumn("full_name", blank_concat(*parts))


def decode(df: DataFrame, column: str, code_dict: DataFrame, dict_code: int) -> DataFrame:
    """Add the name of a code; only the rows of the given dictionary take part.

    Without that filter a code shared by several dictionaries would multiply rows.
    """
    names = code_dict.where(F.col("dict_code") == dict_code).select(
        F.col("code").alias(column), F.col("name").alias(f"{column}_name")
    )
    return df.join(names, column, "left")


def decoded_totals(
    persons: DataFrame, debts: DataFrame, code_dict: DataFrame, dict_code: int,
    person_key: str, debt_key: str, status: str, amount: str, group: str,
) -> DataFrame:
    """Debt sum per person group and decoded status."""
    per_person = debts.groupBy(F.col(debt_key).alias(person_key), status).agg(
        F.count(F.lit(1)).alias("n"), F.sum(amount).alias("s")
    )
    joined = per_person.join(persons.select(person_key, group), person_key)
    per_code = joined.groupBy(group, status).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    return decode(per_code, status, code_dict, dict_code)


def latest_n(df: DataFrame, order_col: str, key: str, n: int) -> DataFrame:
    return df.orderBy(F.col(order_col).desc(), F.col(key)).limit(n)


def latest_n_per_key(df: DataFrame, group: str, order_col: str, key: str, n: int) -> DataFrame:
    """Last ``n`` rows of every group; each task keeps only ``n`` per group before the shuffle."""
    w = W.partitionBy(group).orderBy(F.col(order_col).desc(), F.col(key))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def latest_per_key(df: DataFrame, group: str, order_col: str, key: str) -> DataFrame:
    """Last date of every group and the key of the row holding it (highest key on ties)."""
    return df.groupBy(group).agg(F.max(F.struct(order_col, key)).alias("m")).select(group, "m.*")


def tagged_union(tables: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """(obj, r_id, target_name) over several keyed tables given as (df, key, name column)."""
    out = None
    for tag, (df, key, name) in tables.items():
        part = df.select(
            F.lit(tag).alias("obj"), F.col(key).cast("bigint").alias("r_id"), F.col(name).alias("target_name")
        )
        out = part if out is None else out.unionByName(part)
    return out


def resolve_links(links: DataFrame, targets: DataFrame) -> DataFrame:
    """Every link with the name of the row it points to; NULL name marks a dangling link."""
    return salted_join(links, targets, ["obj", "r_id"], "left", spread_by=["id"])


def dangling_links(links: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets that do not exist, with the number of links pointing there."""
    per_target = links.groupBy("obj", "r_id").agg(F.count(F.lit(1)).alias("n_links"))
    return per_target.join(targets, ["obj", "r_id"], "left_anti")


def parent_chain_totals(lineitem: DataFrame, orders: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
    """Revenue and line count per nation along lineitem → orders → customer → nation."""
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    per_order = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(revenue).alias("v")
    )
    per_customer = (
        per_order.join(orders.select("o_orderkey", "o_custkey"), "o_orderkey")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    )
    per_nation = (
        per_customer.join(customer.select("c_custkey", "c_nationkey"), "c_custkey")
        .groupBy(F.col("c_nationkey").alias("n_nationkey"))
        .agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    )
    return per_nation.join(nation.select("n_nationkey", "n_name"), "n_nationkey")


def hierarchy(rows: DataFrame, key: str, parent: str) -> DataFrame:
    """Where every row of a parent table ends: (id, root, depth, status).

    ``status`` is ``root`` (no parent), ``linked`` (leads to a root), ``orphan`` (its parent does not exist), ``under_orphan`` (leads to
    an orphan), ``cycle`` (on a cycle, its own parent included) or ``into_cycle``. ``root`` is the row where the chain ends and ``depth`` the
    number of steps to it; both are NULL for the last two. Rows without a key are left out; of rows with equal keys the
    one with the smallest parent counts, rows without a parent last.

    Pointer doubling: in every round each open row jumps to the ancestor of its ancestor, so a chain of n rows takes log2(n)
    rounds. Rows that reached their end leave the rounds. Round k ends all rows up to 2^k steps from their end, and a longer chain has
    rows of every such length, so once a round ends none, all open rows lead into cycles. The rows they point to are then fewer from
    round to round, until a jump only permutes them: these are the rows on cycles. Every round is a table in the shared folder.
    """
    links = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.min(parent).alias("parent"))
    known = links.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    nodes = kept(salted_join(links, known, ["parent"], "left", spread_by=["id"]))
    # where a row points, how many steps that is, and whether it ends there
    ends = F.col("parent").isNull() | F.col("known").isNull()
    state = nodes.select(
        "id", F.when(ends, F.col("id")).otherwise(F.col("parent")).alias("at"),
        F.when(ends, 0).otherwise(1).cast("bigint").alias("depth"), ends.alias("closed"),
    )
    targets, closed, open_ = state, [state.where("closed")], state.where("NOT closed")
    pointed = F.count_distinct(F.when(~F.col("closed"), F.col("at")))
    left = state.agg(pointed).first()[0]
    while left:
        step = targets.select(
            F.col("id").alias("at"), F.col("at").alias("next"), F.col("depth").alias("more"), F.col("closed").alias("done")
        )
        jumped = kept(salted_join(open_, step, ["at"], "inner", spread_by=["id"]).select(
            "id", F.col("next").alias("at"), (F.col("depth") + F.col("more")).alias("depth"), F.col("done").alias("closed")
        ))
        closed.append(jumped.where("closed"))
        open_ = jumped.where("NOT closed")
        targets = reduce(DataFrame.unionByName, [*closed, open_])
        ended, now = jumped.agg(F.count_if("closed"), pointed).first()
        if not ended and now == left:
            break
        left = now
    own = nodes.select(
        "id", F.when(F.col("parent").isNull(), "root").when(F.col("known").isNull(), "orphan").alias("own")
    )
    ended = reduce(DataFrame.unionByName, closed)
    kinds = own.where("own IS NOT NULL").select(F.col("id").alias("at"), "own")
    found = salted_join(ended, kinds, ["at"], "inner", spread_by=["id"]).select(
        "id", F.col("at").alias("root"), "depth",
        F.when(F.col("depth") == 0, F.col("own")).when(F.col("own") == "root", "linked").otherwise("under_orphan").alias("status"),
    )
    on_cycle = open_.select(F.col("at").alias("id")).distinct().withColumn("on", F.lit(True))
    nothing = F.lit(None)
    astray = open_.join(on_cycle, "id", "left").select(
        "id", nothing.cast(links.schema["id"].dataType).alias("root"), nothing.cast("bigint").alias("depth"),
        F.when(F.col("on"), "cycle").otherwise("into_cycle").alias("status"),
    )
    return found.unionByName(astray)
