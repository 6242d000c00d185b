"""Exact order statistics without sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Positive values are binned by logarithm; one bin spans a factor of exp(1/BINS_PER_E).
BINS_PER_E = 16384


def exclusive_p90(sorted_values: Column) -> Column:
    """Exclusive 90 % quantile of a sorted array; a single value is returned as it is.

    For short arrays held in one row. With n values and ranks from 1:
    j = clamp(9(n+1) div 10, 1, n-1), d = 9(n+1) - 10j, p90 = (a[j](10-d) + a[j+1] d) / 10.
    """
    n = F.size(sorted_values)
    j, d = _p90_rank(n)
    low = F.get(sorted_values, j.cast("int") - 1)
    high = F.get(sorted_values, j.cast("int"))
    return F.when(n == 1, F.get(sorted_values, F.lit(0))).when(n > 1, (low * (10 - d) + high * d) / 10)


def _p90_rank(n: Column) -> tuple[Column, Column]:
    nines = 9 * (n.cast("bigint") + 1)
    tenth = (nines - F.pmod(nines, F.lit(10))) / 10
    j = F.greatest(F.lit(1), F.least(tenth.cast("bigint"), n - 1)).cast("bigint")
    return j, nines - 10 * j


def exclusive_p90_by(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Exclusive 90 % quantile per group over positive values, exact, two passes.

    Pass 1 counts values per logarithmic bin, which map tasks combine. The cumulated counts
    tell which bins hold the two wanted ranks. Pass 2 keeps only the values of those bins (at most two per group, joined as
    Spark sees fit), again counted per distinct value before they move. No group is ever sorted as a whole.
    """
    positive = df.where(F.col(value) > 0).select(*by, F.col(value).cast("double").alias("v"))
    binned = positive.withColumn("bin", F.floor(F.log("v") * BINS_PER_E))
    per_bin = binned.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("c"))
    running = W.partitionBy(*by).orderBy("bin")
    whole = W.partitionBy(*by)
    n = F.col("n")
    wanted = (
        per_bin.withColumn("upto", F.sum("c").over(running))
        .withColumn("n", F.sum("c").over(whole))
        .withColumn("j", _p90_rank(n)[0])
        .withColumn("before", F.col("upto") - F.col("c"))
        .where(
            ((F.col("before") < F.col("j")) & (F.col("j") <= F.col("upto")))
            | ((F.col("before") < F.col("j") + 1) & (F.col("j") + 1 <= F.col("upto")))
        )
        .select(*by, "bin", "before", "n", "j")
    )
    counted = (
        binned.join(wanted, [*by, "bin"])
        .groupBy(*by, "bin", "before", "n", "j", "v")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    in_bin = W.partitionBy(*by, "bin").orderBy("v")
    upto = F.col("before") + F.sum("c").over(in_bin)
    ranked = counted.withColumn("upto", upto).withColumn("start", F.col("upto") - F.col("c"))

    def at(rank):
        return F.max(F.when((F.col("start") < rank) & (rank <= F.col("upto")), F.col("v")))

    d = _p90_rank(n)[1]
    return (
        ranked.groupBy(*by)
        .agg(
            F.max("n").alias("n"), F.max("j").alias("j"),
            at(F.col("j")).alias("low"), at(F.col("j") + 1).alias("high"),
        )
        .select(
            *by,
            F.when(n == 1, F.col("low")).otherwise((F.col("low") * (10 - d) + F.col("high") * d) / 10).alias("p90"),
        )
    )
