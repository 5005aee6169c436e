"""Comparing results, nearest-rank percentiles and distinct counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two results have the same rows as often (set equality in both directions)."""
    columns = sorted(a.columns)
    if columns != sorted(b.columns):
        return False
    a, b = a.select(columns), b.select(columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def nearest_rank(df: DataFrame, value: str, shares: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """For each group the value at place floor(n * share) (from 0) of the sorted values, the largest and the mean.

    Values are counted first, so the running sum that gives the ranks passes over distinct values
    only, and rows never meet by group. Null values are left out.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*by)
    ranked = counts.withColumns({"_upto": F.sum("_n").over(group.orderBy(value)), "_all": F.sum("_n").over(group)})
    place = lambda s: F.floor(F.col("_all") * F.lit(s))
    holds = lambda s: (F.col("_upto") - F.col("_n") <= place(s)) & (place(s) < F.col("_upto"))
    picks = [F.max(F.when(holds(s), F.col(value))).alias(name) for name, s in shares.items()]
    mean = F.sum(F.col(value).cast("double") * F.col("_n")) / F.sum("_n")
    return ranked.groupBy(*by).agg(*picks, F.max(value).alias("largest"), mean.alias("mean"))


def median_of(df: DataFrame, value: str, by: tuple[str, ...]) -> DataFrame:
    """The exact median, between the middle two where they are two."""
    return df.groupBy(*by).agg(F.expr(f"percentile({value}, 0.5)").alias("median"))


def checksum(df: DataFrame) -> DataFrame:
    """Row count and an order-free checksum of all columns."""
    return df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*df.columns)).alias("checksum"))
