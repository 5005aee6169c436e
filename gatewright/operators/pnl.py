"""Fund P&L by two independent aggregations, and their tie-out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE = "0.01"


def bottom_up(positions: DataFrame) -> DataFrame:
    """Sum over instruments of the change since the instrument's row before, by fund and date.

    The first row of an instrument has no change; gaps are spanned. A date whose rows are all
    first ones has no figure.
    """
    series = Window.partitionBy("fund_id", "instrument_id").orderBy("position_date")
    change = F.col("market_value") - F.lag("market_value").over(series)
    return positions.select("fund_id", "position_date", change.alias("change")).where(F.col("change").isNotNull()).groupBy("fund_id", "position_date").agg(F.sum("change").alias("bottom_up"))


def top_down(positions: DataFrame) -> DataFrame:
    """Change of the fund's total since its date before."""
    totals = positions.groupBy("fund_id", "position_date").agg(F.sum("market_value").alias("total"))
    change = F.col("total") - F.lag("total").over(Window.partitionBy("fund_id").orderBy("position_date"))
    return totals.select("fund_id", "position_date", change.alias("top_down")).where(F.col("top_down").isNotNull())


def tie_out(positions: DataFrame) -> DataFrame:
    """All figures of both sides with ``mismatch``: one is missing, or they differ by more than 0.01."""
    both = bottom_up(positions).join(top_down(positions), ["fund_id", "position_date"], "full_outer")
    far = F.abs(F.col("bottom_up") - F.col("top_down")) > F.lit(TOLERANCE).cast("decimal(4,2)")
    return both.withColumn("mismatch", F.coalesce(far, F.lit(True)))


def densified(positions: DataFrame) -> DataFrame:
    """The full grid of each fund's instruments and all dates; a missing value is 0.

    The grid is the product of the (fund, instrument) pairs with the dates, which is what it
    means; the dates are a bounded calendar.
    """
    pairs = positions.select("fund_id", "instrument_id").distinct()
    dates = positions.agg(F.array_sort(F.collect_set("position_date")).alias("days"))
    grid = pairs.crossJoin(dates).select("fund_id", "instrument_id", F.explode("days").alias("position_date"))  # dates: one row
    zero = F.lit(0).cast(positions.schema["market_value"].dataType)
    return grid.join(positions, ["fund_id", "instrument_id", "position_date"], "left").withColumn("market_value", F.coalesce("market_value", zero))
