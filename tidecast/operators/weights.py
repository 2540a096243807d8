"""Dollar-share weights and top-down disaggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidecast.functions.scalars import ratio
from tidecast.session import materialize


def trailing_dollar_sales(
    sales: DataFrame, calendar: DataFrame, prices: DataFrame, first: int, last: int, keys: Sequence[str]
) -> DataFrame:
    """Dollar sales per series over the days ``[first, last]``.

    ``sales`` holds a row for every series and day. A series without a price on
    any of the days is left out, as the day-by-day inner joins would do.
    """
    days = calendar.select("day_num", "wm_yr_wk").where(F.col("day_num").between(first, last))
    weeks = days.select("wm_yr_wk").distinct()
    recent = prices.join(weeks, "wm_yr_wk", "left_semi")
    priced = (
        sales.where(F.col("day_num").between(first, last))
        .join(days, "day_num")
        .join(recent, ["store_id", "item_id", "wm_yr_wk"])
    )
    return (
        priced.groupBy(*keys)
        .agg(
            F.coalesce(F.sum(F.col("sell_price") * F.col("sales")), F.lit(0.0)).alias("dollar_sales"),
            F.count("day_num").alias("priced_days"),  # a series has one row a day
        )
        .where(F.col("priced_days") == last - first + 1)
        .drop("priced_days")
    )


def row_sum(df: DataFrame, prefix: str, name: str) -> DataFrame:
    """Sum across all columns of one name prefix, nulls skipped."""
    cols = [c for c in df.columns if c.startswith(prefix)]
    total = F.aggregate(F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in cols]), F.lit(0.0), lambda a, x: a + x)
    return df.withColumn(name, total)


def dollar_share(dollars: DataFrame, group: Sequence[str] = ("store_id", "dept_id")) -> DataFrame:
    """Share of each series in its group's dollars; null when the group sold nothing.

    Group totals are aggregated map-side and joined back, so a group that holds
    most of the series is never sorted into one window partition. ``dollars`` is
    read twice: pass a written frame.
    """
    totals = dollars.groupBy(*group).agg(F.sum("dollar_sales").alias("dept_dollars"))
    return dollars.join(totals, list(group), "left").withColumn(
        "weight", ratio(F.col("dollar_sales"), F.col("dept_dollars"))
    )


def share_over_window(df: DataFrame, group: Sequence[str], value: str, name: str) -> DataFrame:
    """Share of the partition total as a window; for groups of bounded size."""
    return df.withColumn(name, ratio(F.col(value), F.sum(value).over(W.partitionBy(*group))))


def dollar_share_weights(
    sales: DataFrame, calendar: DataFrame, prices: DataFrame, first: int, last: int, keys: Sequence[str]
) -> DataFrame:
    """Weights of the trailing days; the dollar sales (one row per series) are written in between."""
    return dollar_share(materialize(trailing_dollar_sales(sales, calendar, prices, first, last, keys), "dollars"))


def disaggregate(ids: DataFrame, weights: DataFrame, forecast: DataFrame, yhat: str = "demand_fcast") -> DataFrame:
    """Item forecast = department forecast x item weight, one row per id and forecast day."""
    weighted = ids.join(weights.select("item_id", "store_id", "weight"), ["item_id", "store_id"], "left")
    return weighted.join(forecast.select("store_id", "dept_id", "day_num", yhat), ["store_id", "dept_id"], "left").withColumn(
        "demand_submission", F.col(yhat) * F.col("weight")
    )


def check_totals(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum of every numeric column per group (weights must total 1)."""
    numeric = [n for n, t in df.dtypes if n not in keys and (t in ("double", "float", "int", "bigint", "smallint", "tinyint") or t.startswith("decimal"))]
    return df.groupBy(*keys).agg(*[F.sum(c).alias(f"sum_{c}") for c in numeric])
