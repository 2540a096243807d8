"""Weights, disaggregation and submission tables on the bound test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.config import Study
from tidecast.functions.scalars import step_label
from tidecast.operators import reshape, weights
from tidecast.session import materialize
from tidecast.sources.binding import DEPT_KEYS, SERIES_KEYS, BoundTables


def trailing_dollars(t: BoundTables) -> DataFrame:
    s = t.study
    return weights.trailing_dollar_sales(
        t.sales(s.weight_first), t.calendar, t.prices, s.weight_first, s.train_last, ["id", *SERIES_KEYS]
    )


def item_weights(t: BoundTables) -> DataFrame:
    return weights.dollar_share(materialize(trailing_dollars(t), "dollars"))


def dept_weights(t: BoundTables) -> DataFrame:
    """Each (store, department)'s part of all trailing dollars: the scoring weights."""
    by_dept = trailing_dollars(t).groupBy(*DEPT_KEYS).agg(F.sum("dollar_sales").alias("dollar_sales"))
    by_dept = materialize(by_dept, "dept-dollars")
    grand = by_dept.agg(F.sum("dollar_sales"))
    return by_dept.withColumn("dollar_sales", F.col("dollar_sales") / grand.scalar())


def naive_forecast(t: BoundTables) -> DataFrame:
    """Department demand 28 days earlier, as a stand-in for a model."""
    s = t.study
    return t.panel(s.train_last - s.horizon + 1).select(
        *DEPT_KEYS,
        (F.col("day_num") + s.horizon).alias("day_num"),
        F.col("demand").alias("demand_fcast"),
    )


def submission_ids(t: BoundTables) -> DataFrame:
    return t.submission_ids()


def aggregate_submission(
    ids: DataFrame, item_weight: DataFrame, forecast: DataFrame, yhat: str, study: Study
) -> DataFrame:
    """Top-down submission: one row per id, columns F1..Fh.

    The department forecast is pivoted before it meets the ids, so the join
    carries one row per id instead of one per id and day.
    """
    days = list(range(study.forecast_first, study.forecast_last + 1))
    labels = [f"F{i}" for i in range(1, study.horizon + 1)]
    wide = reshape.pivot_horizon(forecast, DEPT_KEYS, "day_num", yhat, days).toDF(*DEPT_KEYS, *labels)
    weighted = ids.join(item_weight.select("item_id", "store_id", "weight"), ["item_id", "store_id"], "left")
    return weighted.join(wide, list(DEPT_KEYS), "left").select(
        "id", *[(F.col(c) * F.col("weight")).alias(c) for c in labels]
    )


def bottom_submission(forecast: DataFrame, day: str, value: str, first_day: int, horizon: int) -> DataFrame:
    """Item submission: steps labelled by day, pivoted, zero-filled, sorted, repeated under the second phase.

    A day without a forecast (an item that is not priced yet) is a zero in its own place; it moves no other day.
    """
    labels = [f"F{i}" for i in range(1, horizon + 1)]
    stepped = forecast.select("id", step_label(F.col(day) - (first_day - 1)).alias("F"), value)
    wide = reshape.pivot_horizon(stepped, ["id"], "F", value, labels).na.fill(0.0)
    other = wide.withColumn("id", F.replace("id", F.lit("evaluation"), F.lit("validation")))
    return reshape.union_all(wide, other).orderBy("id")
