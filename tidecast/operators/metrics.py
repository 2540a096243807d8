"""Forecast errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rmse(y: str, yhat: str) -> Column:
    return F.sqrt(F.avg(F.pow(F.col(y) - F.col(yhat), F.lit(2.0))))


def rmse_by(df: DataFrame, keys: Sequence[str], y: str, yhat: str, name: str = "rmse") -> DataFrame:
    return df.groupBy(*keys).agg(rmse(y, yhat).alias(name))


def wrmse_by(
    df: DataFrame, window: str, keys: Sequence[str], weights: DataFrame, y: str, yhat: str, weight: str = "dollar_sales"
) -> DataFrame:
    """Sum over series of weight x RMSE per window; the weights are used as given."""
    per_series = rmse_by(df, [window, *keys], y, yhat)
    weighted = per_series.join(weights.select(*keys, weight), list(keys))
    return weighted.groupBy(window).agg(F.sum(F.col(weight) * F.col("rmse")).alias("wrmse"))


def rmse_models(df: DataFrame, keys: Sequence[str], y: str, models: dict[str, str]) -> DataFrame:
    """RMSE of several forecasts of the same rows, pooled over series."""
    return df.groupBy(*keys).agg(*[rmse(y, c).alias(name) for name, c in models.items()])
