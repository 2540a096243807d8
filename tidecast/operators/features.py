"""Lags, leads, rolling means and cumulative levels over one series key.

All windows of one call share a partitioning and an ordering, so Catalyst plans
one exchange and one sort for all of them. A window partition is one series: it
holds at most one row per day, which bounds it by the length of the calendar.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tidecast.functions.scalars import date_features


def series_window(key: Sequence[str], order: str) -> WindowSpec:
    return W.partitionBy(*key).orderBy(order)


def add_lags(df: DataFrame, key: Sequence[str], order: str, col: str, lags: Mapping[str, int]) -> DataFrame:
    """Positional lags; ``lags`` maps a new column name to its distance in rows."""
    w = series_window(key, order)
    return df.withColumns({name: F.lag(col, n).over(w) for name, n in lags.items()})


def add_leads(df: DataFrame, key: Sequence[str], order: str, cols: Sequence[str], leads: Sequence[int]) -> DataFrame:
    """``L{n}_{col}``: the value ``n`` rows ahead (known future events)."""
    w = series_window(key, order)
    return df.withColumns({f"L{n}_{c}": F.lead(c, n).over(w) for n in leads for c in cols})


def trailing_mean(col: str, frame: WindowSpec, min_count: int) -> Column:
    return F.when(F.count(col).over(frame) >= min_count, F.avg(col).over(frame))


def add_rolling_means(
    df: DataFrame,
    key: Sequence[str],
    order: str,
    col: str,
    specs: Mapping[str, tuple[int, int]],
    min_count: int | None = None,
) -> DataFrame:
    """Mean of ``win`` rows ending ``lag`` rows back, by position.

    ``specs`` maps a name to ``(lag, win)``. ``min_count`` defaults to the full
    window: fewer non-null values give null.
    """
    w = series_window(key, order)
    out = {}
    for name, (lag, win) in specs.items():
        frame = w.rowsBetween(-(lag + win - 1), -lag)
        out[name] = trailing_mean(col, frame, win if min_count is None else min_count)
    return df.withColumns(out)


def add_lags_by_day(df: DataFrame, key: Sequence[str], day: str, col: str, lags: Mapping[str, int]) -> DataFrame:
    """Lags by calendar distance: the value exactly ``n`` days back, null when that day is absent."""
    w = series_window(key, day)
    return df.withColumns({name: F.max(col).over(w.rangeBetween(-n, -n)) for name, n in lags.items()})


def add_rolling_means_by_day(
    df: DataFrame,
    key: Sequence[str],
    day: str,
    col: str,
    specs: Mapping[str, tuple[int, int]],
    min_count: int | None = 1,
) -> DataFrame:
    """Mean over the days ``(day - lag - win, day - lag]``.

    Partial windows are allowed down to ``min_count`` values; ``None`` asks for the full window.
    """
    w = series_window(key, day)
    out = {}
    for name, (lag, win) in specs.items():
        frame = w.rangeBetween(-(lag + win - 1), -lag)
        out[name] = trailing_mean(col, frame, win if min_count is None else min_count)
    return df.withColumns(out)


def lag_by_date_join(df: DataFrame, key: Sequence[str], day: str, col: str, lag: int, name: str) -> DataFrame:
    """The value ``lag`` days back through an equi self-join on (key, day)."""
    earlier = df.select(*key, (F.col(day) + lag).alias(day), F.col(col).alias(name))
    return df.join(earlier, [*key, day], "left")


def add_date_features(df: DataFrame, date: str = "date") -> DataFrame:
    """Calendar features; an existing ``wday`` column is kept and only narrowed."""
    wday = F.col("wday") if "wday" in df.columns else None
    return df.withColumns(date_features(F.col(date), wday))


def update_values(df: DataFrame, new: DataFrame, key: Sequence[str], col: str) -> DataFrame:
    """Replace ``col`` on the rows that ``new`` names, leave the others alone."""
    fresh = new.select(*key, F.col(col).alias("_new"), F.lit(True).alias("_hit"))
    merged = F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(col))
    return df.join(fresh, list(key), "left").withColumn(col, merged).drop("_new", "_hit")


def cumulate_level(df: DataFrame, key: Sequence[str], order: str, last_level: str, delta: str, name: str) -> DataFrame:
    """Level path: the last known level plus the running sum of forecast differences."""
    run = series_window(key, order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn(name, F.col(last_level) + F.sum(delta).over(run))


def last_known(df: DataFrame, key: Sequence[str], order: str, col: str, name: str) -> DataFrame:
    """Last observed value of each series and the day it was seen on."""
    seen = df.where(F.col(col).isNotNull())
    return seen.groupBy(*key).agg(F.max_by(col, order).alias(name), F.max(order).alias(f"{name}_{order}"))


def season_levels(df: DataFrame, key: Sequence[str], wday: str, value: str) -> DataFrame:
    """Weekday effect of each series: mean on that weekday minus the overall mean.

    Sums and counts per weekday are combined into the overall mean, so the
    panel is aggregated once.
    """
    by_wday = df.groupBy(*key, wday).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    w = W.partitionBy(*key)
    overall = F.sum("_s").over(w) / F.sum("_n").over(w)
    return by_wday.select(*key, wday, (F.try_divide(F.col("_s"), F.col("_n")) - overall).alias("season"))


def decompose(df: DataFrame, key: Sequence[str], day: str, wday: str, value: str) -> DataFrame:
    """Add ``season``, ``level`` and the daily level change ``d_level``.

    The seasonal means are windows over the same series key as the lag, so the
    whole decomposition needs one exchange.
    """
    by_wday, whole = W.partitionBy(*key, wday), W.partitionBy(*key)
    season = F.avg(value).over(by_wday) - F.avg(value).over(whole)
    leveled = (
        df.repartition(*key)
        .withColumn("season", season)
        .withColumn("level", F.col(value) - F.col("season"))
    )
    return leveled.withColumn("d_level", F.col("level") - F.lag("level").over(series_window(key, day)))
