"""Recursive multi-step forecasting in blocks.

No feature looks back less than the smallest lag, so that many days can be
predicted at once: a 28-day horizon with a smallest lag of 7 takes 4 blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.operators.features import add_lags_by_day, add_rolling_means_by_day
from tidecast.session import materialize


@dataclass(frozen=True)
class FeatureSpec:
    """Features derived from the forecast value itself."""

    key: Sequence[str]
    day: str
    value: str
    lags: Mapping[str, int]
    means: Mapping[str, tuple[int, int]] = field(default_factory=dict)
    min_count: int | None = 1

    @property
    def block(self) -> int:
        return min([*self.lags.values(), *[lag for lag, _ in self.means.values()]])

    @property
    def reach(self) -> int:
        return max([*self.lags.values(), *[lag + win - 1 for lag, win in self.means.values()]])

    def add(self, df: DataFrame) -> DataFrame:
        df = add_lags_by_day(df, self.key, self.day, self.value, self.lags)
        return add_rolling_means_by_day(df, self.key, self.day, self.value, self.means, self.min_count)


def forecast_recursive(
    history: DataFrame,
    future: DataFrame,
    spec: FeatureSpec,
    predict: Callable[[DataFrame], DataFrame],
    first: int,
    last: int,
    block: int | None = None,
) -> DataFrame:
    """Forecast the days ``first..last`` of every series.

    ``history`` holds key, day and value up to ``first - 1``; ``future`` holds
    key, day and the features known in advance; ``predict`` adds ``yhat``.
    Returns key, day and ``yhat``. Each block's predictions are written
    before the next block reads them, so the plan does not grow with the horizon.
    """
    keyed = [*spec.key, spec.day]
    size = spec.block if block is None else block
    if not 1 <= size <= spec.block:
        raise ValueError(f"a block holds between 1 and {spec.block} days")
    day = F.col(spec.day)
    recent = history.where(day.between(first - spec.reach, first - 1))
    known = materialize(recent.select(*keyed, F.col(spec.value).cast("double").alias(spec.value)), "known")
    future = materialize(future.where(day.between(first, last)), "future")
    done: DataFrame | None = None
    for start in range(first, last + 1, size):
        stop = min(start + size - 1, last)
        ahead = future.where(day.between(start, stop)).withColumn(spec.value, F.lit(None).cast("double"))
        frame = known.where(day >= start - spec.reach).unionByName(ahead, allowMissingColumns=True)
        features = spec.add(frame).where(day >= start)
        rows = materialize(predict(features).select(*keyed, F.col("yhat").cast("double").alias("yhat")), "block")
        done = rows if done is None else done.unionByName(rows)
        known = known.unionByName(rows.withColumnRenamed("yhat", spec.value))
    return done
