"""Item-level forecast: boosted Poisson model on item x store series, recursive horizon, submission."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.functions import scalars as S
from tidecast.operators import reshape
from tidecast.operators.boost import Boosted, boost_rows, feature_pipeline, fill_missing
from tidecast.operators.encode import TargetMeans, fit_target_means
from tidecast.operators.split import sample_flag
from tidecast.plans import known, submission
from tidecast.plans.recursive import FeatureSpec, forecast_recursive
from tidecast.session import materialize
from tidecast.sources.binding import SERIES_KEYS, BoundTables

LAGS = {"lag_7": 7, "lag_28": 28}
MEANS = {f"rmean_{lag}_{win}": (lag, win) for win in (7, 28) for lag in (7, 28)}
DERIVED = [*LAGS, *MEANS]
CATEGORIES = ("dept_id", "store_id", "cat_id", "state_id", *known.EVENTS)
DAY_PARTS = ("wday", "week", "month", "quarter", "year", "mday")
KEY = ["store_id", "item_id"]
SPEC = FeatureSpec(KEY, "day_num", "sales", LAGS, MEANS, min_count=1)


def build_long(
    sales: DataFrame, calendar: DataFrame, prices: DataFrame, first_day: int, last_day: int, horizon: int = 0
) -> DataFrame:
    """Wide sales matrix to the long priced fact: pruned day columns, optional empty future days.

    Days an item has no price on are dropped by the inner price join.
    """
    ids = [c for c in sales.columns if not c.startswith("d_")]
    days = [f"d_{n}" for n in range(first_day, last_day + 1)]
    wide = sales.select(*ids, *days)
    for n in range(last_day + 1, last_day + horizon + 1):
        wide = wide.withColumn(f"d_{n}", F.lit(None).cast("double"))
    long = reshape.melt_days(wide, ids)
    return long.join(calendar, "d").join(prices, ["store_id", "item_id", "wm_yr_wk"])


@dataclass
class FittedBottom:
    items: TargetMeans
    pipeline: PipelineModel
    model: Boosted

    def predict(self, df: DataFrame) -> DataFrame:
        named = self.items.encode(df, "item_mean")
        return self.model.transform(self.pipeline.transform(fill_missing(named, DERIVED)))


class BottomForecast:
    def __init__(self, t: BoundTables, first_day: int = 1):
        self.t = t
        self.first_day = first_day
        self.flags = [f"snap_{s}" for s in t.study.states]
        self.known = [*DAY_PARTS, *known.EVENTS, *self.flags]
        self.numeric = [*DAY_PARTS, *self.flags, "sell_price", "item_mean", *DERIVED, *[f"{c}_missing" for c in DERIVED]]

    def priced(self, rows: DataFrame) -> DataFrame:
        """Rows with the week's price; unpriced days disappear."""
        weekly = rows.join(F.broadcast(self.t.calendar.select("day_num", "wm_yr_wk")), "day_num")
        return weekly.join(self.t.prices, ["store_id", "item_id", "wm_yr_wk"]).drop("wm_yr_wk")

    def with_known(self, rows: DataFrame) -> DataFrame:
        return known.add_known(rows, self.t, *self.known)

    @cached_property
    def long(self) -> DataFrame:
        """Priced history, written once: training and the recursion both read it."""
        return materialize(self.t.priced_sales(self.first_day, carry=True), "bottom-long")

    @cached_property
    def future(self) -> DataFrame:
        s = self.t.study
        days = reshape.day_range(s.forecast_first, s.forecast_last).alias("day_num")
        series = self.t.series.select("id", *SERIES_KEYS)
        return self.with_known(self.priced(series.select("id", *SERIES_KEYS, days)))

    def fit(
        self,
        *,
        rounds: int = 1_200,
        holdout: int = 2_000_000,
        rate: float = 0.075,
        max_depth: int = 11,
        min_rows: int = 4095,
        l2: float = 0.1,
        patience: int | None = None,
    ) -> FittedBottom:
        """Train on all rows but a random holdout that is monitored, and stops the rounds where ``patience`` is given.

        The item enters as its mean sales, taken from the other folds of the training rows.
        """
        key = ["id", "day_num"]
        held = sample_flag(self.long, key, holdout)
        items = fit_target_means(held.where("NOT held"), "item_id", "sales", key)
        rows = items.encode(self.with_known(SPEC.add(held)), "item_mean", trained=~F.col("held"))
        rows = fill_missing(rows, DERIVED)
        pipeline = feature_pipeline(self.with_known(self.long), self.numeric, CATEGORIES)
        model = boost_rows(
            pipeline.transform(rows),
            "sales",
            key,
            rounds=rounds,
            rate=rate,
            max_depth=max_depth,
            min_rows=min_rows,
            subsample=0.75,
            l2=l2,
            patience=patience,
        )
        return FittedBottom(items, pipeline, model)

    def forecast(self, fitted: FittedBottom) -> DataFrame:
        """Columns: id, day_num, yhat."""
        s = self.t.study
        history = self.long.select(*KEY, "day_num", "sales")
        ids = self.t.series.select("id", *KEY)
        out = forecast_recursive(history, self.future, SPEC, fitted.predict, s.forecast_first, s.forecast_last)
        return out.join(ids, KEY).select("id", "day_num", "yhat")

    def submission(self, forecast: DataFrame) -> DataFrame:
        phase = F.replace("id", F.lit("validation"), F.lit("evaluation")).alias("id")
        rows = forecast.select(phase, "day_num", F.col("yhat").alias("sales"))
        return submission.bottom_submission(rows, "day_num", "sales", self.t.study.forecast_first, self.t.study.horizon)
