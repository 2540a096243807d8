"""Department-level forecast: boosted Poisson model, recursive horizon, top-down submission."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.operators import metrics
from tidecast.operators.boost import Boosted, feature_pipeline, fill_missing, fit_poisson_boost
from tidecast.operators.split import blocked_split
from tidecast.plans import known
from tidecast.plans.recursive import FeatureSpec, forecast_recursive
from tidecast.session import materialize
from tidecast.sources.binding import DEPT_KEYS, BoundTables

KEYS = list(DEPT_KEYS)
LAGS = {"L7_demand": 7, "L14_demand": 14, "L28_demand": 28}
MEANS = {"mean_demand_28_7": (28, 7), "mean_demand_28_28": (28, 28)}
DAY_PARTS = ("wday", "week", "mday", "month")
CATEGORIES = ("store_id", "dept_id", *known.EVENTS, "snap", *known.LEAD_EVENTS)
DERIVED = [*LAGS, *MEANS]
NUMERIC = [*DAY_PARTS, *DERIVED, *[f"{c}_missing" for c in DERIVED]]
KNOWN = [*DAY_PARTS, *known.EVENTS, "snap", *known.LEAD_EVENTS]

ORIGIN_SPEC = FeatureSpec((*KEYS, "origin"), "step", "demand", LAGS, MEANS, min_count=None)
PANEL_SPEC = FeatureSpec(KEYS, "day_num", "demand", LAGS, MEANS, min_count=None)


@dataclass
class Fitted:
    pipeline: PipelineModel
    model: Boosted

    def predict(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self.pipeline.transform(fill_missing(df, DERIVED)))


class AggregateForecast:
    def __init__(self, t: BoundTables):
        self.t = t

    @cached_property
    def panel(self) -> DataFrame:
        """The daily panel, written once because training, history and scoring all read it."""
        return materialize(self.t.panel(1, self.t.study.forecast_last), "panel")

    @cached_property
    def history(self) -> DataFrame:
        return self.panel.where(F.col("day_num") <= self.t.study.train_last).select(*KEYS, "day_num", "demand")

    @cached_property
    def features(self) -> DataFrame:
        """Feature rows of the training days, written once for the indexer, the learner and the scoring."""
        return materialize(known.add_known(PANEL_SPEC.add(self.history), self.t, *KNOWN), "features")

    @cached_property
    def split(self) -> tuple[PipelineModel, DataFrame, DataFrame]:
        return self.vectors()

    def vectors(self, one_hot: bool = False) -> tuple[PipelineModel, DataFrame, DataFrame]:
        """Feature pipeline learned on the training days, and the training and validation vectors."""
        train, valid = blocked_split(fill_missing(self.features, DERIVED), "day_num", self.t.study.windows)
        pipeline = feature_pipeline(train, NUMERIC, CATEGORIES, one_hot=one_hot)
        return pipeline, pipeline.transform(train), pipeline.transform(valid.drop("valid_window"))

    def fit(self, *, rounds: int = 1_000, rate: float = 0.03, max_depth: int = 5, patience: int | None = 200) -> Fitted:
        pipeline, train, valid = self.split
        model = fit_poisson_boost(
            train,
            valid,
            "demand",
            [*KEYS, "day_num"],
            rounds=rounds,
            rate=rate,
            max_depth=max_depth,
            patience=patience,
        )
        return Fitted(pipeline, model)

    def recursive(self, fitted: Fitted, origins: Sequence[int]) -> DataFrame:
        """Forecast the horizon of several origins at once; each origin is its own series.

        Columns: store_id, dept_id, origin, step, day_num, demand_fcast.
        """
        s, spec = self.t.study, ORIGIN_SPEC
        day = F.col("day_num")
        starts = F.array(*[F.lit(o) for o in origins])
        served = F.filter(starts, lambda o: (day < o) & (day >= o - spec.reach))
        past = self.history.select(*KEYS, "day_num", "demand", F.explode(served).alias("origin"))
        history = past.select(*KEYS, "origin", (day - F.col("origin") + 1).alias("step"), "demand")
        series = self.history.where(day == s.train_last).select(*KEYS)
        rows = series.select(*KEYS, F.explode(starts).alias("origin")).select(
            *KEYS, "origin", F.explode(F.sequence(F.lit(1), F.lit(s.horizon))).alias("step")
        )
        rows = rows.withColumn("day_num", F.col("origin") + F.col("step") - 1)
        future = known.add_known(rows, self.t, *KNOWN).drop("day_num")
        out = forecast_recursive(history, future, spec, fitted.predict, 1, s.horizon)
        return out.select(
            *KEYS, "origin", "step", (F.col("origin") + F.col("step") - 1).alias("day_num"), F.col("yhat").alias("demand_fcast")
        )

    def scored(self, forecasts: DataFrame) -> DataFrame:
        """Window forecasts next to the demand that followed; window 1 is the newest."""
        starts = [first for first, _ in self.t.study.windows]
        number = F.array_position(F.array(*[F.lit(a) for a in starts]), F.col("origin")).cast("int")
        held = forecasts.where(F.col("origin").isin(starts)).withColumn("valid_window", number)
        return held.join(self.panel.select(*KEYS, "day_num", "demand"), [*KEYS, "day_num"])

    def wrmse(self, forecasts: DataFrame, weights: DataFrame) -> DataFrame:
        return metrics.wrmse_by(self.scored(forecasts), "valid_window", KEYS, weights, "demand", "demand_fcast")
