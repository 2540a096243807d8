"""Hybrid forecast: a vector autoregression per store, boosted on its residuals."""

from __future__ import annotations

from functools import cached_property

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.operators import features, metrics, reshape, varx
from tidecast.operators.boost import Boosted, alike, category_indexer, flagged
from tidecast.operators.residual import fit_residual_cells
from tidecast.operators.split import blocked_split, origin_split
from tidecast.plans import known
from tidecast.session import materialize
from tidecast.sources.binding import DEPT_KEYS, BoundTables

KEYS = list(DEPT_KEYS)
CATEGORIES = (
    "store_id",
    "dept_id",
    "wday",
    "month",
    *known.EVENTS,
    *known.LEAD_EVENTS,
    "snap",
)
KNOWN = ["wday", "month", *known.EVENTS, "snap", *known.LEAD_EVENTS]
INPUTS = [f"{c}_ix" for c in CATEGORIES]


def assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=[*INPUTS, "step"], outputCol="features").transform(rows).drop(*INPUTS)


class HybridForecast:
    def __init__(self, t: BoundTables, exog: str = "future"):
        self.t = t
        self.exog = exog

    @cached_property
    def panel(self) -> DataFrame:
        s = self.t.study
        wdays = self.t.calendar.select("day_num", "wday")
        return materialize(self.t.panel(1, s.forecast_last).join(F.broadcast(wdays), "day_num"), "panel")

    @cached_property
    def train_panel(self) -> DataFrame:
        return self.panel.where(F.col("day_num") <= self.t.study.train_last)

    @cached_property
    def seasons(self) -> DataFrame:
        return features.season_levels(self.train_panel, KEYS, "wday", "demand")

    @cached_property
    def vectors(self) -> DataFrame:
        """Store x day vectors with exogenous values; forecast days carry no level."""
        s = self.t.study
        levels = features.decompose(self.train_panel, KEYS, "day_num", "wday", "demand")
        levels = levels.where(F.col("d_level").isNotNull()).select(*KEYS, "day_num", "d_level", "level")
        ahead = reshape.day_range(s.forecast_first, s.forecast_last).alias("day_num")
        future = self.train_panel.where(F.col("day_num") == s.train_last).select(*KEYS, ahead)
        both = reshape.union_all(levels, future)
        return materialize(known.add_exog_array(varx.store_vectors(both), self.t), "vectors")

    @cached_property
    def coefficients(self) -> DataFrame:
        return materialize(varx.fit_varx(self.vectors, self.t.study.var_lags), "coefficients")

    @property
    def first_origin(self) -> int:
        """The first day whose ``var_lags`` predecessors all have a level change."""
        return self.t.study.var_lags + 2

    def forecast(self, first_origin: int, last_origin: int, exog: str | None = None) -> DataFrame:
        """VAR forecasts with the weekday effect added back."""
        s = self.t.study
        raw = varx.forecast_varx(
            self.vectors,
            self.coefficients,
            lags=s.var_lags,
            horizon=s.horizon,
            first_origin=first_origin,
            last_origin=last_origin,
            exog=exog or self.exog,
        )
        wdays = self.t.calendar.select("day_num", "wday")
        joined = raw.join(F.broadcast(wdays), "day_num").join(self.seasons, [*KEYS, "wday"], "left")
        return joined.withColumn("demand_fcast", F.col("level_fcast") + F.col("season"))

    @cached_property
    def rolling(self) -> DataFrame:
        """Every origin whose horizon lies inside the training days."""
        s = self.t.study
        return materialize(self.forecast(self.first_origin, s.train_last - s.horizon + 1), "rolling")

    @cached_property
    def ahead(self) -> DataFrame:
        s = self.t.study
        return materialize(self.forecast(s.forecast_first, s.forecast_first, "future"), "ahead")

    @cached_property
    def day_features(self) -> DataFrame:
        """Demand and indexed categories per series and day.

        They are the same for every origin that forecasts the day, so they are
        indexed on the panel and joined to the forecasts afterwards. The labels
        are learned on the days outside the validation windows.
        """
        s = self.t.study
        rows = known.add_known(self.panel.select(*KEYS, "day_num", "demand"), self.t, *KNOWN)
        text = [c for c in CATEGORIES if c not in KEYS]
        rows = rows.withColumns({c: F.col(c).cast("string") for c in text})
        learned, _ = blocked_split(rows.where(F.col("day_num") <= s.train_last), "day_num", s.windows)
        indexed = category_indexer(learned, CATEGORIES).transform(rows)
        return materialize(indexed.select(*KEYS, "day_num", "demand", *INPUTS), "day-features")

    def residuals(self, forecasts: DataFrame) -> DataFrame:
        """Forecast rows with the demand that followed, the residual and the parts of the residual model's feature vector."""
        rows = forecasts.select(*KEYS, "origin", "step", "day_num", "demand_fcast").join(
            self.day_features, [*KEYS, "day_num"]
        )
        return rows.withColumn("resid", F.col("demand") - F.col("demand_fcast"))

    def residual_rows(self, forecasts: DataFrame) -> DataFrame:
        """The residuals with the residual model's feature vector."""
        return assembled(self.residuals(forecasts))

    @cached_property
    def training(self) -> DataFrame:
        """Residuals of all origins for the learner, ``held`` inside the windows.

        A series has one forecast of every step on a day, and the days of a calendar look alike in few ways, so the rows
        are brought together (``alike``) before their vectors are put together.
        """
        s = self.t.study
        train, valid, _ = origin_split(self.residuals(self.rolling), "origin", "day_num", s.windows[0][0], s.windows)
        rows = flagged(train, valid, [*KEYS, *INPUTS, "step", F.col("resid").cast("double").alias("y")])
        return assembled(alike(rows))

    def fit(
        self, *, rounds: int = 1_000, rate: float = 0.02, max_depth: int = 5, patience: int | None = 10, l2: float = 0.0
    ) -> Boosted:
        """Trees common to all series, leaf values per store and department, stopped by patience on the windows."""
        return fit_residual_cells(
            self.training, KEYS, rounds=rounds, rate=rate, max_depth=max_depth, patience=patience, l2=l2
        )

    def combine(self, rows: DataFrame, model: Boosted) -> DataFrame:
        """Final forecast = base forecast + predicted residual."""
        scored = model.transform(rows, "resid_fcast")
        final = F.col("demand_fcast") + F.col("resid_fcast")
        return scored.select(
            *KEYS, "origin", "step", "day_num", "demand", "demand_fcast", "resid_fcast", final.alias("demand_fcast_final")
        )

    def scored(self, model: Boosted) -> DataFrame:
        """Base and final forecasts at the origins that open a validation window."""
        s = self.t.study
        opening = self.rolling.where(F.col("origin").isin([first for first, _ in s.windows]))
        _, _, held = origin_split(self.residual_rows(opening), "origin", "day_num", s.windows[0][0], s.windows)
        return self.combine(held, model)

    def rmse(self, model: Boosted) -> DataFrame:
        models = {"var_rmse": "demand_fcast", "hybrid_rmse": "demand_fcast_final"}
        return metrics.rmse_models(self.scored(model), ["origin"], "demand", models)
