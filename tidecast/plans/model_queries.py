"""Registered queries that fit models or forecast recursively."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.operators import boost, encode, features, reshape, varx
from tidecast.operators.residual import fit_residual_boost
from tidecast.plans import recursive, submission
from tidecast.plans.aggregate import DERIVED, KEYS, AggregateForecast, Fitted
from tidecast.plans.bottom import BottomForecast
from tidecast.plans.hybrid import HybridForecast
from tidecast.plans import known
from tidecast.plans.registry import IN_WINDOWS, query
from tidecast.session import materialize, shared_path
from tidecast.sources.binding import BoundTables
from tidecast.sources.bundle import BundleTables, write_bundle

# The registered queries boost in long steps until the validation error has not improved for PATIENCE rounds.
RATE, PATIENCE = 0.5, 3


def r6(c: str):
    return F.round(F.col(c), 6).alias(c)


# ---- closed-form recursion ---------------------------------------------------


def _recursion_sql() -> str:
    parts, prior = [], "SELECT store_id, dept_id, day_num, demand FROM panel"
    for b in range(4):
        first = 2469 + 7 * b
        parts.append(
            f"b{b} AS (SELECT a.store_id, a.dept_id, CAST(a.day_num + 7 AS INTEGER) AS day_num, "
            f"(a.demand + z.demand) / 2 AS demand FROM h{b} a JOIN h{b} z ON z.store_id = a.store_id "
            f"AND z.dept_id = a.dept_id AND z.day_num = a.day_num - 21 "
            f"WHERE a.day_num + 7 BETWEEN {first} AND {first + 6}), "
            f"h{b + 1} AS (SELECT * FROM h{b} UNION ALL SELECT * FROM b{b})"
        )
    return (
        f"WITH h0 AS ({prior}), "
        + ", ".join(parts)
        + " SELECT store_id, dept_id, day_num, round(demand, 6) AS yhat FROM h4 WHERE day_num > 2468"
    )


@query("forecast_recursive", _recursion_sql(), ["panel"])
def forecast_recursive(t: BoundTables) -> DataFrame:
    """28 days of (lag 7 + lag 28) / 2, predictions feeding the later lags."""
    s = t.study
    spec = recursive.FeatureSpec(KEYS, "day_num", "demand", {"lag_7": 7, "lag_28": 28})
    panel = t.panel(s.train_last - spec.reach + 1).select(*KEYS, "day_num", "demand")
    series = panel.where(F.col("day_num") == s.train_last).select(*KEYS)
    days = F.explode(F.sequence(F.lit(s.forecast_first), F.lit(s.forecast_last))).alias("day_num")
    out = recursive.forecast_recursive(
        panel,
        series.select(*KEYS, days),
        spec,
        lambda df: df.withColumn("yhat", (F.col("lag_7") + F.col("lag_28")) / 2),
        s.forecast_first,
        s.forecast_last,
    )
    return out.select(*KEYS, "day_num", r6("yhat"))


# ---- boosted Poisson ---------------------------------------------------------


@query("ml_poisson_boost")
def ml_poisson_boost(t: BoundTables) -> DataFrame:
    """Validation rows scored by a boosted Poisson model."""
    agg = AggregateForecast(t)
    fitted = agg.fit(rate=RATE, patience=PATIENCE)
    _, _, valid = agg.split
    return fitted.model.transform(valid).select(*KEYS, "day_num", "demand", "yhat")


# On one binary feature a tree of depth 1 holds a step for each of its two values, so the rounds are a recursion in SQL.
CLOSED_ROUNDS, CLOSED_RATE, CLOSED_L2, CLOSED_SHRINK = 8, 0.5, 0.1, 50.0
_WEEKEND = "CASE WHEN wday <= 2 THEN 1 ELSE 0 END"
#: Demand minus the demand 28 days before.
_NAIVE_ROWS = f"""rows_of AS (SELECT store_id, dept_id, demand - before AS resid, {_WEEKEND} AS weekend FROM (
  SELECT *, lag(demand, 28) OVER (PARTITION BY store_id, dept_id ORDER BY day_num) AS before FROM panel_cal)
  WHERE before IS NOT NULL)"""


def _chain(first: str, step: str, rounds: int = CLOSED_ROUNDS) -> str:
    return ", ".join([f"e0 AS ({first})", *[f"e{i + 1} AS ({step.format(e=f'e{i}')})" for i in range(rounds)]])


def _poisson_sql() -> str:
    rows = f"rows_of AS (SELECT demand, {_WEEKEND} AS weekend FROM panel_cal)"
    first = """SELECT weekend, count(*) AS n, avg(demand) AS m, ln((SELECT avg(demand) FROM panel)) AS eta
  FROM rows_of GROUP BY weekend"""
    step = f"SELECT weekend, n, m, eta + {CLOSED_RATE} * n * (m - exp(eta)) / (n * exp(eta) * exp(0.7) + {CLOSED_L2}) AS eta FROM {{e}}"
    last = f"SELECT CAST(weekend AS INTEGER) AS weekend, round(exp(eta), 6) AS yhat FROM e{CLOSED_ROUNDS}"
    return f"WITH {rows}, {_chain(first, step)} {last}"


def weekend_rows(t: BoundTables) -> DataFrame:
    rows = t.panel_calendar().select(*KEYS, "day_num", "demand", (F.col("wday") <= 2).cast("int").alias("weekend"))
    return VectorAssembler(inputCols=["weekend"], outputCol="features").transform(rows).withColumn("held", F.lit(False))


def closed_form_model(t: BoundTables, rows: DataFrame) -> boost.Boosted:
    options = {"rounds": CLOSED_ROUNDS, "rate": CLOSED_RATE, "max_depth": 1, "l2": CLOSED_L2}
    return boost.boost_rows(rows, "demand", [*KEYS, "day_num"], **options)


@query("ml_boost_closed_form", _poisson_sql(), ["panel_cal", "panel"])
def ml_boost_closed_form(t: BoundTables) -> DataFrame:
    """A boosted Poisson model with a penalty on leaves, on one binary feature."""
    rows = weekend_rows(t)
    scored = closed_form_model(t, rows).transform(rows).groupBy("weekend").agg(F.avg("yhat").alias("yhat"))
    return scored.select("weekend", r6("yhat"))


@query("ml_split_counts", f"SELECT 'weekend' AS feature, CAST({CLOSED_ROUNDS} AS BIGINT) AS splits")
def ml_split_counts(t: BoundTables) -> DataFrame:
    """Importance as the number of splits on a feature, read from the saved trees: one in each tree of depth 1."""
    rows = weekend_rows(t)
    return closed_form_model(t, rows).split_counts(t.spark, boost.vector_names(rows))


def naive_residual_rows(t: BoundTables) -> DataFrame:
    lagged = features.add_lags(weekend_rows(t), KEYS, "day_num", "demand", {"before": 28})
    return lagged.where(F.col("before").isNotNull()).withColumn("resid", F.col("demand") - F.col("before"))


def _residual_sql() -> str:
    first = """SELECT weekend, count(*) AS n, avg(resid) AS m, (SELECT avg(resid) FROM rows_of) AS eta
  FROM rows_of GROUP BY weekend"""
    step = f"SELECT weekend, n, m, eta + {CLOSED_RATE} * n * (m - eta) / (n + {CLOSED_L2}) AS eta FROM {{e}}"
    last = f"SELECT CAST(weekend AS INTEGER) AS weekend, round(eta, 6) AS yhat FROM e{CLOSED_ROUNDS}"
    return f"WITH {_NAIVE_ROWS}, {_chain(first, step)} {last}"


@query("ml_residual_closed_form", _residual_sql(), ["panel_cal"])
def ml_residual_closed_form(t: BoundTables) -> DataFrame:
    """A boosted squared-loss model on residuals, one for all series."""
    rows = naive_residual_rows(t)
    options = {"rounds": CLOSED_ROUNDS, "rate": CLOSED_RATE, "max_depth": 1, "l2": CLOSED_L2}
    model = fit_residual_boost(rows, None, "resid", [*KEYS, "day_num"], **options)
    scored = model.transform(rows).groupBy("weekend").agg(F.avg("yhat").alias("yhat"))
    return scored.select("weekend", r6("yhat"))


def _per_series_sql() -> str:
    first = """SELECT store_id, dept_id, weekend, count(*) AS n, avg(resid) AS m, (SELECT avg(resid) FROM rows_of) AS eta
  FROM rows_of GROUP BY ALL"""
    pooled = f"(sum(n * (m - eta)) OVER (PARTITION BY weekend)) / ((sum(n) OVER (PARTITION BY weekend)) + {CLOSED_L2})"
    step = f"""SELECT store_id, dept_id, weekend, n, m,
  eta + {CLOSED_RATE} * (n * (m - eta) + {CLOSED_SHRINK} * v) / (n + {CLOSED_SHRINK}) AS eta
  FROM (SELECT *, {pooled} AS v FROM {{e}})"""
    last = f"SELECT store_id, dept_id, CAST(weekend AS INTEGER) AS weekend, round(eta, 6) AS yhat FROM e{CLOSED_ROUNDS}"
    return f"WITH {_NAIVE_ROWS}, {_chain(first, step)} {last}"


@query("ml_residual_per_series", _per_series_sql(), ["panel_cal"])
def ml_residual_per_series(t: BoundTables) -> DataFrame:
    """Trees grown on the residuals of all series, with leaf values of each store and department shrunk to the pooled ones."""
    rows = materialize(naive_residual_rows(t), "naive-residuals")
    options = {"rounds": CLOSED_ROUNDS, "rate": CLOSED_RATE, "max_depth": 1, "l2": CLOSED_L2, "shrink": CLOSED_SHRINK}
    model = fit_residual_boost(rows, None, "resid", [*KEYS, "day_num"], KEYS, **options)
    cells = rows.dropDuplicates([*KEYS, "weekend"])
    return model.transform(cells).select(*KEYS, "weekend", r6("yhat"))


@query(
    "ml_glm_totals",
    f"""SELECT store_id, round(sum(demand), 3) AS demand, TRUE AS equal FROM panel WHERE NOT {IN_WINDOWS('day_num')}
GROUP BY store_id""",
    ["panel"],
)
def ml_glm_totals(t: BoundTables) -> DataFrame:
    """Without a penalty, predictions of a log-linear model sum to the demand of every store it has a term for."""
    _, train, _ = AggregateForecast(t).vectors(one_hot=True)
    scored = boost.fit_poisson_glm(train, "demand", reg=0.0).transform(train)
    sums = scored.groupBy("store_id").agg(F.sum("demand").alias("demand"), F.sum("yhat").alias("yhat"))
    near = F.abs(F.col("yhat") - F.col("demand")) <= F.col("demand") * 1e-4
    return sums.select("store_id", F.round("demand", 3).alias("demand"), near.alias("equal"))


@query("ml_poisson_glm")
def ml_poisson_glm(t: BoundTables) -> DataFrame:
    """Validation rows scored by a log-linear Poisson model on one-hot categories."""
    _, train, valid = AggregateForecast(t).vectors(one_hot=True)
    model = boost.fit_poisson_glm(train, "demand")
    return model.transform(valid).select(*KEYS, "day_num", "demand", "yhat")


@query("ml_feature_importance")
def ml_feature_importance(t: BoundTables) -> DataFrame:
    """Gain share per feature, ascending."""
    agg = AggregateForecast(t)
    fitted = agg.fit(rate=RATE, patience=PATIENCE)
    _, train, _ = agg.split
    ranked = fitted.model.importance(boost.vector_names(train))
    return t.spark.createDataFrame([(v, n) for n, v in ranked], "value double, feature string").orderBy(
        "value", "feature"
    )


def saved_and_loaded(t: BoundTables, fitted: Fitted) -> Fitted:
    path = shared_path(t.spark, "model")
    fitted.model.save(t.spark, f"{path}/boost")
    fitted.pipeline.write().overwrite().save(f"{path}/features")
    return Fitted(PipelineModel.load(f"{path}/features"), boost.Boosted.load(t.spark, f"{path}/boost"))


@query("ml_save_load_score")
def ml_save_load_score(t: BoundTables) -> DataFrame:
    agg = AggregateForecast(t)
    fitted = agg.fit(rate=RATE, patience=PATIENCE)
    again = saved_and_loaded(t, fitted)
    return again.predict(agg.features).select(*KEYS, "day_num", "demand", "yhat")


@query(
    "ml_save_load_equal",
    "SELECT store_id, dept_id, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_different FROM panel GROUP BY store_id, dept_id",
    ["panel"],
)
def ml_save_load_equal(t: BoundTables) -> DataFrame:
    """Rows that a saved and loaded model scores otherwise than the fitted one: none."""
    agg = AggregateForecast(t)
    fitted = agg.fit(rate=RATE, patience=PATIENCE)
    again = saved_and_loaded(t, fitted)
    both = fitted.predict(agg.features).select(*KEYS, "day_num", "yhat")
    both = both.join(again.predict(agg.features).select(*KEYS, "day_num", F.col("yhat").alias("other")), [*KEYS, "day_num"])
    different = F.coalesce((F.col("yhat") != F.col("other")).cast("long"), F.lit(1))
    return both.groupBy(*KEYS).agg(F.count("*").alias("n_rows"), F.sum(different).alias("n_different"))


@query("forecast_aggregate_boosted", compact="item")
def forecast_aggregate_boosted(t: BoundTables) -> DataFrame:
    """Top-down submission of the recursive boosted department forecast."""
    s = t.study
    agg = AggregateForecast(t)
    fitted = agg.fit(rate=RATE, patience=PATIENCE)
    ahead = agg.recursive(fitted, [s.forecast_first])
    return submission.aggregate_submission(
        submission.submission_ids(t), submission.item_weights(t), ahead, "demand_fcast", s
    ).orderBy("id")


@query(
    "forecast_csv_shares",
    """SELECT store_id, dept_id, count(*) AS n_items, TRUE AS equal FROM weights WHERE weight IS NOT NULL
GROUP BY store_id, dept_id""",
    ["weights"],
    compact="item",
)
def forecast_csv_shares(t: BoundTables) -> DataFrame:
    """The boosted department forecast from CSV files: in its submission every item has its share of the department.

    The tables are written in the published file layout and read again, so that everything behind comes from the files.
    """
    folder = shared_path(t.spark, "bundle")
    write_bundle(t, folder, 1)
    files = BundleTables(t.spark, folder, t.study, first_day=1)
    agg = AggregateForecast(files)
    ahead = materialize(agg.recursive(agg.fit(rate=RATE, patience=PATIENCE), [t.study.forecast_first]), "ahead")
    shares = submission.item_weights(files).where("weight IS NOT NULL").select("id", *KEYS, "weight")
    out = submission.aggregate_submission(submission.submission_ids(files), submission.item_weights(files), ahead, "demand_fcast", t.study)
    steps = F.posexplode(F.array(*[F.col(f"F{i}") for i in range(1, t.study.horizon + 1)])).alias("at", "value")
    items = out.select("id", steps).join(shares, "id").select("id", *KEYS, (F.col("at") + 1).alias("step"), "value", "weight")
    joined = items.join(ahead.select(*KEYS, "step", "demand_fcast"), [*KEYS, "step"])
    near = F.abs(F.col("value") - F.col("weight") * F.col("demand_fcast")) <= 1e-6
    return joined.groupBy(*KEYS).agg(
        F.count_distinct("id").alias("n_items"), F.coalesce(F.bool_and(near), F.lit(False)).alias("equal")
    )


@query("wrmse_aggregate_boosted", compact="item")
def wrmse_aggregate_boosted(t: BoundTables) -> DataFrame:
    """Weighted RMSE of the recursive boosted forecast on every validation window."""
    agg = AggregateForecast(t)
    fitted = agg.fit(rate=RATE, patience=PATIENCE)
    forecasts = agg.recursive(fitted, [first for first, _ in t.study.windows])
    return agg.wrmse(forecasts, submission.dept_weights(t)).orderBy("valid_window")


@query("forecast_bottom_boosted", compact="item")
def forecast_bottom_boosted(t: BoundTables) -> DataFrame:
    """Item submission of the recursive boosted item forecast."""
    bottom = BottomForecast(t)
    fitted = bottom.fit(holdout=50_000, rate=RATE, max_depth=6, patience=PATIENCE)
    return bottom.submission(bottom.forecast(fitted))


_ITEM_ROWS = """rows_of AS (SELECT item_id, sales,
  CAST('0x' || substr(md5(id || '|' || day_num || '|64'), 1, 8) AS BIGINT) % 5 AS fold FROM sales)"""


@query(
    "ml_item_encoding",
    f"""WITH {_ITEM_ROWS},
f AS (SELECT fold, count(*) AS n, sum(sales) AS s FROM rows_of GROUP BY fold),
m AS (SELECT fold, ((SELECT sum(s) FROM f) - s) / ((SELECT sum(n) FROM f) - n) AS m FROM f),
c AS (SELECT item_id, fold, count(*) AS n, sum(sales) AS s FROM rows_of GROUP BY ALL),
i AS (SELECT *, sum(n) OVER (PARTITION BY item_id) - n AS n_out, sum(s) OVER (PARTITION BY item_id) - s AS s_out FROM c)
SELECT item_id, CAST(fold AS INTEGER) AS fold, n AS n_rows, round((s_out + 20 * m) / (n_out + 20), 6) AS low,
  round((s_out + 20 * m) / (n_out + 20), 6) AS high FROM i JOIN m USING (fold)""",
    ["sales"],
    compact="item",
)
def ml_item_encoding(t: BoundTables) -> DataFrame:
    """The item as a number: its smoothed mean sales in the other folds, the same for all rows of an item and fold."""
    key = ["id", "day_num"]
    rows = t.sales().select("id", "item_id", "day_num", "sales")
    coded = encode.fit_target_means(rows, "item_id", "sales", key).encode(rows, "mean", trained=True)
    by_fold = coded.groupBy("item_id", encode.fold_of(key, 5).alias("fold"))
    return by_fold.agg(
        F.count("*").alias("n_rows"), F.round(F.min("mean"), 6).alias("low"), F.round(F.max("mean"), 6).alias("high")
    )


# ---- vector autoregression and residual boosting -------------------------------


@query(
    "ar1_fit",
    """SELECT store_id, dept_id, round(regr_slope(d_level, prev), 6) AS slope,
  round(regr_intercept(d_level, prev), 6) AS intercept
FROM (SELECT *, lag(d_level) OVER (PARTITION BY store_id, dept_id ORDER BY day_num) AS prev FROM levels)
GROUP BY ALL""",
    ["levels"],
)
def ar1_fit(t: BoundTables) -> DataFrame:
    levels = features.decompose(t.panel_calendar(), KEYS, "day_num", "wday", "demand")
    lagged = features.add_lags(levels, KEYS, "day_num", "d_level", {"prev": 1})
    fit = lagged.groupBy(*KEYS).agg(
        F.regr_slope("d_level", "prev").alias("slope"), F.regr_intercept("d_level", "prev").alias("intercept")
    )
    return fit.select(*KEYS, r6("slope"), r6("intercept"))


@query("var_fit_coeffs")
def var_fit_coeffs(t: BoundTables) -> DataFrame:
    hybrid = HybridForecast(t)
    return varx.name_terms(hybrid.coefficients, hybrid.vectors, known.exog_names())


@query(
    "var_cross_products",
    """WITH pairs AS (SELECT store_id, dept_id, day_num, d_level, unnest(range(1, 29)) AS lag FROM levels WHERE day_num >= 30)
SELECT a.store_id, a.dept_id, b.dept_id AS lag_dept_id, CAST(a.lag AS INTEGER) AS lag,
  round(sum(a.d_level * b.d_level), 4) AS v
FROM (SELECT *, day_num - lag AS past FROM pairs) a
JOIN levels b ON b.store_id = a.store_id AND b.day_num = a.past GROUP BY ALL""",
    ["levels"],
)
def var_cross_products(t: BoundTables) -> DataFrame:
    """The lagged cross products every coefficient is solved from."""
    hybrid = HybridForecast(t)
    vectors = hybrid.vectors
    n = 1 + len(known.exog_names())
    depts = vectors.groupBy("store_id").agg(F.first("depts").alias("depts"))
    sums = varx.cross_products(vectors, t.study.var_lags).where((F.col("i") >= n) & (F.col("j") >= F.col("n_terms")))
    offset, m = F.col("i") - n, F.size("depts")
    return sums.join(depts, "store_id").select(
        "store_id",
        F.get("depts", F.col("j") - F.col("n_terms")).alias("dept_id"),
        F.get("depts", F.pmod(offset, m)).alias("lag_dept_id"),
        (F.floor(offset / m) + 1).cast("int").alias("lag"),
        F.round("v", 4).alias("v"),
    )


# With one series and one lag the system is a line, so its fit, its forecasts and all origins have a closed form.
_LINE = """line AS (SELECT store_id, dept_id, regr_slope(d_level, prev) AS b, regr_intercept(d_level, prev) AS c
  FROM (SELECT *, lag(d_level) OVER (PARTITION BY store_id, dept_id ORDER BY day_num) AS prev FROM levels) GROUP BY ALL),
steps AS (SELECT *, c * (1 - b ** step) / (1 - b) AS d_c, b ** step AS d_b FROM line, (SELECT unnest(range(1, 29)) AS step)),
paths AS (SELECT *, sum(d_c) OVER w AS l_c, sum(d_b) OVER w AS l_b FROM steps
  WINDOW w AS (PARTITION BY store_id, dept_id ORDER BY step))"""


def single_systems(t: BoundTables, hybrid: HybridForecast) -> DataFrame:
    """Every series as a system of its own, without exogenous terms; forecast days carry no level."""
    s = t.study
    levels = features.decompose(hybrid.train_panel, KEYS, "day_num", "wday", "demand").where(F.col("d_level").isNotNull())
    ahead = reshape.day_range(s.forecast_first, s.forecast_last).alias("day_num")
    future = hybrid.train_panel.where(F.col("day_num") == s.train_last).select(*KEYS, ahead)
    rows = reshape.union_all(levels.select(*KEYS, "day_num", "d_level", "level"), future)
    rows = rows.withColumn("store_id", F.concat_ws("/", "store_id", "dept_id"))
    none = F.array().cast("array<double>")
    return materialize(varx.store_vectors(rows).withColumn("exog", none), "single-systems")


def store_of(column: str = "store_id"):
    return F.split_part(F.col(column), F.lit("/"), F.lit(1)).alias("store_id")


@query(
    "var_one_lag_fit",
    f"WITH {_LINE} SELECT store_id, dept_id, round(b, 6) AS slope, round(c, 6) AS intercept FROM line",
    ["levels"],
)
def var_one_lag_fit(t: BoundTables) -> DataFrame:
    """Systems of one series and one lag, solved from their cross products: the slope and intercept of a line."""
    vectors = single_systems(t, HybridForecast(t))
    named = varx.name_terms(varx.fit_varx(vectors, 1), vectors, [])
    both = named.groupBy("store_id", "dept_id").agg(
        F.max(F.when(F.col("term") != "const", F.col("coef"))).alias("slope"),
        F.max(F.when(F.col("term") == "const", F.col("coef"))).alias("intercept"),
    )
    return both.select(store_of(), "dept_id", r6("slope"), r6("intercept"))


def one_lag_forecasts(t: BoundTables, hybrid: HybridForecast, first: int, last: int) -> DataFrame:
    vectors = single_systems(t, hybrid)
    coefs = materialize(varx.fit_varx(vectors, 1), "one-lag")
    rows = varx.forecast_varx(vectors, coefs, lags=1, horizon=t.study.horizon, first_origin=first, last_origin=last)
    return rows.withColumn("store_id", store_of())


@query(
    "var_one_lag_forecast",
    f"""WITH {_LINE} SELECT p.store_id, p.dept_id, CAST(step AS INTEGER) AS step, CAST(2468 + step AS INTEGER) AS day_num,
  round(l_c + l_b * d_level + level, 5) AS level_fcast
FROM paths p JOIN levels l ON l.store_id = p.store_id AND l.dept_id = p.dept_id WHERE l.day_num = 2468""",
    ["levels"],
)
def var_one_lag_forecast(t: BoundTables) -> DataFrame:
    first = t.study.forecast_first
    rows = one_lag_forecasts(t, HybridForecast(t), first, first)
    return rows.select(*KEYS, "step", "day_num", F.round("level_fcast", 5).alias("level_fcast"))


@query(
    "var_one_lag_rolling",
    f"""WITH {_LINE},
ahead AS MATERIALIZED (SELECT p.store_id, p.dept_id, step, CAST(l.day_num + step AS INTEGER) AS day_num,
  l_c + l_b * l.d_level + l.level AS level_fcast
  FROM paths p JOIN levels l ON l.store_id = p.store_id AND l.dept_id = p.dept_id
  WHERE l.d_level IS NOT NULL AND l.day_num + 28 <= 2468)
SELECT a.store_id, a.dept_id, CAST(step AS INTEGER) AS step, count(*) AS n_origins,
  round(sqrt(avg((x.demand - x.season - a.level_fcast) ** 2)), 5) AS rmse
FROM ahead a JOIN levels x ON x.store_id = a.store_id AND x.dept_id = a.dept_id AND x.day_num = a.day_num GROUP BY ALL""",
    ["levels"],
)
def var_one_lag_rolling(t: BoundTables) -> DataFrame:
    """Error of every step over all origins of the history, from systems of one series and one lag."""
    hybrid = HybridForecast(t)
    rows = one_lag_forecasts(t, hybrid, 3, t.study.train_last - t.study.horizon + 1)
    actual = hybrid.train_panel.select(*KEYS, "day_num", "wday", "demand")
    joined = rows.join(actual, [*KEYS, "day_num"]).join(hybrid.seasons, [*KEYS, "wday"])
    error = F.col("demand") - F.col("level_fcast") - F.col("season")
    return joined.groupBy(*KEYS, "step").agg(
        F.count("*").alias("n_origins"), F.round(F.sqrt(F.avg(error * error)), 5).alias("rmse")
    )


@query("var_forecast")
def var_forecast(t: BoundTables) -> DataFrame:
    return HybridForecast(t).ahead


@query("var_rolling_origin")
def var_rolling_origin(t: BoundTables) -> DataFrame:
    """Error of every forecast step over all origins."""
    hybrid = HybridForecast(t)
    rows = hybrid.forecast(hybrid.first_origin, t.study.train_last - t.study.horizon + 1)
    actual = hybrid.panel.select(*KEYS, "day_num", "demand")
    error = F.col("demand") - F.col("demand_fcast")
    return rows.join(actual, [*KEYS, "day_num"]).groupBy(*KEYS, "step").agg(
        F.count(F.lit(1)).alias("n_origins"), F.sqrt(F.avg(error * error)).alias("rmse")
    )


@query("ml_residual_gbt")
def ml_residual_gbt(t: BoundTables) -> DataFrame:
    """Base and hybrid forecasts at the origins that open a validation window."""
    hybrid = HybridForecast(t)
    return hybrid.scored(hybrid.fit(rate=RATE, patience=PATIENCE))


@query("rmse_hybrid")
def rmse_hybrid(t: BoundTables) -> DataFrame:
    hybrid = HybridForecast(t)
    return hybrid.rmse(hybrid.fit(rate=RATE, patience=PATIENCE)).orderBy("origin")


@query("forecast_hybrid", compact="item")
def forecast_hybrid(t: BoundTables) -> DataFrame:
    """Top-down submission of the hybrid department forecast."""
    hybrid = HybridForecast(t)
    model = hybrid.fit(rate=RATE, patience=PATIENCE)
    ahead = hybrid.combine(hybrid.residual_rows(hybrid.ahead), model)
    return submission.aggregate_submission(
        submission.submission_ids(t), submission.item_weights(t), ahead, "demand_fcast_final", t.study
    ).orderBy("id")
