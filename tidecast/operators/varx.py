"""Vector autoregression with exogenous regressors, one system per store.

Estimation is least squares on sums of squares and products: each task adds up
its rows, Spark sums the partial matrices, and only the small normal equations
are solved per store. Forecasts run for blocks of origins in parallel; a block
holds its days plus a margin of ``lags`` days before and ``horizon`` days after.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

COEF_SCHEMA = "store_id string, eq int, term int, coef double"


def store_vectors(levels: DataFrame) -> DataFrame:
    """One row per (store, day) with the department series as arrays in department order."""
    cells = F.array_sort(F.collect_list(F.struct("dept_id", "d_level", "level")))
    return (
        levels.groupBy("store_id", "day_num")
        .agg(cells.alias("c"))
        .select(
            "store_id",
            "day_num",
            F.col("c.dept_id").alias("depts"),
            F.col("c.d_level").alias("y"),
            F.col("c.level").alias("level"),
        )
    )


def lag_design(vectors: DataFrame, lags: int) -> DataFrame:
    """Regressors of each day: constant, exogenous values, then all departments at lag 1, 2, ..."""
    w = W.partitionBy("store_id").orderBy("day_num")
    known = vectors.where(~F.exists("y", lambda v: v.isNull()))
    past = F.collect_list("y").over(w.rowsBetween(-lags, -1))
    return (
        known.withColumn("past", past)
        .where(F.size("past") == lags)
        .select(
            "store_id",
            F.concat(F.array(F.lit(1.0)), F.col("exog"), F.flatten(F.reverse("past"))).alias("x"),
            "y",
        )
    )


def _partial_products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sum of x'[x y] over consecutive rows of one store; rows arrive ordered by store."""
    store, total = None, None
    for batch in batches:
        for name, rows in batch.groupby("store_id", sort=False):
            x = np.vstack(rows["x"].to_numpy())
            part = x.T @ np.hstack([x, np.vstack(rows["y"].to_numpy())])
            if name == store:
                total = total + part
                continue
            if total is not None:
                yield _as_rows(store, total)
            store, total = name, part
    if total is not None:
        yield _as_rows(store, total)


def _as_rows(store: str, matrix: np.ndarray) -> pd.DataFrame:
    i, j = np.indices(matrix.shape)
    return pd.DataFrame(
        {"store_id": store, "n_terms": matrix.shape[0], "i": i.ravel(), "j": j.ravel(), "v": matrix.ravel()}
    )


def _solve(rows: pd.DataFrame, tolerance: float) -> pd.DataFrame:
    k = int(rows["n_terms"].iloc[0])
    full = np.zeros((k, int(rows["j"].max()) + 1))
    full[rows["i"].to_numpy(), rows["j"].to_numpy()] = rows["v"].to_numpy()
    gram, cross = full[:, :k], full[:, k:]
    scale = np.sqrt(np.diag(gram))
    scale[scale == 0] = 1.0
    values, vectors = np.linalg.eigh(gram / np.outer(scale, scale))
    keep = values > tolerance * values.max()
    inverse = (vectors[:, keep] / values[keep]) @ vectors[:, keep].T
    coef = (inverse @ (cross / scale[:, None])) / scale[:, None]
    term, eq = np.indices(coef.shape)
    return pd.DataFrame(
        {"store_id": rows["store_id"].iloc[0], "eq": eq.ravel(), "term": term.ravel(), "coef": coef.ravel()}
    )


def cross_products(vectors: DataFrame, lags: int) -> DataFrame:
    """x'[x y] per store: term ``i`` against term ``j``, or against equation ``j - n_terms``."""
    products = lag_design(vectors, lags).mapInPandas(
        _partial_products, "store_id string, n_terms int, i int, j int, v double"
    )
    return products.groupBy("store_id", "n_terms", "i", "j").agg(F.sum("v").alias("v"))


def fit_varx(vectors: DataFrame, lags: int, tolerance: float = 1e-10) -> DataFrame:
    """Coefficients per store: one row per (equation, term); collinear terms get the least-norm solution.

    Terms are scaled to one length; a direction of less than ``tolerance`` times the largest eigenvalue counts as collinear.
    """
    products = cross_products(vectors, lags).groupBy("store_id")
    return products.applyInPandas(lambda rows: _solve(rows, tolerance), COEF_SCHEMA)


def name_terms(coefs: DataFrame, vectors: DataFrame, exog_names: Sequence[str]) -> DataFrame:
    """Coefficients with the department of their equation and a readable term."""
    depts = vectors.groupBy("store_id").agg(F.first("depts").alias("depts"))
    n = 1 + len(exog_names)
    names = F.array(F.lit("const"), *[F.lit(c) for c in exog_names])
    offset, m = F.col("term") - n, F.size("depts")
    lagged = F.concat(
        F.lit("L"),
        (F.floor(offset / m) + 1).cast("string"),
        F.lit("."),
        F.get("depts", F.pmod(offset, m)),
    )
    return coefs.join(depts, "store_id").select(
        "store_id",
        F.get("depts", F.col("eq")).alias("dept_id"),
        F.col("term").alias("term_ix"),
        F.when(F.col("term") < n, F.get(names, F.col("term"))).otherwise(lagged).alias("term"),
        "coef",
    )


FORECAST_SCHEMA = (
    "store_id string, dept_id string, origin int, step int, day_num int, d_level_fcast double, level_fcast double"
)


def forecast_varx(
    vectors: DataFrame,
    coefs: DataFrame,
    *,
    lags: int,
    horizon: int,
    first_origin: int,
    last_origin: int,
    exog: str = "future",
    block: int = 256,
) -> DataFrame:
    """Forecast every origin in ``[first_origin, last_origin]``; an origin is the first day it forecasts.

    ``exog="future"`` feeds the exogenous values of the forecast days;
    ``exog="input"`` repeats those of the input window (needs ``lags == horizon``).
    """
    if exog not in ("future", "input"):
        raise ValueError("exog must be 'future' or 'input'")
    if exog == "input" and lags != horizon:
        raise ValueError("exog='input' needs as many lags as steps")
    shift = 0 if exog == "future" else lags

    def run_block(key, data: pd.DataFrame, system: pd.DataFrame) -> pd.DataFrame:
        if system.empty and not data.empty:
            raise ValueError(f"store {key[0]} has no coefficients")
        if data.empty:
            return pd.DataFrame(columns=[c.split()[0] for c in FORECAST_SCHEMA.split(", ")])
        data = data.sort_values("day_num")
        days = data["day_num"].to_numpy()
        if (np.diff(days) != 1).any():
            raise ValueError(f"store {key[0]} is not daily")
        names = list(data["depts"].iloc[0])
        m, block_no = len(names), int(key[1])
        y = np.vstack(data["y"].to_numpy()).astype(float)
        level = np.vstack(data["level"].to_numpy()).astype(float)
        x = np.column_stack([np.ones(len(data)), np.vstack(data["exog"].to_numpy())])
        coef = np.zeros((int(system["term"].max()) + 1, m))
        coef[system["term"].to_numpy(), system["eq"].to_numpy()] = system["coef"].to_numpy()
        known, feedback = x @ coef[: x.shape[1]], coef[x.shape[1] :]
        low = max(first_origin, block_no * block)
        origins = np.arange(low, min(last_origin, block_no * block + block - 1) + 1)
        at = origins - days[0]
        if at[0] < lags or at[-1] + horizon > len(days):
            raise ValueError(f"store {key[0]}: origins {origins[0]}..{origins[-1]} lack history or future rows")
        past = np.stack([y[at - lag] for lag in range(1, lags + 1)], axis=1)
        steps = np.empty((len(origins), horizon, m))
        for s in range(horizon):
            steps[:, s] = known[at + s - shift] + past.reshape(len(origins), -1) @ feedback
            past = np.concatenate([steps[:, s : s + 1], past[:, :-1]], axis=1)
        path = level[at - 1][:, None, :] + steps.cumsum(axis=1)
        n, (o, s, d) = steps.size, np.indices(steps.shape)
        return pd.DataFrame(
            {
                "store_id": np.repeat(key[0], n),
                "dept_id": np.asarray(names, dtype=object)[d.ravel()],
                "origin": origins[o.ravel()],
                "step": s.ravel() + 1,
                "day_num": (origins[o.ravel()] + s.ravel()),
                "d_level_fcast": steps.ravel(),
                "level_fcast": path.ravel(),
            }
        )

    # a day serves the origins it precedes by up to ``lags`` days or follows by less than ``horizon`` days
    low = F.greatest(F.col("day_num") - horizon + 1, F.lit(first_origin))
    high = F.least(F.col("day_num") + lags, F.lit(last_origin))
    blocks = F.explode(F.sequence(F.floor(low / block), F.floor(high / block)))
    data = vectors.where(low <= high).select("store_id", blocks.alias("block_no"), "day_num", "depts", "y", "level", "exog")
    numbers = F.sequence(F.lit(first_origin // block).cast("bigint"), F.lit(last_origin // block).cast("bigint"))
    systems = coefs.select("store_id", F.explode(numbers).alias("block_no"), "eq", "term", "coef")
    keys = ["store_id", "block_no"]
    return data.groupBy(*keys).cogroup(systems.groupBy(*keys)).applyInPandas(run_block, FORECAST_SCHEMA)
