import dataclasses

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from tidecast.operators import boost, residual, varx
from tidecast.plans.recursive import FeatureSpec, forecast_recursive
from tidecast.session import materialize

LAGS, DAYS, AHEAD = 2, 60, 5


@pytest.fixture(scope="module")
def system(spark):
    """Two stores of two departments with one exogenous column; the last days have no demand."""
    rng = np.random.default_rng(0)
    rows, data = [], {}
    for store in ("A_1", "B_1"):
        y = rng.normal(size=(DAYS, 2)).round(3)
        x = rng.normal(size=DAYS + AHEAD).round(3)
        level = 100 + y.cumsum(axis=0)
        data[store] = (y, x, level)
        for d in range(DAYS + AHEAD):
            known = d < DAYS
            for i, dept in enumerate(("p", "q")):
                rows.append(
                    (store, dept, d + 1, float(y[d, i]) if known else None, float(level[d, i]) if known else None, float(x[d]))
                )
    df = spark.createDataFrame(rows, "store_id string, dept_id string, day_num int, d_level double, level double, x double")
    exog = df.groupBy("store_id", "day_num").agg(F.array(F.first("x")).alias("exog"))
    vectors = varx.store_vectors(df.repartition(5)).join(exog, ["store_id", "day_num"])
    return materialize(vectors), data


def least_squares(y, x):
    rows = range(LAGS, DAYS)
    z = np.array([[1.0, x[d], *y[d - 1], *y[d - 2]] for d in rows])
    return np.linalg.lstsq(z, y[LAGS:DAYS], rcond=None)[0]


def test_coefficients_equal_least_squares(system):
    vectors, data = system
    coefs = varx.fit_varx(vectors, LAGS).collect()
    for store, (y, x, _) in data.items():
        want = least_squares(y, x)
        got = {(r.term, r.eq): r.coef for r in coefs if r.store_id == store}
        assert len(got) == want.size
        assert all(got[i, j] == pytest.approx(want[i, j], abs=1e-8) for i in range(6) for j in range(2))


def test_term_names(system):
    vectors, _ = system
    named = varx.name_terms(varx.fit_varx(vectors, LAGS), vectors, ["x"]).where("store_id = 'A_1' and dept_id = 'p'")
    assert [r.term for r in named.orderBy("term_ix").collect()] == ["const", "x", "L1.p", "L1.q", "L2.p", "L2.q"]


@pytest.mark.parametrize("exog", ["future", "input"])
@pytest.mark.parametrize("block", [4, 256])
def test_forecasts_equal_a_plain_loop(system, exog, block):
    vectors, data = system
    horizon = AHEAD if exog == "future" else LAGS
    coefs = varx.fit_varx(vectors, LAGS)
    first, last = LAGS + 1, DAYS + AHEAD - horizon + 1 if exog == "future" else DAYS + 1
    out = varx.forecast_varx(
        vectors, coefs, lags=LAGS, horizon=horizon, first_origin=first, last_origin=last, exog=exog, block=block
    ).collect()
    assert len(out) == 2 * 2 * horizon * (last - first + 1)
    got = {(r.store_id, r.dept_id, r.origin, r.step): (r.day_num, r.level_fcast) for r in out}
    for store, (y, x, level) in data.items():
        coef = least_squares(y, x)
        for origin in (first, 7, 8, last):
            past, path = [y[origin - 2], y[origin - 3]], level[origin - 2].copy()
            for s in range(horizon):
                day = origin - 1 + s - (0 if exog == "future" else LAGS)
                f = np.array([1.0, x[day], *past[0], *past[1]]) @ coef
                path, past = path + f, [f, past[0]]
                for i, dept in enumerate(("p", "q")):
                    day_num, fcast = got[store, dept, origin, s + 1]
                    assert day_num == origin + s and fcast == pytest.approx(path[i], abs=1e-6)


def test_origins_without_history_are_an_error(system):
    vectors, _ = system
    coefs = varx.fit_varx(vectors, LAGS)
    with pytest.raises(Exception, match="lack history"):
        varx.forecast_varx(vectors, coefs, lags=LAGS, horizon=3, first_origin=2, last_origin=4).collect()


@pytest.fixture(scope="module")
def counts(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(600):
        store, x = ("a", "b", "c")[i % 3], float(rng.uniform(0, 4))
        mu = np.exp(0.5 * (i % 3) + 0.4 * x)
        rows.append((i, store, x if i % 50 else None, float(rng.poisson(mu))))
    df = spark.createDataFrame(rows, "k int, store string, x double, y double")
    df = boost.fill_missing(df, ["x"])
    return boost.feature_pipeline(df, ["x", "x_missing"], ["store"]).transform(df)


def test_category_metadata_survives_a_written_frame(counts):
    written = materialize(counts)
    assert boost.max_arity(written) == 3
    assert boost.vector_names(written) == ["x", "x_missing", "store_ix"]


def nll(df):
    return df.select(F.avg(F.col("yhat") - F.col("y") * F.log("yhat"))).first()[0]


def test_poisson_boost_beats_the_constant_and_keeps_improving(spark, counts, tmp_path):
    train, valid = counts.where("k % 4 > 0"), counts.where("k % 4 = 0")
    model = boost.fit_poisson_boost(
        train, valid, "y", ["k"], rounds=6, rate=0.3, max_depth=3, min_rows=5, max_delta_step=0.0, cut_every=2
    )
    losses = [h["train_nll"] for h in model.history]
    assert losses == sorted(losses, reverse=True) and len(losses) == 6
    mean = train.agg(F.avg("y")).first()[0]
    assert nll(model.transform(valid)) < nll(valid.withColumn("yhat", F.lit(mean)))
    names = boost.vector_names(counts)
    assert names == ["x", "x_missing", "store_ix"]
    ranked = model.importance(names)
    assert sum(v for _, v in ranked) == pytest.approx(1.0) and ranked == sorted(ranked, key=lambda p: (p[1], p[0]))
    model.save(spark, str(tmp_path / "m"))
    again = boost.Boosted.load(spark, str(tmp_path / "m"))
    assert [r.yhat for r in again.transform(valid).orderBy("k").collect()] == pytest.approx(
        [r.yhat for r in model.transform(valid).orderBy("k").collect()]
    )


def test_first_tree_holds_newton_steps(counts):
    model = boost.fit_poisson_boost(counts, None, "y", ["k"], rounds=1, rate=1.0, max_depth=1, max_delta_step=0.0)
    mean = counts.agg(F.avg("y")).first()[0]
    leaves = model.transform(counts).groupBy("yhat").agg(F.avg("y").alias("m")).collect()
    assert len(leaves) == 2
    for leaf in leaves:
        assert leaf.yhat == pytest.approx(mean * np.exp(leaf.m / mean - 1))


def test_early_stopping_keeps_the_best_prefix(counts):
    noise = counts.withColumn("y", F.reverse(F.col("y").cast("string")).cast("double") * 0 + F.pmod(F.xxhash64("k"), F.lit(5)))
    model = boost.fit_poisson_boost(
        noise.where("k % 2 = 0"), noise.where("k % 2 = 1"), "y", ["k"], rounds=8, rate=1.0, max_depth=6, min_rows=1, patience=1
    )
    seen = [h["valid_rmse"] for h in model.history]
    assert len(seen) < 8 and model.n_trees == max(1, int(np.argmin(seen)) + 1)


def test_glm(counts):
    glm = boost.fit_poisson_glm(counts, "y")
    assert all(r.yhat > 0 for r in glm.transform(counts).collect())


def test_residual_model_stops_by_patience(counts):
    noise = counts.withColumn("resid", F.pmod(F.xxhash64("k"), F.lit(7)).cast("double"))
    train, valid = noise.where("k % 2 = 0"), noise.where("k % 2 = 1")
    model = residual.fit_residual_boost(train, valid, "resid", ["k"], rounds=30, rate=0.8, max_depth=5, min_rows=1, patience=2, subsample=0.8)
    seen = [h["valid_rmse"] for h in model.history]
    best = int(np.argmin(seen)) + 1
    assert len(seen) < 30 and len(seen) - best == 2 and model.n_trees == best
    # the kept prefix scores as it did while it was the last
    found = model.transform(valid).agg(F.sqrt(F.avg(F.pow(F.col("resid") - F.col("yhat"), F.lit(2.0))))).first()[0]
    assert found == pytest.approx(seen[best - 1])


def test_residual_model_explains(counts):
    resid = counts.withColumn("resid", F.col("y") - 2.0)
    model = residual.fit_residual_boost(resid.where("k % 4 > 0"), resid.where("k % 4 = 0"), "resid", ["k"], rounds=4, rate=0.5, max_depth=3)
    error = model.transform(resid).agg(F.avg(F.pow(F.col("resid") - F.col("yhat"), F.lit(2.0)))).first()[0]
    assert error < resid.agg(F.var_pop("resid")).first()[0]


@pytest.mark.parametrize("loss", ["poisson", "squared"])
def test_penalty_on_leaves(counts, loss):
    made = boost.LOSSES[loss]()
    rows = counts.select("k", "y", "store", "features").withColumn("held", F.lit(False))
    model = boost.boost_rows(rows, "y", ["k"], loss=made, rounds=2, rate=0.5, max_depth=2, l2=30.0)
    free = boost.boost_rows(rows, "y", ["k"], loss=made, rounds=2, rate=0.5, max_depth=2)
    tree, data = free.ensemble.trees[0], rows.toPandas()
    leaf = np.array([tree.predictLeaf(v) for v in data.features])
    base = model.base
    g = data.y - (np.exp(base) if loss == "poisson" else base)
    h = np.full(len(data), np.exp(base) * np.exp(0.7) if loss == "poisson" else 1.0)
    want = {i: g[leaf == i].sum() / (h[leaf == i].sum() + 30.0) for i in set(leaf)}
    assert len(want) > 2
    first = model.ensemble.trees[0]
    assert [first.predict(v) for v in data.features] == pytest.approx([want[i] for i in leaf])


def plain_boost(trees, frame, base, rate, shrink):
    """Score of every row, from the leaves that the trees name: pooled values and those of the series."""
    eta, pooled, own = np.full(len(frame), base), [], []
    for tree in trees:
        leaf, g = np.array([int(tree.predictLeaf(v)) for v in frame.features]), frame.y.to_numpy() - eta
        v = {i: g[leaf == i].mean() for i in set(leaf)}
        table = {}
        for s in set(frame.store):
            for i in set(leaf):
                at = (leaf == i) & (frame.store == s)
                if at.any():
                    table[s, i] = (g[at].sum() + shrink * v[i]) / (at.sum() + shrink)
        pooled.append(v)
        own.append(table)
        eta = eta + rate * np.array([table[s, i] for s, i in zip(frame.store, leaf)])
    return eta, pooled, own


def test_series_have_leaves_of_their_own(spark, counts, tmp_path):
    # the store is no feature here: only its leaves can tell it apart
    df = boost.feature_pipeline(counts.drop("features", "store_ix"), ["x", "x_missing"], []).transform(counts.drop("features", "store_ix"))
    rows = df.select("k", "y", "store", "features").withColumn("held", F.lit(False))
    options = {"rounds": 6, "rate": 0.5, "max_depth": 2, "cut_every": 3}
    model = residual.fit_residual_boost(rows, None, "y", ["k"], ["store"], shrink=10.0, **options)
    frame = rows.toPandas()
    want, pooled, _ = plain_boost(model.ensemble.trees, frame, model.base, 0.5, 10.0)
    scored = model.transform(rows).toPandas()
    got = dict(zip(scored.k, scored.yhat))
    assert [got[k] for k in frame.k] == pytest.approx(list(want))
    common = residual.fit_residual_boost(rows, None, "y", ["k"], **options)
    assert model.history[-1]["train_rmse"] < common.history[-1]["train_rmse"] - 0.1
    # a series that training has not seen gets the pooled values
    other = model.transform(rows.withColumn("store", F.lit("new"))).toPandas()
    for r in other.itertuples():
        leaves = [int(t.predictLeaf(r.features)) for t in model.ensemble.trees]
        assert r.yhat == pytest.approx(model.base + 0.5 * sum(v[i] for v, i in zip(pooled, leaves)))
    model.save(spark, str(tmp_path / "m"))
    again = boost.Boosted.load(spark, str(tmp_path / "m")).transform(rows).toPandas()
    assert dict(zip(again.k, again.yhat)) == pytest.approx(got)


def test_split_counts(spark, counts):
    model = boost.fit_poisson_boost(counts, None, "y", ["k"], rounds=3, max_depth=2)
    used = {r.feature: r.splits for r in model.split_counts(spark, boost.vector_names(counts)).collect()}
    assert set(used) == {"x", "x_missing", "store_ix"}
    assert sum(used.values()) == sum((t.numNodes - 1) // 2 for t in model.ensemble.trees)


def test_too_many_labels_for_a_tree(spark):
    df = spark.range(300).select(F.col("id").cast("string").alias("v"), F.lit("a").alias("w"))
    with pytest.raises(ValueError, match="more than 256 labels in v"):
        boost.category_indexer(df, ["w", "v"])
    model = boost.category_indexer(df.where("v < 12"), ["w", "v"])
    assert [list(v) for v in model.labelsArray] == [["a"], sorted(str(i) for i in range(12))]


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(2)
    rows = [(k, d, float(rng.integers(0, 50))) for k in "ab" for d in range(1, 61) if not (k == "b" and d in (50, 51))]
    return spark.createDataFrame(rows, "id string, day int, sales double")


SPEC = FeatureSpec(("id",), "day", "sales", {"lag_7": 7, "lag_28": 28}, {"m": (7, 7), "n": (28, 28)})


def predict(df):
    return df.withColumn(
        "yhat", (F.coalesce("lag_7", F.lit(0.0)) + F.coalesce("lag_28", F.lit(0.0)) + F.col("m") + F.col("n")) / 4 + F.col("bump")
    )


def future_rows(series):
    days = F.explode(F.sequence(F.lit(61), F.lit(88))).alias("day")
    return series.select("id").distinct().select("id", days).withColumn("bump", F.pmod("day", F.lit(3)).cast("double"))


def test_block_recursion_equals_daily_recursion(series):
    future = future_rows(series)
    blocks = forecast_recursive(series, future, SPEC, predict, 61, 88)
    daily = forecast_recursive(series, future, SPEC, predict, 61, 88, block=1)
    got = {(r.id, r.day): r.yhat for r in blocks.collect()}
    assert len(got) == 56
    assert got == pytest.approx({(r.id, r.day): r.yhat for r in daily.collect()})


def test_recursion_equals_a_plain_loop(series):
    history = {}
    for r in series.collect():
        history[r.id, r.day] = r.sales
    got = {(r.id, r.day): r.yhat for r in forecast_recursive(series, future_rows(series), SPEC, predict, 61, 88).collect()}
    for k in "ab":
        for d in range(61, 89):
            def mean(lag, win):
                seen = [history[k, x] for x in range(d - lag - win + 1, d - lag + 1) if (k, x) in history]
                return sum(seen) / len(seen)

            want = (history.get((k, d - 7), 0.0) + history.get((k, d - 28), 0.0) + mean(7, 7) + mean(28, 28)) / 4 + d % 3
            assert got[k, d] == pytest.approx(want)
            history[k, d] = want


def test_block_cannot_exceed_the_smallest_lag(series):
    assert SPEC.block == 7 and SPEC.reach == 55
    with pytest.raises(ValueError):
        forecast_recursive(series, future_rows(series), SPEC, predict, 61, 88, block=8)


def test_an_ensemble_of_400_trees_is_scored_saved_and_loaded(spark, tmp_path):
    rows = [(Vectors.dense(float(i % 7), float(i % 3)), float(i % 7 + 2 * (i % 3))) for i in range(60)]
    df = spark.createDataFrame(rows, ["features", "y"])
    trees = [DecisionTreeRegressor(labelCol="y", maxDepth=d).fit(df) for d in (1, 2)]
    model = boost.Boosted(0.1, boost.as_ensemble(spark, trees * 200, 0.001))
    assert model.n_trees == 400
    one, two = ([r.prediction for r in t.transform(df).collect()] for t in trees)
    want = [0.1 + 0.2 * (a + b) for a, b in zip(one, two)]
    assert np.allclose([r.eta for r in model.add_score(df).collect()], want)
    model.save(spark, str(tmp_path / "m"))
    again = boost.Boosted.load(spark, str(tmp_path / "m"))
    assert np.allclose([r.eta for r in again.add_score(df).collect()], want)
    assert [n for n, _ in again.importance(["a", "b"])] == [n for n, _ in model.importance(["a", "b"])]


@pytest.fixture(scope="module")
def repeated(spark):
    """Rows of few distinct features, each many times with labels of its own."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(1_200):
        a, b = i % 4, int(rng.integers(0, 6))
        rows.append((i, "uv"[i % 2], float(a), float(b), float(3 * (a > 1) - b + rng.normal()), i % 5 == 0))
    df = spark.createDataFrame(rows, "k int, store string, a double, b double, y double, held boolean")
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)


def test_rows_with_the_same_features_are_held_as_one(repeated):
    rows = repeated.select("features", "store", "held", "y")
    cells = boost.alike(rows)
    few = cells.agg(F.count("*").alias("rows"), F.sum("n").alias("n")).first()
    assert few.n == 1_200 and few.rows <= 48
    lost = cells.agg(F.sum(F.col("ss") + F.col("n") * F.col("y") * F.col("y"))).first()[0]
    assert lost == pytest.approx(rows.agg(F.sum(F.col("y") * F.col("y"))).first()[0])


@pytest.mark.parametrize("series", [(), ("store",)])
@pytest.mark.parametrize("min_rows", [1, 130])
def test_rows_held_as_one_grow_the_same_trees(repeated, series, min_rows):
    options = {"rounds": 4, "rate": 0.5, "max_depth": 3, "min_rows": min_rows, "l2": 1.0, "series": series, "patience": 4}
    one_by_one = dataclasses.replace(boost.squared(), square=False)
    want = boost.boost_rows(repeated, "y", ["k"], loss=one_by_one, **options)
    got = residual.fit_residual_boost(repeated.where("NOT held"), repeated.where("held"), "y", ["k"], **options)
    cells = boost.alike(repeated.select("features", "held", *series, "y"))
    ready = residual.fit_residual_cells(cells, **options)
    told = [[r.yhat for r in m.transform(repeated).orderBy("k").collect()] for m in (want, got, ready)]
    assert told[1] == pytest.approx(told[0]) and told[2] == pytest.approx(told[0])
    assert got.n_trees == want.n_trees
    for a, b in zip(want.history, got.history, strict=True):
        assert b == pytest.approx(a)


def test_too_few_rows_for_two_leaves_grow_no_split(repeated):
    few = repeated.where("NOT held").limit(39)
    model = residual.fit_residual_boost(few, None, "y", ["k"], rounds=1, rate=1.0, min_rows=20)
    assert model.transform(few).select("yhat").distinct().count() == 1
