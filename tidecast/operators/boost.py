"""Gradient-boosted trees grown with Spark ML under any loss that is given as columns, and a Poisson GLM baseline.

Spark ML's own boosting covers squared and absolute loss only, knows a tolerance instead of patience, and no penalty
on leaves. Here a loss is a gradient and a weight (Newton boosting, Friedman 2001): each round fits one weighted
regression tree to ``gradient / weight`` with that weight, so every leaf holds the Newton step
``sum(gradient) / sum(weight)``. Both sums of a leaf stand in the tree's saved nodes; from them the leaf's value is
estimated again with a penalty, ``sum(gradient) / (sum(weight) + l2)``, and, where asked for, once more per series.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (
    DecisionTreeRegressionModel,
    DecisionTreeRegressor,
    GBTRegressionModel,
    GeneralizedLinearRegression,
    GeneralizedLinearRegressionModel,
)
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidecast.session import materialize, remove, shared_path, spread

#: Categories of one column that a tree may tell apart: the bins that Spark ML counts on the driver for every node.
MAX_LABELS = 256


@dataclass(frozen=True)
class Loss:
    """What a boosting round needs to know of a loss, as columns of the label and the running score."""

    name: str
    start: Callable[[float], float]
    expected: Callable[[Column], Column]
    gradient: Callable[[Column, Column], Column]
    weight: Callable[[Column, Column], Column]
    row_loss: Callable[[Column, Column], Column]
    #: the weight is 1 and the loss a square: rows with the same features may be held as one, see ``alike``
    square: bool = False


def poisson(max_delta_step: float = 0.7) -> Loss:
    """Score on the log scale; weights are inflated by ``exp(max_delta_step)``, which damps the steps."""

    def start(mean: float) -> float:
        if not mean or mean <= 0:
            raise ValueError("the Poisson loss needs a positive mean label")
        return math.log(mean)

    damp = math.exp(max_delta_step)
    return Loss(
        "poisson",
        start,
        F.exp,
        lambda y, eta: y - F.exp(eta),
        lambda y, eta: F.exp(eta) * damp,
        lambda y, eta: F.exp(eta) - y * eta,
    )


def squared() -> Loss:
    return Loss(
        "squared",
        lambda mean: mean or 0.0,
        lambda eta: eta,
        lambda y, eta: y - eta,
        lambda y, eta: F.lit(1.0),
        lambda y, eta: (y - eta) * (y - eta),
        square=True,
    )


LOSSES = {"poisson": poisson, "squared": squared}


def fill_missing(df: DataFrame, columns: Sequence[str], value: float = -1.0) -> DataFrame:
    """Vectors cannot hold missing values: fill them and keep a ``{c}_missing`` indicator."""
    flags = {f"{c}_missing": F.col(c).isNull().cast("double") for c in columns}
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(value)) for c in columns}
    return df.withColumns(flags).withColumns(filled)


def category_indexer(
    df: DataFrame, categorical: Sequence[str], on_unseen: str = "error", max_labels: int = MAX_LABELS
) -> StringIndexerModel:
    """``{c}_ix`` codes in sorted label order; an unseen label is an error by default.

    A tree node counts every label on the driver, so a column of more than ``max_labels`` labels raises; give such a
    column to the learner as a number (``encode.TargetMeans``). Only the distinct labels leave the tasks.
    """
    pairs = [F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v")) for i, c in enumerate(categorical)]
    labels = df.select(F.explode(F.array(*pairs)).alias("s")).select("s.*").where("v IS NOT NULL").distinct().persist()
    counts = {r.i: r.n for r in labels.groupBy("i").agg(F.count("*").alias("n")).collect()}  # one row a column
    if large := [c for i, c in enumerate(categorical) if counts.get(i, 0) > max_labels]:
        labels.unpersist()
        raise ValueError(f"more than {max_labels} labels in {', '.join(large)}")
    held = {r.i: r.v for r in labels.groupBy("i").agg(F.array_sort(F.collect_list("v")).alias("v")).collect()}
    labels.unpersist()
    # as many rows as the longest list, shorter ones begin again
    lists = [held.get(i) or [None] for i in range(len(categorical))]
    rows = [tuple(v[k % len(v)] for v in lists) for k in range(max(map(len, lists)))]
    small = df.sparkSession.createDataFrame(rows, ", ".join(f"`{c}` string" for c in categorical))
    return StringIndexer(
        inputCols=list(categorical),
        outputCols=[f"{c}_ix" for c in categorical],
        stringOrderType="alphabetAsc",
        handleInvalid=on_unseen,
    ).fit(small)


def feature_pipeline(
    df: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    on_unseen: str = "error",
    one_hot: bool = False,
) -> PipelineModel:
    """Index the categories and assemble one feature vector; linear models need ``one_hot``."""
    stages, encoded = [], [f"{c}_ix" for c in categorical]
    if categorical:
        stages.append(category_indexer(df, categorical, on_unseen))
        if one_hot:
            hot = [f"{c}_hot" for c in categorical]
            sizes = stages[0].transform(df.select(*categorical).distinct())
            stages.append(OneHotEncoder(inputCols=encoded, outputCols=hot).fit(sizes))
            encoded = hot
    stages.append(VectorAssembler(inputCols=[*numeric, *encoded], outputCol="features"))
    return PipelineModel(stages)


def vector_names(df: DataFrame, column: str = "features") -> list[str]:
    attrs = df.schema[column].metadata["ml_attr"]["attrs"]
    flat = sorted((a["idx"], a["name"]) for group in attrs.values() for a in group)
    return [name for _, name in flat]


def max_arity(df: DataFrame, column: str = "features") -> int:
    nominal = df.schema[column].metadata.get("ml_attr", {}).get("attrs", {}).get("nominal", [])
    return max((len(a.get("vals", [])) for a in nominal), default=0)


def as_ensemble(spark: SparkSession, trees: Sequence[DecisionTreeRegressionModel], rate: float) -> GBTRegressionModel:
    """Trees as one Spark ML ensemble of equal weights, so that a row is scored in one pass however many there are."""
    gateway, jvm = spark.sparkContext._gateway, spark._jvm
    models = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(trees))
    weights = gateway.new_array(jvm.double, len(trees))
    for i, tree in enumerate(trees):
        models[i], weights[i] = tree._java_obj, rate
    uid = f"Boosted_{uuid.uuid4().hex[:12]}"
    return GBTRegressionModel(jvm.org.apache.spark.ml.regression.GBTRegressionModel(uid, models, weights))


def saved_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of a tree or an ensemble saved at ``path``: ``tree, id, is_leaf, feature, h, g``.

    Nodes are numbered from the root, left before right, so the leaves in order of ``id`` are the leaves 0, 1, .. that
    ``leafCol`` names. ``h`` and ``g`` are the sums of the weights and of the weighted labels that grew the node.
    """
    data = spark.read.parquet(f"{path}/data")
    if "nodeData" in data.columns:
        data = data.select(F.col("treeID").alias("tree"), "nodeData.*")
    else:
        data = data.withColumn("tree", F.lit(0))
    return data.select(
        "tree",
        "id",
        (F.col("leftChild") < 0).alias("is_leaf"),
        F.col("split.featureIndex").alias("feature"),
        F.col("impurityStats")[0].alias("h"),
        F.col("impurityStats")[1].alias("g"),
    )


def leaf_values(spark: SparkSession, tree: DecisionTreeRegressionModel, l2: float) -> list[float]:
    """Penalised value of every leaf of a tree, in the order of ``leafCol``; at most ``2 ** depth`` of them."""
    path = shared_path(spark, "tree")
    tree.write().overwrite().save(path)
    rows = saved_nodes(spark, path).where("is_leaf").orderBy("id").collect()
    remove(spark, path)
    return [r.g / (r.h + l2) for r in rows]


def penalised(spark: SparkSession, ensemble: GBTRegressionModel, l2: float) -> GBTRegressionModel:
    """The ensemble with ``sum(g) / (sum(h) + l2)`` in every leaf: its saved nodes are rewritten and loaded again."""
    old, new = shared_path(spark, "trees"), shared_path(spark, "trees")
    ensemble.write().overwrite().save(old)
    node = F.col("nodeData")
    value = node["impurityStats"][1] / (node["impurityStats"][0] + l2)
    data = spark.read.parquet(f"{old}/data")
    fresh = F.when(node["leftChild"] < 0, value).otherwise(node["prediction"])
    data.withColumn("nodeData", node.withField("prediction", fresh)).write.parquet(f"{new}/data")
    spark.read.parquet(f"{old}/treesMetadata").write.parquet(f"{new}/treesMetadata")
    spark.read.text(f"{old}/metadata").coalesce(1).write.text(f"{new}/metadata")
    loaded = GBTRegressionModel.load(new)
    remove(spark, old)
    remove(spark, new)
    return loaded


@dataclass
class Boosted:
    """A fitted ensemble: ``eta = base + ensemble``, and what its series add to the leaves, if they have their own."""

    base: float
    ensemble: GBTRegressionModel | None
    loss: str = "poisson"
    rate: float = 1.0
    #: one row a series: its columns and ``_fixes``, an array of ``(tree, deltas)`` with what it adds to each leaf
    fixes: DataFrame | None = None
    history: list[dict] = field(default_factory=list)

    @property
    def n_trees(self) -> int:
        return self.ensemble.getNumTrees if self.ensemble else 0

    @property
    def series(self) -> list[str]:
        return [] if self.fixes is None else [c for c in self.fixes.columns if c != "_fixes"]

    def add_score(self, df: DataFrame) -> DataFrame:
        """Add ``eta``; a series that training has not seen, or not in some leaf, gets the pooled value there."""
        if self.ensemble is None:
            return df.withColumn("eta", F.lit(self.base))
        model = self.ensemble.setPredictionCol("_margin")
        if self.fixes is None:
            return model.transform(df).withColumn("eta", F.lit(self.base) + F.col("_margin")).drop("_margin")
        model = model.copy().setLeafCol("_leaves")
        scored = model.transform(df).withColumn("_at", vector_to_array("_leaves")).join(self.fixes, self.series, "left")
        # the leaves are bound once by the outer transform, not computed again for every tree
        own = F.expr(
            "transform(array(_at), at -> aggregate(coalesce(_fixes, array()), 0D, (s, f) -> "
            "s + coalesce(try_element_at(f.deltas, CAST(at[f.tree] AS INT)), 0D)))[0]"
        )
        eta = F.lit(self.base) + F.col("_margin") + F.lit(self.rate) * own
        return scored.withColumn("eta", eta).select(*df.columns, "eta")

    def transform(self, df: DataFrame, name: str = "yhat") -> DataFrame:
        expected = LOSSES[self.loss]().expected
        return self.add_score(df).withColumn(name, expected(F.col("eta"))).drop("eta")

    def importance(self, names: Sequence[str]) -> list[tuple[str, float]]:
        """Mean gain share per feature, ascending by value and name."""
        share = self.ensemble.featureImportances.toArray() if self.ensemble else [0.0] * len(names)
        return sorted(zip(names, map(float, share)), key=lambda p: (p[1], p[0]))

    def split_counts(self, spark: SparkSession, names: Sequence[str]) -> DataFrame:
        """``(feature, splits)``: how many nodes of the saved ensemble split on each feature, unused ones included."""
        named = spark.createDataFrame(list(enumerate(names)), "feature int, name string")
        if self.ensemble is None:
            return named.select(F.col("name").alias("feature"), F.lit(0).cast("long").alias("splits"))
        path = shared_path(spark, "nodes")
        self.ensemble.write().overwrite().save(path)
        used = saved_nodes(spark, path).where("NOT is_leaf").groupBy("feature").agg(F.count("*").alias("splits"))
        joined = named.join(used, "feature", "left")
        return joined.select(F.col("name").alias("feature"), F.coalesce("splits", F.lit(0)).alias("splits"))

    def save(self, spark: SparkSession, path: str) -> None:
        row = (self.base, self.n_trees, self.loss, self.rate, self.fixes is not None)
        meta = spark.createDataFrame([row], "base double, trees int, loss string, rate double, own boolean")
        meta.write.mode("overwrite").parquet(f"{path}/meta")
        if self.ensemble:
            self.ensemble.write().overwrite().save(f"{path}/ensemble")
        if self.fixes is not None:
            self.fixes.write.mode("overwrite").parquet(f"{path}/fixes")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Boosted:
        meta = spark.read.parquet(f"{path}/meta").first()
        ensemble = GBTRegressionModel.load(f"{path}/ensemble") if meta.trees else None
        fixes = spark.read.parquet(f"{path}/fixes") if meta.own else None
        return cls(meta.base, ensemble, meta.loss, meta.rate, fixes)


def fit_poisson_boost(
    train: DataFrame, valid: DataFrame | None, label: str, key: Sequence[str], max_delta_step: float = 0.7, **options
) -> Boosted:
    """Boost Poisson trees on the ``features`` vector of ``train``; ``options`` as in ``boost_rows``."""
    return boost_rows(flagged(train, valid, ["features", label, *key]), label, key, loss=poisson(max_delta_step), **options)


def flagged(train: DataFrame, valid: DataFrame | None, columns: Sequence[str | Column]) -> DataFrame:
    """Training and validation rows as one frame with a ``held`` flag."""
    columns = [*dict.fromkeys(c for c in columns if isinstance(c, str)), *[c for c in columns if not isinstance(c, str)]]
    rows = train.select(*columns, F.lit(False).alias("held"))
    return rows if valid is None else rows.unionByName(valid.select(*columns, F.lit(True).alias("held")))


def series_fixes(scored: DataFrame, grown: Column, g: Column, h: Column, pooled: Column, series: Sequence[str], shrink: float) -> DataFrame:
    """One row a series: ``deltas``, a map from leaf to what the series adds to the pooled value ``v`` of the leaf.

    The leaf of the series alone would hold ``sum(g) / sum(h)``; it is shrunk to ``v`` as if ``shrink`` weight of pooled
    rows stood beside its own, ``(sum(g) + shrink v) / (sum(h) + shrink)``, of which ``v`` is taken off.
    """
    sums = scored.where(grown).groupBy(*series, F.col("leaf").cast("int").alias("leaf")).agg(
        F.sum(g).alias("g"), F.sum(h).alias("h"), F.first(pooled).alias("v")
    )
    delta = (F.col("g") - F.col("v") * F.col("h")) / (F.col("h") + shrink)
    return sums.groupBy(*series).agg(F.map_from_entries(F.collect_list(F.struct("leaf", delta))).alias("deltas"))


def alike(rows: DataFrame) -> DataFrame:
    """Rows with the same features (series and ``held`` included) as one: the mean of ``y``, their number ``n``, and
    ``ss``, the sum of squares about that mean.

    They get the same score in every round, so under the squared loss they grow the same trees as one row of weight
    ``n``: in the gain of a split, what lies inside of them cancels out. With features that hardly repeat it is as many
    rows as before. Rows without a label stay apart from the others. The features may be a vector or its parts.
    """
    y, n = F.col("y"), F.count(F.lit(1))
    same = [*[c for c in rows.columns if c != "y"], y.isNull().alias("_none")]
    return rows.groupBy(*same).agg(F.avg(y).alias("y"), n.alias("n"), (F.var_pop(y) * n).alias("ss")).drop("_none")


def boost_rows(
    rows: DataFrame,
    label: str,
    key: Sequence[str],
    *,
    loss: Loss | None = None,
    rounds: int = 100,
    rate: float = 0.075,
    max_depth: int = 5,
    min_rows: int = 20,
    subsample: float = 1.0,
    patience: int | None = None,
    l2: float = 0.0,
    series: Sequence[str] = (),
    shrink: float = 100.0,
    cut_every: int = 5,
    seed: int = 64,
) -> Boosted:
    """Boost trees on the rows whose ``held`` flag is false; held rows are monitored. The loss is Poisson by default.

    With ``patience`` the rounds stop once the validation RMSE has not improved
    for that many rounds, and the best prefix is kept. ``l2`` is the penalty on
    leaves. With ``series`` the trees are grown on all rows, and every series
    has leaf values of its own, shrunk to the pooled ones (``series_fixes``).
    Row subsamples are drawn by a hash of ``key`` and the round, so they survive
    a recomputed partition. The running score is cut from its lineage every
    ``cut_every`` rounds, and superseded cuts are deleted. Under the squared loss,
    without a subsample, rows with the same features are held as one; ``rows`` may
    come that way (``alike``).
    """
    loss, spark = loss or poisson(), rows.sparkSession
    columns = ["features", F.col(label).cast("double").alias("y"), "held", *series]
    if as_one := loss.square and subsample >= 1.0:
        held_as_one = {"y", "n", "ss"} <= set(rows.columns)
        work = rows.select("features", "held", *series, "y", "n", "ss") if held_as_one else alike(rows.select(*columns))
        many, ss = F.col("n"), F.col("ss")
    else:
        work = rows.select(*columns, F.xxhash64(*key).alias("row_hash"))
        many, ss = F.lit(1), F.lit(0.0)
    work = spread(materialize(work, "boost"))
    y = F.col("y")
    known = F.sum(F.when(y.isNotNull(), many))
    total, mean = work.where(~F.col("held")).agg(F.sum(many), F.sum(y * many) / known).first()
    base = loss.start(mean)
    # a row may stand for many, so the least size of a leaf is a weight there; two leaves of it need twice as many rows
    size = {"minInstancesPerNode": min_rows, "maxDepth": max_depth}
    if as_one:
        deep = max_depth if (total or 0) >= 2 * min_rows else 0
        size = {"minWeightFractionPerNode": max(0.0, (min_rows - 0.5) / total) if deep else 0.0, "maxDepth": deep}
    trees, history, tables = [], [], []
    work = work.withColumn("eta", F.lit(base))
    learner = DecisionTreeRegressor(
        featuresCol="features",
        labelCol="step",
        weightCol="h",
        predictionCol="pred",
        leafCol="leaf" if l2 or series else "",
        maxBins=max(32, max_arity(work)),
        seed=seed,
        cacheNodeIds=False,
        **size,
    )
    best, best_round, previous, written = math.inf, 0, None, None
    eta, held = F.col("eta"), F.col("held")
    step_label, g, h = loss.gradient(y, eta) / loss.weight(y, eta), loss.gradient(y, eta) * many, loss.weight(y, eta) * many
    for i in range(rounds):
        grown = ~held
        if subsample < 1.0:
            draw = F.pmod(F.xxhash64("row_hash", F.lit(seed + i)), F.lit(1_000_000))
            grown = grown & (draw < int(subsample * 1_000_000))
        tree = learner.fit(work.where(grown).select("features", step_label.alias("step"), h.alias("h")))
        trees.append(tree)
        scored, step = tree.transform(work), F.col("pred")
        if l2:
            values = F.array(*[F.lit(v) for v in leaf_values(spark, tree, l2)])
            step = F.element_at(values, F.col("leaf").cast("int") + 1)
        if series:
            table = materialize(series_fixes(scored, grown, g, h, step, series, shrink), "fixes")
            tables.append(table.withColumn("tree", F.lit(i)))
            scored = scored.join(table, list(series), "left")
            step = step + F.coalesce(F.try_element_at("deltas", F.col("leaf").cast("int")), F.lit(0.0))
        scored = scored.withColumn("eta", eta + F.lit(rate) * step).select(*work.columns)
        # sums of both parts in the pass that writes or keeps the new score
        error = F.pow(y - loss.expected(eta), F.lit(2.0)) * many + ss
        sums = [
            F.sum(F.when(part, value)).alias(f"{name}_{what}")
            for name, part in (("train", ~held), ("valid", held))
            for what, value in (("n", many), ("rmse", error), ("nll", loss.row_loss(y, eta) * many + ss))
        ]
        if (i + 1) % cut_every == 0:
            seen, cut = Observation(), shared_path(spark, "boost")
            scored.observe(seen, *sums).write.parquet(cut)
            found, scored = seen.get, spark.read.schema(scored.schema).parquet(cut)
        else:
            cut, scored = None, scored.persist()
            found = scored.agg(*sums).first().asDict()
        if previous is not None:
            previous.unpersist()
        if cut:
            if written is not None:
                remove(spark, written)  # nothing reads the cut before this one any more
            written = cut
        work = previous = scored
        entry = {}
        for part in ("train", "valid"):
            if n := found[f"{part}_n"]:
                entry |= {f"{part}_rmse": math.sqrt(found[f"{part}_rmse"] / n), f"{part}_nll": found[f"{part}_nll"] / n}
        history.append(entry)
        watched = entry.get("valid_rmse")
        if watched is not None and watched < best:
            best, best_round = watched, i + 1
        if patience is not None and watched is not None and i + 1 - best_round >= patience:
            break
    if previous is not None:
        previous.unpersist()
    if written is not None:
        remove(spark, written)
    if patience is not None and best_round:
        trees = trees[:best_round]
    if not trees:
        return Boosted(base, None, loss.name, rate, None, history)
    ensemble, fixes = as_ensemble(spark, trees, rate), None
    if l2:
        ensemble = penalised(spark, ensemble, l2)
    if series:
        every = tables[0]
        for table in tables[1 : len(trees)]:
            every = every.unionByName(table)
        packed = every.groupBy(*series).agg(F.collect_list(F.struct("tree", "deltas")).alias("_fixes"))
        fixes = materialize(packed, "series-fixes")
    return Boosted(base, ensemble, loss.name, rate, fixes, history)


def fit_poisson_glm(train: DataFrame, label: str, reg: float = 1e-6, max_iter: int = 25) -> GeneralizedLinearRegressionModel:
    """Log-linear Poisson baseline on the ``features`` vector; its iterations share one lineage cut."""
    return GeneralizedLinearRegression(
        family="poisson",
        link="log",
        featuresCol="features",
        labelCol=label,
        predictionCol="yhat",
        regParam=reg,
        maxIter=max_iter,
    ).fit(spread(materialize(train.select("features", label), "glm")))
