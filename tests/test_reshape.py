import pytest
from pyspark.sql import functions as F

from tidecast.operators import features, reshape


def test_melt_keeps_null_cells(spark):
    wide = spark.createDataFrame([("x", 1.0, None), ("y", 3.0, 4.0)], "id string, d_1 double, d_2 double")
    rows = {(r.id, r.d): r.sales for r in reshape.melt_days(wide, ["id"]).collect()}
    assert rows == {("x", "d_1"): 1.0, ("x", "d_2"): None, ("y", "d_1"): 3.0, ("y", "d_2"): 4.0}


def test_pivot_orders_by_step_and_rejects_duplicates(spark):
    rows = [("x", f"F{i}", float(i)) for i in (10, 2, 1)]
    df = spark.createDataFrame(rows, "id string, step string, v double")
    steps = [f"F{i}" for i in range(1, 11)]
    wide = reshape.pivot_horizon(df, ["id"], "step", "v", steps)
    assert wide.columns == ["id", *steps]
    assert wide.first()[1:] == (1.0, 2.0, *[None] * 7, 10.0)
    twice = df.union(spark.createDataFrame([("x", "F2", 5.0)], df.schema))
    with pytest.raises(Exception, match="duplicate"):
        reshape.pivot_horizon(twice, ["id"], "step", "v", steps).collect()


def test_scaffold_holds_pairs_never_seen_together(spark):
    df = spark.createDataFrame([("s1", "d1"), ("s2", "d2"), ("s2", "d2")], "store string, dept string")
    out = reshape.scaffold(df, "store", "dept", "day", 5, 7)
    assert out.count() == 12
    assert out.where((F.col("store") == "s1") & (F.col("dept") == "d2")).count() == 3
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_key_product_of_large_dimensions(spark):
    df = spark.range(300).select(F.concat(F.lit("s"), "id").alias("store"), F.concat(F.lit("d"), F.col("id") % 200).alias("dept"))
    df = df.union(spark.createDataFrame([(None, "d0"), ("s0", None)], "store string, dept string"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        pairs = reshape.key_product(df, "store", "dept", buckets=7)
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
        assert pairs.count() == pairs.distinct().count() == 300 * 200
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def priced_frames(spark):
    cells = [("s", "i", 2, 5.0), ("s", "i", 9, 1.0), ("s", "i", 16, 2.0), ("s", "j", 30, 4.0), ("t", "i", 8, 7.0), ("t", "k", 9, 1.0), ("s", "i", 40, 9.0)]
    prices = [("s", "i", w, 1.0 + w, "x") for w in (1, 2, 4)] + [("t", "i", 2, 9.0, "y"), ("s", "j", 1, 3.0, None), ("t", "z", 3, 1.0, "z")]
    weeks = [(w, 7 * w - 6, 7 * w) for w in range(1, 6)]
    return (
        (cells, spark.createDataFrame(cells, "store string, item string, day int, sales double")),
        (prices, spark.createDataFrame(prices, "store string, item string, week int, price double, note string")),
        (weeks, spark.createDataFrame(weeks, "week int, _from int, _to int")),
    )


@pytest.mark.parametrize(("first", "last"), [(1, 35), (3, 25), (9, 9), (20, 21)])
def test_priced_days_equal_a_dense_join(spark, first, last):
    (cells, sold), (prices, priced), (_, weeks) = priced_frames(spark)
    out = reshape.priced_days(sold, priced, weeks, ["store", "item"], "day", "sales", "price", first, last)
    assert out.columns == ["store", "item", "price", "note", "day", "sales"]
    units = {(a, b, d): v for a, b, d, v in cells}
    want = [
        (a, b, p, note, d, units.get((a, b, d), 0.0)) for a, b, w, p, note in prices for d in range(7 * w - 6, 7 * w + 1) if first <= d <= last
    ]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in out.collect())


def test_daily_rows_are_never_moved(spark):
    """Sparse rows are exchanged once; windows over the daily rows of a series need no exchange of their own."""
    (_, sold), (_, priced), (_, weeks) = priced_frames(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        daily = reshape.priced_days(sold, priced, weeks, ["store", "item"], "day", "sales", "price", 1, 35)
        lagged = features.add_rolling_means(daily, ["store", "item"], "day", "sales", {"m": (7, 7)})
        plan = lagged._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
        assert plan.index("Generate") < plan.index("Exchange hashpartitioning")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_fill_days_covers_the_range(spark):
    rows = [("a", 0, 9.0), ("a", 3, 3.0), ("a", 5, None), ("b", 9, 1.0), ("c", -2, 7.0)]
    df = spark.createDataFrame(rows, "k string, day int, y double")
    out = {(r.k, r.day): r.y for r in reshape.fill_days(df, ["k"], "day", "y", 1, 6).collect()}
    assert len(out) == 18
    assert {d: out["a", d] for d in range(1, 7)} == {1: 0.0, 2: 0.0, 3: 3.0, 4: 0.0, 5: 0.0, 6: 0.0}
    assert all(out[k, d] == 0.0 for k in "bc" for d in range(1, 7))


def test_horizon_index(spark):
    df = spark.createDataFrame([("a", 10)], "k string, origin int")
    out = reshape.horizon_index(df, "origin", 28, ["k"]).collect()
    assert [(r.step, r.day_num) for r in sorted(out, key=lambda r: r.step)][::27] == [(1, 11), (28, 38)]


def test_matrix_round_trip(spark):
    rows = [("s", d, k, float(d)) for d in (1, 2) for k in ("X_1", "Y_1")]
    df = spark.createDataFrame(rows, "store string, day int, dept string, v double")
    wide = reshape.series_matrix(df, ["store", "day"], "dept", "v", ["X_1", "Y_1"])
    named = wide.toDF("store", "day", "d_X_1_f", "d_Y_1_f")
    long = reshape.matrix_to_long(named, ["store", "day"], "dept", "v", prefix="d_", suffix="_f")
    assert sorted(map(tuple, long.select(*df.columns).collect())) == sorted(rows)
