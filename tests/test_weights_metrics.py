import pytest
from pyspark.sql import functions as F

from tidecast.operators import metrics, weights

KEYS = ["store_id", "dept_id", "item_id"]


@pytest.fixture()
def tables(spark):
    calendar = spark.createDataFrame([(d, (d - 1) // 7) for d in range(1, 15)], "day_num int, wm_yr_wk int")
    series = [("s", "d", "i1", 2.0), ("s", "d", "i2", 1.0), ("s", "d", "gap", 5.0), ("s", "z", "i3", 0.0)]
    sales = spark.createDataFrame(
        [(s, d, i, day, u) for s, d, i, u in series for day in range(1, 15)],
        "store_id string, dept_id string, item_id string, day_num int, sales double",
    )
    prices = spark.createDataFrame(
        [("s", i, w, 3.0) for i in ("i1", "i2", "gap", "i3") for w in (0, 1) if not (i == "gap" and w == 0)],
        "store_id string, item_id string, wm_yr_wk int, sell_price double",
    )
    return sales, calendar, prices


def test_an_item_without_a_price_on_any_day_disappears(tables):
    out = weights.trailing_dollar_sales(*tables, 5, 10, KEYS)
    assert {r.item_id: r.dollar_sales for r in out.collect()} == {"i1": 36.0, "i2": 18.0, "i3": 0.0}
    late = weights.trailing_dollar_sales(*tables, 8, 10, KEYS)
    assert "gap" in {r.item_id for r in late.collect()}


def test_shares_total_one_and_an_empty_group_has_none(tables):
    out = weights.dollar_share_weights(*tables, 5, 10, KEYS)
    got = {r.item_id: r.weight for r in out.collect()}
    assert got == {"i1": pytest.approx(2 / 3), "i2": pytest.approx(1 / 3), "i3": None}
    totals = {r.dept_id: r.sum_weight for r in weights.check_totals(out.select(*KEYS[:2], "weight"), KEYS[:2]).collect()}
    assert totals == {"d": pytest.approx(1.0), "z": None}


def test_disaggregated_items_sum_to_the_department(spark, tables):
    share = weights.dollar_share_weights(*tables, 5, 10, KEYS)
    forecast = spark.createDataFrame(
        [("s", "d", day, 10.0 * day) for day in (1, 2)], "store_id string, dept_id string, day_num int, demand_fcast double"
    )
    ids = share.select("store_id", "dept_id", "item_id", F.col("item_id").alias("id"))
    out = weights.disaggregate(ids, share, forecast).where(F.col("dept_id") == "d")
    sums = {r.day_num: r.s for r in out.groupBy("day_num").agg(F.sum("demand_submission").alias("s")).collect()}
    assert sums == {1: pytest.approx(10.0), 2: pytest.approx(20.0)}


def test_row_sum_skips_nulls(spark):
    df = spark.createDataFrame([(1.0, None, 9.0), (None, None, 9.0)], "u_1 double, u_2 double, x double")
    assert [r.t for r in weights.row_sum(df, "u_", "t").collect()] == [1.0, 0.0]


def test_rmse_and_unnormalised_weighted_rmse(spark):
    rows = [(1, "s", "d", 1.0, 4.0), (1, "s", "d", 5.0, 1.0), (1, "s", "e", 2.0, 2.0), (2, "s", "d", 0.0, 2.0)]
    df = spark.createDataFrame(rows, "win int, store_id string, dept_id string, y double, yhat double")
    per = {(r.win, r.dept_id): r.rmse for r in metrics.rmse_by(df, ["win", "dept_id"], "y", "yhat").collect()}
    assert per[1, "d"] == pytest.approx(12.5**0.5) and per[1, "e"] == 0.0 and per[2, "d"] == 2.0
    w = spark.createDataFrame([("s", "d", 0.5), ("s", "e", 3.0)], "store_id string, dept_id string, dollar_sales double")
    out = {r.win: r.wrmse for r in metrics.wrmse_by(df, "win", KEYS[:2], w, "y", "yhat").collect()}
    assert out == {1: pytest.approx(0.5 * 12.5**0.5), 2: pytest.approx(1.0)}
    both = metrics.rmse_models(df, ["win"], "y", {"a": "yhat", "b": "y"}).where("win = 2").first()
    assert (both.a, both.b) == (2.0, 0.0)
