import pytest
from pyspark.sql import functions as F

from tidecast.config import RETAIL_2016, TESTBED
from tidecast.plans.bottom import BottomForecast, build_long
from tidecast.plans.hybrid import HybridForecast
from tidecast.plans.submission import bottom_submission
from tidecast.session import materialize, scratch, shared_dir
from tidecast.sources import tables
from tidecast.sources.binding import BoundTables
from tidecast.sources.bundle import BundleTables, write_bundle


@pytest.fixture()
def bundle(spark, tmp_path):
    """A four-table study of three days in CSV files."""
    files = {
        "sales_train_evaluation.csv": "id,item_id,dept_id,cat_id,store_id,state_id,d_1,d_2,d_3\n"
        "F_1_001_CA_1_evaluation,F_1_001,F_1,F,CA_1,CA,1,0,3\nF_1_002_CA_1_evaluation,F_1_002,F_1,F,CA_1,CA,,5,6\n",
        "calendar.csv": "date,wm_yr_wk,weekday,wday,month,year,d,event_name_1,event_type_1,event_name_2,event_type_2,snap_CA\n"
        + "".join(f"2011-01-{28 + i},{11101 + (i > 2)},x,{i},1,2011,d_{i},,,,,0\n" for i in (1, 2, 3))
        + "2011-02-01,11102,x,4,2,2011,d_4,,,,,1\n",
        "sell_prices.csv": "store_id,item_id,wm_yr_wk,sell_price\nCA_1,F_1_001,11101,2.5\nCA_1,F_1_001,11102,3\nCA_1,F_1_002,11102,9\n",
        "sample_submission.csv": "id,F1,F2\nF_1_001_CA_1_evaluation,0,0\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    return tables.load_tables(spark, str(tmp_path), last_day=3, states=["CA"], horizon=2)


def test_bundle_to_long(bundle):
    assert bundle["calendar"].where("d = 'd_4'").first().day_num == 4
    long = build_long(bundle["sales"], bundle["calendar"], bundle["prices"], 2, 3, horizon=1)
    got = {(r.item_id, r.d): (r.sales, r.sell_price) for r in long.collect()}
    assert got == {
        ("F_1_001", "d_2"): (0.0, 2.5),
        ("F_1_001", "d_3"): (3.0, 3.0),
        ("F_1_001", "d_4"): (None, 3.0),
        ("F_1_002", "d_3"): (6.0, 9.0),
        ("F_1_002", "d_4"): (None, 9.0),
    }


def test_only_the_wanted_day_columns_are_read(bundle):
    long = build_long(bundle["sales"], bundle["calendar"], bundle["prices"], 3, 3)
    plan = long._jdf.queryExecution().executedPlan().toString()
    assert "d_3" in plan and "d_1:double" not in plan


def test_wrong_header_is_an_error(spark, tmp_path):
    (tmp_path / "w.csv").write_text("store_id,wrong,dollar_sales\na,b,1\n")
    with pytest.raises(Exception):
        tables.load_weights(spark, str(tmp_path / "w.csv")).collect()


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "b", 1.25), ("c", "d", None)], "store_id string, dept_id string, dollar_sales double")
    tables.write_csv(df, str(tmp_path / "out"))
    assert sorted(map(tuple, tables.load_weights(spark, str(tmp_path / "out")).collect())) == [("a", "b", 1.25), ("c", "d", None)]


def test_bottom_submission_labels_steps_by_day_and_repeats_ids(spark):
    # x lacks a day inside, a lacks its first one
    rows = [("x_evaluation", 5, 1.0), ("x_evaluation", 7, 2.0), ("a_evaluation", 6, 3.0)]
    df = spark.createDataFrame(rows, "id string, day int, v double")
    out = [tuple(r) for r in bottom_submission(df, "day", "v", 5, 3).collect()]
    assert out == [
        ("a_evaluation", 0.0, 3.0, 0.0),
        ("a_validation", 0.0, 3.0, 0.0),
        ("x_evaluation", 1.0, 0.0, 2.0),
        ("x_validation", 1.0, 0.0, 2.0),
    ]


def test_lineage_cuts(spark):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    assert shared_dir(spark) == shared_dir(spark)
    cut = materialize(df, "t")
    assert cut.agg(F.sum("x")).first()[0] == 90 and "Range" not in cut._jdf.queryExecution().optimizedPlan().toString()


def test_study_parameters():
    assert RETAIL_2016.windows[0] == (RETAIL_2016.train_last - 27, RETAIL_2016.train_last)
    assert TESTBED.weight_first == 2440 and TESTBED.calendar_last_week == 358
    assert str(TESTBED.date_of(TESTBED.forecast_first)) == "2001-10-05"


def test_item_and_hybrid_forecasts_from_files(spark, small_dir, tmp_path):
    """Both forecasts run on files of the published layout, whose frames are those of the tables they were written from."""
    with scratch(spark):
        t = BoundTables(spark, small_dir).compacted("item")
        write_bundle(t, str(tmp_path), 1)
        files = BundleTables(spark, str(tmp_path), t.study, first_day=1)
        one, two = t.priced_sales(2300, carry=True), files.priced_sales(2300, carry=True)
        assert one.count() == two.count() and one.exceptAll(two.select(one.columns)).isEmpty()
        assert t.panel().select("store_id", "dept_id", "day_num", "demand").exceptAll(
            files.panel().select("store_id", "dept_id", "day_num", "demand")
        ).isEmpty()
        bottom = BottomForecast(files, first_day=2050)  # the events of the forecast days occur in it
        fitted = bottom.fit(rounds=2, holdout=500, rate=0.3, max_depth=3, min_rows=20, patience=1)
        out = bottom.submission(bottom.forecast(fitted)).toPandas()
        ids = {f"{r.id}".replace("validation", phase) for r in t.series.collect() for phase in ("validation", "evaluation")}
        assert set(out.id) <= ids and len(out) > 0.9 * len(ids) and (out.drop(columns="id").to_numpy() >= 0).all()
        assert out.drop(columns="id").to_numpy().max() > 0
        # the forecasts of the autoregression, and with them all frames behind it, are the same
        key = ["store_id", "dept_id", "step"]
        ahead = HybridForecast(t).ahead.select(*key, "demand_fcast")
        pairs = ahead.join(HybridForecast(files).ahead.select(*key, F.col("demand_fcast").alias("other")), key).collect()
        assert len(pairs) == ahead.count() > 0
        assert all(r.other == pytest.approx(r.demand_fcast, abs=1e-6) for r in pairs)
