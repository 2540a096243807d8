import pytest
from pyspark.sql import functions as F

from tidecast.operators import features


@pytest.fixture()
def panel(spark):
    """Series a: days 1-10 without day 4, day 6 unknown; series b: days 1-40."""
    a = [("a", d, None if d == 6 else float(d)) for d in range(1, 11) if d != 4]
    b = [("b", d, float(d * 10)) for d in range(1, 41)]
    return spark.createDataFrame(a + b, "key string, day int, y double").repartition(4)


def values(df, key, col):
    return {r.day: r[col] for r in df.where(F.col("key") == key).collect()}


def test_positional_lag_skips_the_missing_day_and_date_lag_does_not(panel):
    by_row = values(features.add_lags(panel, ["key"], "day", "y", {"lag": 2}), "a", "lag")
    by_day = values(features.add_lags_by_day(panel, ["key"], "day", "y", {"lag": 2}), "a", "lag")
    assert by_row[5] == 2.0 and by_day[5] == 3.0
    assert by_row[7] == 5.0 and by_day[6] is None and by_day[8] is None
    assert by_row[1] is None and by_day[1] is None


def test_date_lag_join_equals_date_lag_window(panel):
    joined = features.lag_by_date_join(panel, ["key"], "day", "y", 2, "lag")
    window = features.add_lags_by_day(panel, ["key"], "day", "y", {"lag": 2})
    assert values(joined, "a", "lag") == values(window, "a", "lag")


def test_full_and_partial_rolling_means(panel):
    spec = {"m": (1, 3)}
    full = values(features.add_rolling_means(panel, ["key"], "day", "y", spec), "a", "m")
    partial = values(features.add_rolling_means_by_day(panel, ["key"], "day", "y", spec), "a", "m")
    assert full[3] is None and full[5] == 2.0
    assert full[8] is None
    assert partial[2] == 1.0 and partial[5] == 2.5 and partial[7] == 5.0
    strict = values(features.add_rolling_means_by_day(panel, ["key"], "day", "y", spec, None), "a", "m")
    assert strict[5] is None and strict[4 + 6] is not None


def test_rolling_mean_of_lagged_series(panel):
    out = values(features.add_rolling_means(panel, ["key"], "day", "y", {"m": (28, 7)}), "b", "m")
    assert out[34] is None
    assert out[35] == pytest.approx(40.0)


def test_leads(panel):
    out = features.add_leads(panel, ["key"], "day", ["y"], [1, 3])
    assert values(out, "b", "L3_y")[37] == 400.0
    assert values(out, "b", "L1_y")[40] is None


def test_update_values_touches_only_named_rows(spark, panel):
    new = spark.createDataFrame([("a", 6, 60.0), ("a", 99, 1.0)], "key string, day int, y double")
    out = values(features.update_values(panel, new, ["key", "day"], "y"), "a", "y")
    assert out[6] == 60.0 and out[5] == 5.0 and len(out) == 9


def test_cumulative_level_and_last_known(spark, panel):
    deltas = spark.createDataFrame(
        [("a", 1, 10.0, 1.0), ("a", 2, 10.0, -3.0), ("a", 3, 10.0, 2.0)], "key string, day int, last double, delta double"
    )
    levels = values(features.cumulate_level(deltas, ["key"], "day", "last", "delta", "level"), "a", "level")
    assert levels == {1: 11.0, 2: 8.0, 3: 10.0}
    last = {r.key: (r.last, r.last_day) for r in features.last_known(panel, ["key"], "day", "y", "last").collect()}
    assert last == {"a": (10.0, 10), "b": (400.0, 40)}


def test_decomposition_adds_up(spark):
    rows = [("a", d, (d - 1) % 7 + 1, float(100 + 5 * ((d - 1) % 7) + d)) for d in range(1, 29)]
    df = spark.createDataFrame(rows, "key string, day int, wday int, y double")
    out = features.decompose(df, ["key"], "day", "wday", "y").orderBy("day").collect()
    assert all(r.season + r.level == pytest.approx(r.y) for r in out)
    assert sum({r.wday: r.season for r in out}.values()) == pytest.approx(0.0, abs=1e-9)
    assert out[0].d_level is None and out[1].d_level == pytest.approx(out[1].level - out[0].level)
    seasons = {r.wday: r.season for r in features.season_levels(df, ["key"], "wday", "y").collect()}
    assert seasons == pytest.approx({r.wday: r.season for r in out})


def test_date_features_keep_the_calendar_weekday(spark):
    df = spark.sql("select date'2016-01-01' as date, 7 as wday")
    row = features.add_date_features(df).first()
    assert (row.wday, row.week, row.quarter, row.mday) == (7, 53, 1, 1)
    assert features.add_date_features(df.drop("wday")).first().wday == 4


def test_features_do_not_depend_on_partitioning(panel):
    one = features.add_rolling_means(panel.coalesce(1), ["key"], "day", "y", {"m": (2, 3)})
    many = features.add_rolling_means(panel.repartition(7, "day"), ["key"], "day", "y", {"m": (2, 3)})
    assert sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, many.collect()), key=str)
