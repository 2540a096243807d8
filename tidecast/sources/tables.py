"""Readers and writers with declared schemas. No pipeline infers a schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.functions.scalars import day_ordinal

SALES_KEYS = ("id", "item_id", "dept_id", "cat_id", "store_id", "state_id")


def sales_schema(first_day: int, last_day: int) -> str:
    """Wide sales matrix: id columns and one column per day."""
    ids = [f"{c} string" for c in SALES_KEYS]
    return ", ".join(ids + [f"d_{n} double" for n in range(first_day, last_day + 1)])


def calendar_schema(states: Sequence[str]) -> str:
    fixed = (
        "date date, wm_yr_wk int, weekday string, wday int, month int, year int, d string, "
        "event_name_1 string, event_type_1 string, event_name_2 string, event_type_2 string"
    )
    return fixed + "".join(f", snap_{s} int" for s in states)


PRICE_SCHEMA = "store_id string, item_id string, wm_yr_wk int, sell_price double"
WEIGHT_SCHEMA = "store_id string, dept_id string, dollar_sales double"


def submission_schema(horizon: int) -> str:
    return ", ".join(["id string", *[f"F{i} double" for i in range(1, horizon + 1)]])


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """CSV scan with a header and a declared schema; a header that disagrees with it is an error."""
    return spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def load_tables(
    spark: SparkSession,
    directory: str,
    *,
    first_day: int = 1,
    last_day: int,
    states: Sequence[str],
    horizon: int = 28,
    sales_file: str = "sales_train_evaluation.csv",
) -> dict[str, DataFrame]:
    """The table bundle of a study laid out as CSV files in one folder."""
    root = directory.rstrip("/")
    calendar = read_csv(spark, f"{root}/calendar.csv", calendar_schema(states))
    return {
        "sales": read_csv(spark, f"{root}/{sales_file}", sales_schema(first_day, last_day)),
        "calendar": calendar.withColumn("day_num", day_ordinal(F.col("d"))),
        "prices": read_csv(spark, f"{root}/sell_prices.csv", PRICE_SCHEMA),
        "submission": read_csv(spark, f"{root}/sample_submission.csv", submission_schema(horizon)),
    }


def load_weights(spark: SparkSession, path: str) -> DataFrame:
    """The (store, department) dollar weights used for scoring."""
    return read_csv(spark, path, WEIGHT_SCHEMA)
