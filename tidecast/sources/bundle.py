"""A study on one's own CSV files: the same frames as ``BoundTables``, read from the published file layout."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.config import Study
from tidecast.functions import scalars as S
from tidecast.sources.binding import DEPT_KEYS, SERIES_KEYS, BoundTables
from tidecast.sources.tables import load_tables, write_csv


class BundleTables(BoundTables):
    """Frames over a folder of ``calendar.csv``, ``sell_prices.csv``, ``sample_submission.csv`` and a wide sales file.

    Every forecast that takes ``BoundTables`` takes these. Sales are known for the days ``first_day`` to ``last_day`` of
    the file; a range that goes beyond them holds those days only.
    """

    def __init__(
        self,
        spark: SparkSession,
        directory: str,
        study: Study,
        sales_file: str = "sales_train_validation.csv",
        first_day: int = 1,
        last_day: int | None = None,
    ):
        super().__init__(spark, directory, study)
        self.first_day, self.last_day = first_day, last_day or study.train_last
        self.tables = load_tables(
            spark,
            directory,
            first_day=first_day,
            last_day=self.last_day,
            states=study.states,
            horizon=study.horizon,
            sales_file=sales_file,
        )

    def compacted(self, level: str = "item") -> BundleTables:
        """The files hold daily totals already."""
        return self

    def sales(self, first: int = 1, last: int | None = None) -> DataFrame:
        """Daily sales of every series; only the columns of the range are read."""
        last = self.study.train_last if last is None else last
        a, b = max(first, self.first_day), min(last, self.last_day)
        days = F.array(*[F.col(f"d_{n}") for n in range(a, b + 1)]).cast("array<double>")
        long = self.tables["sales"].select("id", *SERIES_KEYS, F.posexplode(days).alias("_at", "sales"))
        day = F.col("_at") + a
        return long.select(
            "id", *SERIES_KEYS, S.day_label(day).alias("d"), day.alias("day_num"), self.date_of(day).alias("date"), "sales"
        )

    def cells(self, first: int | None = None, last: int | None = None) -> DataFrame:
        rows = self.sales(first or self.first_day, last or self.last_day).where("sales > 0")
        return rows.select("id", *SERIES_KEYS, "day_num", "sales")

    def daily(self, last: int | None = None) -> DataFrame:
        return self.panel(self.first_day, last or self.last_day).select(*DEPT_KEYS, "day_num", "demand")

    def panel(self, first: int = 1, last: int | None = None) -> DataFrame:
        summed = self.sales(first, last).groupBy(*DEPT_KEYS, "day_num").agg(F.sum("sales").alias("demand"))
        return summed.select(*DEPT_KEYS, "day_num", self.date_of(F.col("day_num")).alias("date"), "demand")

    @cached_property
    def series(self) -> DataFrame:
        return self.tables["sales"].select("id", *SERIES_KEYS)

    @cached_property
    def items(self) -> DataFrame:
        return self.series.select("item_id", "dept_id", "cat_id").distinct()

    @cached_property
    def calendar(self) -> DataFrame:
        """One row per day, so it may be broadcast; its days past the study are left out."""
        return self.tables["calendar"].where(F.col("day_num") <= self.study.calendar_days)

    @cached_property
    def prices(self) -> DataFrame:
        return self.tables["prices"]

    def submission_ids(self) -> DataFrame:
        """The ids that the sample submission asks for."""
        parts = S.series_id_parts(F.col("id"))
        wanted = ("item_id", "dept_id", "store_id", "state_id")
        return self.tables["submission"].select("id", *[parts[c].alias(c) for c in wanted])


def write_bundle(t: BoundTables, directory: str, first_day: int, sales_file: str = "sales_train_validation.csv") -> None:
    """Write the frames of ``t`` in the file layout, sales from ``first_day`` to the last training day."""
    last, study = t.study.train_last, t.study
    names = [f"d_{n}" for n in range(first_day, last + 1)]
    wide = t.sales(first_day, last).groupBy("id", *SERIES_KEYS).pivot("d", names).agg(F.first("sales"))
    write_csv(wide, f"{directory}/{sales_file}")
    write_csv(t.calendar.drop("day_num"), f"{directory}/calendar.csv")
    write_csv(t.prices, f"{directory}/sell_prices.csv")
    zeros = [F.lit(0.0).alias(f"F{i}") for i in range(1, study.horizon + 1)]
    write_csv(t.submission_ids().select("id", *zeros), f"{directory}/sample_submission.csv")
