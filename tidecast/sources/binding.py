"""Binds the TPC-H style test tables to the retail schema: items, stores, prices, calendar.

Item labels are computed on the dimension side of the join and store labels
after the aggregation, so no string is built per sale line. No join carries a
broadcast hint: the optimizer broadcasts a dimension while its estimated size
allows it and shuffles both sides beyond that (skewed keys are split by AQE).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.config import TESTBED, Study
from tidecast.functions import scalars as S
from tidecast.operators.reshape import day_range, fill_days, priced_days
from tidecast.session import materialize

SERIES_KEYS = ("item_id", "dept_id", "cat_id", "store_id", "state_id")
DEPT_KEYS = ("store_id", "dept_id")

LINEITEM = "l_partkey bigint, l_suppkey bigint, l_quantity double, l_shipdate timestamp_ntz"
PART = "p_partkey bigint, p_brand string, p_type string, p_retailprice double"
SUPPLIER = "s_suppkey bigint, s_nationkey int"
NATION = "n_nationkey int, n_regionkey int"
REGION = "r_regionkey int, r_name string"


def series_id() -> Column:
    return F.concat_ws("_", "item_id", "store_id", F.lit("validation"))


class BoundTables:
    """Lazy frames over one folder of test tables."""

    def __init__(self, spark: SparkSession, directory: str, study: Study = TESTBED, compact: DataFrame | None = None):
        self.spark = spark
        self.directory = directory.rstrip("/")
        self.study = study
        self._compact = compact

    def compacted(self, level: str = "item") -> BoundTables:
        """The same frames on top of written daily totals per store and item (or department).

        For plans that need a frame several times: the sale lines are scanned,
        joined and aggregated once, and the frames are derived from the totals,
        whose size depends on series and days instead of sale lines. Totals per
        department serve ``daily`` and ``panel`` only.
        """
        if level not in ("item", "dept"):
            raise ValueError("level must be 'item' or 'dept'")
        keys = ["dept_id", "state_id", "outlet", "day_num"]
        totals = [F.sum("units").alias("units")]
        if level == "item":
            keys += ["item_id", "cat_id"]
            totals.append(F.max("p_retailprice").alias("p_retailprice"))
        written = materialize(self.facts().groupBy(*keys).agg(*totals), f"daily-{level}-totals")
        return BoundTables(self.spark, self.directory, self.study, written)

    def _scan(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.directory}/{name}.parquet")

    # ---- facts -------------------------------------------------------------

    @cached_property
    def states(self) -> DataFrame:
        """Nation -> state: as many rows as there are nations, small enough to be broadcast by its estimate."""
        region = self._scan("region", REGION).select(
            "r_regionkey", F.upper(F.substring("r_name", 1, 2)).alias("state_id")
        )
        return (
            self._scan("nation", NATION)
            .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select("n_nationkey", "state_id")
        )

    @cached_property
    def items(self) -> DataFrame:
        """Part -> item, department and category."""
        dept = F.concat(F.col("p_type"), F.lit("_1"))
        return self._scan("part", PART).select(
            "p_partkey",
            F.concat_ws("_", dept, F.lpad(F.expr("substr(p_brand, 7)"), 3, "0")).alias("item_id"),
            dept.alias("dept_id"),
            F.col("p_type").alias("cat_id"),
            "p_retailprice",
        )

    def lines(self) -> DataFrame:
        return self._scan("lineitem", LINEITEM)

    def facts(self, first: int | None = None, last: int | None = None) -> DataFrame:
        """One row per sale line; a day range is applied to the raw timestamp so it reaches the scan.

        After ``compacted()`` one row per daily total.
        """
        if self._compact is not None:
            rows = self._compact
            rows = rows if first is None else rows.where(F.col("day_num") >= first)
            return rows if last is None else rows.where(F.col("day_num") <= last)
        lines = self.lines()
        shipped = F.col("l_shipdate")
        if first is not None:
            lines = lines.where(shipped >= F.lit(f"{self.study.date_of(first)}").cast("timestamp_ntz"))
        if last is not None:
            lines = lines.where(shipped < F.lit(f"{self.study.date_of(last + 1)}").cast("timestamp_ntz"))
        return (
            lines.join(self.items, F.col("l_partkey") == F.col("p_partkey"))
            .join(self._scan("supplier", SUPPLIER), F.col("l_suppkey") == F.col("s_suppkey"))
            .join(self.states, F.col("s_nationkey") == F.col("n_nationkey"))
            .select(
                "item_id",
                "dept_id",
                "cat_id",
                "state_id",
                (F.col("l_suppkey") % 2 + 1).alias("outlet"),
                F.col("l_quantity").alias("units"),
                "p_retailprice",
                (F.datediff(F.col("l_shipdate").cast("date"), F.lit(self.study.first_date)) + 1).alias("day_num"),
            )
        )

    def rollup(self, facts: DataFrame, keys: tuple[str, ...], *aggregates) -> DataFrame:
        """Aggregate facts by ``keys``; the store label is put together after the aggregation, not per line."""
        raw = [r for k in keys for r in (("state_id", "outlet") if k == "store_id" else (k,))]
        raw = list(dict.fromkeys(raw))
        store = F.concat_ws("_", "state_id", F.col("outlet").cast("string"))
        grouped = facts.groupBy(*raw).agg(*aggregates)
        extra = [c for c in grouped.columns if c not in raw]
        return grouped.withColumn("store_id", store).select(*keys, *extra)

    def date_of(self, day_num) -> Column:
        return F.date_add(F.lit(self.study.first_date), day_num - 1)

    def week_of(self, day_num) -> Column:
        offset = (self.study.first_date - self.study.week_anchor).days
        return F.floor((day_num - 1 + offset) / 7).cast("int") + 1

    def cells(self, first: int | None = None, last: int | None = None) -> DataFrame:
        """Observed units per item, store and day."""
        summed = self.rollup(self.facts(first, last), (*SERIES_KEYS, "day_num"), F.sum("units").alias("sales"))
        return summed.select(series_id().alias("id"), *SERIES_KEYS, "day_num", "sales")

    def sales(self, first: int = 1, last: int | None = None) -> DataFrame:
        """Daily sales of every series over ``[first, last]``, zero where nothing sold.

        Sales outside the range collapse into one marker day per side before
        the shuffle; they only prove that the series exists.
        """
        last = self.study.train_last if last is None else last
        day = F.greatest(F.least(F.col("day_num"), F.lit(last + 1)), F.lit(first - 1))
        facts = self.facts().withColumn("day_num", day)
        cells = self.rollup(facts, (*SERIES_KEYS, "day_num"), F.sum("units").alias("sales"))
        dense = fill_days(cells, SERIES_KEYS, "day_num", "sales", first, last)
        return dense.select(
            series_id().alias("id"),
            *SERIES_KEYS,
            S.day_label(F.col("day_num")).alias("d"),
            "day_num",
            self.date_of(F.col("day_num")).alias("date"),
            "sales",
        )

    def daily(self, last: int | None = None) -> DataFrame:
        """Observed demand of every store, department and day."""
        units = F.coalesce(F.sum("units"), F.lit(0.0)).alias("demand")
        return self.rollup(self.facts(None, last), (*DEPT_KEYS, "day_num"), units)

    def panel(self, first: int = 1, last: int | None = None) -> DataFrame:
        """Daily demand of every store and department, zero where nothing sold."""
        last = self.study.train_last if last is None else last
        day = F.greatest(F.least(F.col("day_num"), F.lit(last + 1)), F.lit(first - 1))
        units = F.coalesce(F.sum("units"), F.lit(0.0)).alias("demand")
        cells = self.rollup(self.facts().withColumn("day_num", day), (*DEPT_KEYS, "day_num"), units)
        dense = fill_days(cells, DEPT_KEYS, "day_num", "demand", first, last)
        return dense.select(*DEPT_KEYS, "day_num", self.date_of(F.col("day_num")).alias("date"), "demand")

    @cached_property
    def series(self) -> DataFrame:
        """Every series with its first sale day and list price."""
        return self.rollup(
            self.facts(),
            SERIES_KEYS,
            F.min("day_num").alias("first_day"),
            F.max("p_retailprice").alias("list_price"),
        ).select(series_id().alias("id"), *SERIES_KEYS, "first_day", "list_price")

    def submission_ids(self) -> DataFrame:
        """Every series once per phase."""
        phase = F.explode(F.array(F.lit("validation"), F.lit("evaluation"))).alias("phase")
        return self.series.select("item_id", "dept_id", "store_id", "state_id", phase).select(
            F.concat_ws("_", "item_id", "store_id", "phase").alias("id"), "item_id", "dept_id", "store_id", "state_id"
        )

    # ---- dimensions --------------------------------------------------------

    @cached_property
    def calendar(self) -> DataFrame:
        """One row per day of the study: its size is ``calendar_days``, so it may be broadcast."""
        s = self.study
        day = F.col("day_num")
        base = self.spark.range(1).select(day_range(1, s.calendar_days).alias("day_num"))
        base = base.withColumn("date", self.date_of(day))
        month, mday = F.month("date"), F.dayofmonth("date")
        md = F.date_format("date", "MM-dd")
        sunday = F.dayofweek("date") == 1
        event = (
            F.when(md == "12-25", F.array(F.lit("Christmas"), F.lit("National")))
            .when(md == "07-04", F.array(F.lit("IndependenceDay"), F.lit("National")))
            .when(md == "02-14", F.array(F.lit("ValentinesDay"), F.lit("Cultural")))
            .when(md == "10-31", F.array(F.lit("Halloween"), F.lit("Cultural")))
            .when(md == "01-07", F.array(F.lit("OrthodoxChristmas"), F.lit("Religious")))
            .when((month == 2) & (mday <= 7) & sunday, F.array(F.lit("SuperBowl"), F.lit("Sporting")))
        )
        second = F.when((md == "02-14") & sunday, F.array(F.lit("SundayEvent"), F.lit("Cultural")))
        offset = (s.first_date - s.week_anchor).days
        early = (mday <= 10).cast("int")
        odd = ((mday <= 15) & (mday % 2 == 1)).cast("int")
        return base.select(
            "date",
            self.week_of(day).alias("wm_yr_wk"),
            F.date_format("date", "EEEE").alias("weekday"),
            ((day - 1 + offset) % 7 + 1).cast("int").alias("wday"),
            month.alias("month"),
            F.year("date").alias("year"),
            S.day_label(day).alias("d"),
            "day_num",
            event.getItem(0).alias("event_name_1"),
            event.getItem(1).alias("event_type_1"),
            second.getItem(0).alias("event_name_2"),
            second.getItem(1).alias("event_type_2"),
            early.alias("snap_AF"),
            odd.alias("snap_AM"),
            early.alias("snap_AS"),
            mday.between(2, 11).cast("int").alias("snap_EU"),
            odd.alias("snap_MI"),
        )

    @cached_property
    def weeks(self) -> DataFrame:
        """First and last day of every week."""
        return self.calendar.groupBy("wm_yr_wk").agg(F.min("day_num").alias("_from"), F.max("day_num").alias("_to"))

    def priced_sales(self, first: int = 1, last: int | None = None, carry: bool = False) -> DataFrame:
        """Daily sales and price of every series on the days it has one; ``carry`` adds the id and the other series keys."""
        last = self.study.train_last if last is None else last
        prices = self.prices
        if carry:
            prices = prices.join(self.series.select("id", *SERIES_KEYS), ["store_id", "item_id"])
        cells = self.cells(first, last)
        return priced_days(cells, prices, self.weeks, ["store_id", "item_id"], "day_num", "sales", "sell_price", first, last)

    def snap(self, store_id) -> Column:
        return S.snap_flag(store_id, {s: F.col(f"snap_{s}") for s in self.study.states})

    def panel_calendar(self, first: int = 1, last: int | None = None) -> DataFrame:
        """Panel rows with their calendar columns."""
        return self.panel(first, last).join(F.broadcast(self.calendar.drop("date")), "day_num", "left")

    @cached_property
    def prices(self) -> DataFrame:
        """Weekly prices from the first sale week on, with gaps for some items."""
        last_week = self.study.calendar_last_week
        week = F.col("wm_yr_wk")
        weekly = self.series.select(
            "store_id",
            "item_id",
            "list_price",
            F.explode(F.sequence(self.week_of(F.col("first_day")), F.lit(last_week))).alias("wm_yr_wk"),
        )
        number = F.element_at(F.split("item_id", "_"), -1).cast("int")
        return weekly.where(~((number % 10 == 0) & (week % 13 == 0))).select(
            "store_id", "item_id", "wm_yr_wk", (F.col("list_price") * (1 + week % 4 * 0.05)).alias("sell_price")
        )
