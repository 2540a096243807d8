"""Registered queries of the relational core: scans, projections, reshaping, joins, aggregates, windows, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.functions import scalars as S
from tidecast.operators import encode, features, metrics, reshape, split, weights
from tidecast.plans import submission
from tidecast.plans.registry import IN_WINDOWS, query, window_case
from tidecast.session import materialize, shared_path
from tidecast.sources import tables
from tidecast.sources.binding import DEPT_KEYS, SERIES_KEYS, BoundTables
from tidecast.sources.bundle import BundleTables, write_bundle
from tidecast.sources.clustered import ClusteredFact

KEYS = list(DEPT_KEYS)
IDS = ["id", *SERIES_KEYS]
EVENT_COLUMNS = ("event_name_1", "event_type_1", "event_name_2", "event_type_2")


def r6(col, name: str | None = None):
    out = F.round(F.col(col) if isinstance(col, str) else col, 6)
    return out.alias(name or col) if (name or isinstance(col, str)) else out


# ---- scans and sinks ---------------------------------------------------------


@query(
    "scan_sales_long",
    "SELECT id, item_id, dept_id, cat_id, store_id, state_id, day_num, units AS sales FROM cells",
    ["cells"],
)
def scan_sales_long(t: BoundTables) -> DataFrame:
    return t.cells()


@query(
    "scan_day_range",
    "SELECT id, day_num, units AS sales FROM cells WHERE day_num BETWEEN 2411 AND 2468",
    ["cells"],
)
def scan_day_range(t: BoundTables) -> DataFrame:
    s = t.study
    return t.cells(max(1, s.train_last - s.max_lag), s.train_last).select("id", "day_num", "sales")


def clustered_cells(t: BoundTables, buckets: int = 8) -> ClusteredFact:
    cells = t.cells().withColumn("date", t.date_of(F.col("day_num")))
    return ClusteredFact.write(cells.select("store_id", "item_id", "date", "sales"), ["store_id", "item_id"], "date", buckets)


def trailing_sales(fact: ClusteredFact, first, last) -> DataFrame:
    """Sales of each series' current and two earlier selling days, for the days of a range."""
    w = features.series_window(["store_id", "item_id"], "date").rowsBetween(-2, 0)
    rows = fact.range(first, last)
    return rows.select("store_id", "item_id", "date", "sales", F.sum("sales").over(w).alias("trailing"))


@query(
    "scan_clustered_range",
    """SELECT store_id, item_id, CAST(DATE '1995-01-01' + day_num AS DATE) AS date, units AS sales,
  sum(units) OVER (PARTITION BY store_id, item_id ORDER BY day_num ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS trailing
FROM cells WHERE day_num BETWEEN 2411 AND 2468""",
    ["cells"],
)
def scan_clustered_range(t: BoundTables) -> DataFrame:
    """A window over a day range of the fact clustered by series; the table is dropped before the rows are handed over."""
    s = t.study
    fact = clustered_cells(t)
    try:
        return materialize(trailing_sales(fact, s.date_of(s.train_last - s.max_lag), s.date_of(s.train_last)), "trailing")
    finally:
        fact.drop()


@query(
    "scan_limit",
    "SELECT id, first_day, list_price FROM series ORDER BY id LIMIT 100",
    ["series"],
)
def scan_limit(t: BoundTables) -> DataFrame:
    return t.series.select("id", "first_day", "list_price").orderBy("id").limit(100)


@query(
    "sink_csv_roundtrip",
    "SELECT store_id, dept_id, day_num, demand FROM daily",
    ["daily"],
)
def sink_csv_roundtrip(t: BoundTables) -> DataFrame:
    daily = t.daily()
    path = shared_path(t.spark, "daily-csv")
    tables.write_csv(daily, path)
    return tables.read_csv(t.spark, path, daily.schema)


# ---- projections, filters, predicates ----------------------------------------


@query(
    "feature_columns",
    """SELECT store_id, dept_id, wday, month, event_name_1, event_type_1, event_name_2, event_type_2,
  snap_AF, snap_AM, snap_AS, snap_EU, snap_MI FROM panel_cal""",
    ["panel_cal"],
)
def feature_columns(t: BoundTables) -> DataFrame:
    unused = {"day_num", "date", "demand", "d", "wm_yr_wk", "weekday", "year"}
    df = t.panel_calendar()
    return df.select([c for c in df.columns if c not in unused])


@query(
    "rowwise_dollar_sales",
    """SELECT s.id, round(sum(s.sales * p.sell_price), 6) AS dollar_sales
FROM sales s JOIN calendar c ON c.day_num = s.day_num
JOIN prices p ON p.store_id = s.store_id AND p.item_id = s.item_id AND p.wm_yr_wk = c.wm_yr_wk
WHERE s.day_num BETWEEN 2440 AND 2468 GROUP BY s.id""",
    ["sales", "calendar", "prices"],
    compact="item",
)
def rowwise_dollar_sales(t: BoundTables) -> DataFrame:
    """Dollar columns per day side by side, summed across the row."""
    s = t.study
    days = range(s.weight_first, s.train_last + 1)
    dollars = (
        t.sales(s.weight_first)
        .join(F.broadcast(t.calendar.select("day_num", "wm_yr_wk")), "day_num")
        .join(t.prices, ["store_id", "item_id", "wm_yr_wk"])
        .select("id", "day_num", (F.col("sell_price") * F.col("sales")).alias("dollars"))
    )
    wide = dollars.groupBy("id").pivot("day_num", list(days)).agg(F.first("dollars"))
    wide = wide.toDF("id", *[f"dollars_{d}" for d in days])
    return weights.row_sum(wide, "dollars", "dollar_sales").select("id", r6("dollar_sales"))


@query(
    "parse_day_ordinal",
    """SELECT 'd_' || day_num AS d, day_num, count(*) AS lines FROM base GROUP BY ALL""",
    ["base"],
)
def parse_day_ordinal(t: BoundTables) -> DataFrame:
    labelled = t.facts().groupBy(S.day_label(F.col("day_num")).alias("d")).agg(F.count(F.lit(1)).alias("lines"))
    return labelled.select("d", S.day_ordinal(F.col("d")).alias("day_num"), "lines")


@query(
    "filter_day_range",
    "SELECT store_id, dept_id, day_num, demand FROM panel_all WHERE day_num BETWEEN 2469 AND 2496",
    ["panel_all"],
)
def filter_day_range(t: BoundTables) -> DataFrame:
    s = t.study
    return t.panel(s.forecast_first, s.forecast_last).select(*KEYS, "day_num", "demand")


@query(
    "filter_date_range",
    """SELECT store_id, dept_id, date, demand,
  CASE WHEN date <= DATE '2001-10-04' THEN 'train' ELSE 'test' END AS part
FROM panel_all WHERE date BETWEEN DATE '1995-01-03' AND DATE '2001-11-01'""",
    ["panel_all"],
)
def filter_date_range(t: BoundTables) -> DataFrame:
    s = t.study
    train_end = F.lit(s.date_of(s.train_last))
    both = t.panel(1, s.calendar_days).where(
        F.col("date").between(F.lit(s.date_of(2)), F.lit(s.date_of(s.forecast_last)))
    )
    part = F.when(F.col("date") <= train_end, "train").otherwise("test")
    return both.select(*KEYS, "date", "demand", part.alias("part"))


@query(
    "split_blocked_windows",
    f"""SELECT store_id, dept_id, day_num, demand, {window_case('day_num')} AS valid_window,
  CASE WHEN {IN_WINDOWS('day_num')} THEN 'valid' ELSE 'train' END AS part FROM panel""",
    ["panel"],
)
def split_blocked_windows(t: BoundTables) -> DataFrame:
    train, valid = split.blocked_split(t.panel().select(*KEYS, "day_num", "demand"), "day_num", t.study.windows)
    return reshape.union_all(
        train.withColumn("valid_window", F.lit(0)).withColumn("part", F.lit("train")),
        valid.withColumn("part", F.lit("valid")),
    )


SNAP_SQL = """CASE left(store_id, 2) WHEN 'AF' THEN snap_AF WHEN 'AM' THEN snap_AM WHEN 'AS' THEN snap_AS
  WHEN 'EU' THEN snap_EU WHEN 'MI' THEN snap_MI ELSE 0 END"""


@query("case_snap", f"SELECT store_id, dept_id, day_num, {SNAP_SQL} AS snap FROM panel_cal", ["panel_cal"])
def case_snap(t: BoundTables) -> DataFrame:
    return t.panel_calendar().select(*KEYS, "day_num", t.snap(F.col("store_id")).alias("snap"))


@query(
    "case_valid_window",
    f"""SELECT {window_case('day_num')} AS valid_window, count(*) AS n, sum(demand) AS demand
FROM panel GROUP BY 1""",
    ["panel"],
)
def case_valid_window(t: BoundTables) -> DataFrame:
    number = S.valid_window_number(F.col("day_num"), t.study.windows).alias("valid_window")
    return t.panel().groupBy(number).agg(F.count(F.lit(1)).alias("n"), F.sum("demand").alias("demand"))


@query(
    "fill_event_none",
    """SELECT store_id, dept_id, day_num, coalesce(event_name_1, 'none') AS event_name_1,
  coalesce(event_type_1, 'none') AS event_type_1, coalesce(event_name_2, 'none') AS event_name_2,
  coalesce(event_type_2, 'none') AS event_type_2 FROM panel_cal""",
    ["panel_cal"],
)
def fill_event_none(t: BoundTables) -> DataFrame:
    return t.panel_calendar().select(*KEYS, "day_num", *EVENT_COLUMNS).na.fill("none", list(EVENT_COLUMNS))


@query(
    "update_future_sales",
    """SELECT store_id, dept_id, day_num, CASE WHEN day_num <= 2468 THEN demand
  ELSE lag(demand, 28) OVER (PARTITION BY store_id, dept_id ORDER BY day_num) END AS demand
FROM panel_all WHERE day_num <= 2496""",
    ["panel_all"],
    compact="dept",
)
def update_future_sales(t: BoundTables) -> DataFrame:
    """Unknown future demand overwritten by the value 28 days earlier."""
    s = t.study
    known = t.panel().select(*KEYS, "day_num", "demand")
    days = reshape.day_range(s.forecast_first, s.forecast_last).alias("day_num")
    future = known.select(*KEYS).distinct().select(*KEYS, days)
    frame = reshape.union_all(known, future.withColumn("demand", F.lit(None).cast("double")))
    naive = known.select(*KEYS, (F.col("day_num") + s.horizon).alias("day_num"), "demand")
    return features.update_values(frame, naive.where(F.col("day_num") > s.train_last), [*KEYS, "day_num"], "demand")


@query(
    "date_features",
    """SELECT store_id, dept_id, day_num, CAST(wday AS SMALLINT) AS wday, CAST(weekofyear(date) AS SMALLINT) AS week,
  CAST(month AS SMALLINT) AS month, CAST(quarter(date) AS SMALLINT) AS quarter, CAST(year AS SMALLINT) AS year,
  CAST(day(date) AS SMALLINT) AS mday, CAST((isodow(date) - 1) AS SMALLINT) AS weekday_from_date FROM panel_cal""",
    ["panel_cal"],
)
def date_features(t: BoundTables) -> DataFrame:
    df = features.add_date_features(t.panel_calendar())
    plain = S.date_features(F.col("date"))["wday"].alias("weekday_from_date")
    return df.select(*KEYS, "day_num", "wday", "week", "month", "quarter", "year", "mday", plain)


@query(
    "narrow_numeric_types",
    """SELECT store_id, dept_id, CAST(day_num AS SMALLINT) AS day_num, CAST(demand AS SMALLINT) AS demand,
  CAST(lines AS TINYINT) AS lines
FROM (SELECT store_id, dept_id, day_num, sum(units) AS demand, count(*) AS lines FROM base GROUP BY ALL)""",
    ["base"],
)
def narrow_numeric_types(t: BoundTables) -> DataFrame:
    wide = t.rollup(
        t.facts(),
        (*DEPT_KEYS, "day_num"),
        F.sum(F.col("units").cast("bigint")).alias("demand"),
        F.count(F.lit(1)).alias("lines"),
    )
    return encode.narrow_numeric_types(wide)


@query(
    "narrow_type_ranges",
    """SELECT min(day_num) AS min_day_num, max(day_num) AS max_day_num, min(units) AS min_units, max(units) AS max_units,
  min(p_retailprice) AS min_p_retailprice, max(p_retailprice) AS max_p_retailprice FROM base""",
    ["base"],
)
def narrow_type_ranges(t: BoundTables) -> DataFrame:
    return encode.column_ranges(t.facts().select("day_num", "units", "p_retailprice"))


@query(
    "category_codes",
    """SELECT store_id, dept_id, day_num,
  CAST(dense_rank() OVER (ORDER BY store_id NULLS FIRST) - 1 AS INTEGER) AS store_id_code,
  CAST(dense_rank() OVER (ORDER BY dept_id NULLS FIRST) - 1 AS INTEGER) AS dept_id_code,
  CAST(dense_rank() OVER (ORDER BY event_name_1 NULLS FIRST) - 1 AS INTEGER) AS event_name_1_code,
  CAST(dense_rank() OVER (ORDER BY event_type_2 NULLS FIRST) - 1 AS INTEGER) AS event_type_2_code FROM panel_cal""",
    ["panel_cal"],
    compact="dept",
)
def category_codes(t: BoundTables) -> DataFrame:
    df = t.panel_calendar().select(*KEYS, "day_num", "event_name_1", "event_type_2")
    coded = encode.category_codes(df, ["store_id", "dept_id", "event_name_1", "event_type_2"])
    return coded.drop("event_name_1", "event_type_2")


@query(
    "item_codes",
    """SELECT id, CAST(dense_rank() OVER (ORDER BY item_id) - 1 AS INTEGER) AS item_id_code,
  CAST(dense_rank() OVER (ORDER BY cat_id) - 1 AS INTEGER) AS cat_id_code,
  CAST(dense_rank() OVER (ORDER BY state_id) - 1 AS INTEGER) AS state_id_code FROM series""",
    ["series"],
    compact="item",
)
def item_codes(t: BoundTables) -> DataFrame:
    coded = encode.category_codes(t.series, ["item_id", "cat_id", "state_id"])
    return coded.select("id", "item_id_code", "cat_id_code", "state_id_code")


@query(
    "label_encode",
    f"""WITH filled AS (SELECT store_id, dept_id, day_num, coalesce(event_name_1, 'none') AS event_name_1 FROM panel_cal),
codes AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code FROM
  (SELECT DISTINCT event_name_1 AS v FROM filled WHERE NOT {IN_WINDOWS('day_num')})),
stores AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code FROM
  (SELECT DISTINCT store_id AS v FROM filled WHERE NOT {IN_WINDOWS('day_num')}))
SELECT f.store_id, f.dept_id, f.day_num, s.code AS store_id_code, c.code AS event_name_1_code
FROM filled f JOIN codes c ON c.v = f.event_name_1 JOIN stores s ON s.v = f.store_id
WHERE {IN_WINDOWS('day_num')}""",
    ["panel_cal"],
    compact="dept",
)
def label_encode(t: BoundTables) -> DataFrame:
    """Dictionaries learned on the training days, applied to the validation windows."""
    df = t.panel_calendar().select(*KEYS, "day_num", "event_name_1").na.fill("none")
    train, valid = split.blocked_split(df, "day_num", t.study.windows)
    codes = encode.fit_codes(train, ["store_id", "event_name_1"])
    return encode.apply_codes(valid, codes).select(*KEYS, "day_num", "store_id_code", "event_name_1_code")


_TYPES = S.EVENT_TYPES
_LEAD_TYPE_SQL = ", ".join(
    f"lead(event_type_1, {n}) OVER (PARTITION BY store_id, dept_id ORDER BY day_num) AS e{n}" for n in (1, 2, 3)
)
_DUMMY_SQL = ", ".join(
    [f"CASE WHEN event_type_1 = '{e}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS event_type_{e}" for e in _TYPES]
    + [
        f"CASE WHEN e{n} = '{e}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS L{n}_event_type_{e}"
        for n in (1, 2, 3)
        for e in _TYPES
    ]
    + [f"CASE WHEN month = {m} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS month_{m}" for m in S.DUMMY_MONTHS]
)


@query(
    "dummies_event_month",
    f"SELECT store_id, dept_id, day_num, {_DUMMY_SQL} FROM (SELECT *, {_LEAD_TYPE_SQL} FROM panel_cal)",
    ["panel_cal"],
)
def dummies_event_month(t: BoundTables) -> DataFrame:
    df = features.add_leads(t.panel_calendar(), KEYS, "day_num", ["event_type_1"], [1, 2, 3])
    cols = S.event_dummies(F.col("event_type_1"))
    for n in (1, 2, 3):
        cols |= S.event_dummies(F.col(f"L{n}_event_type_1"), f"L{n}_")
    cols |= S.month_dummies(F.col("month"))
    return df.select(*KEYS, "day_num", *[c.alias(name) for name, c in cols.items()])


@query(
    "parse_series_id",
    """SELECT id, item_id, dept_id, cat_id, store_id, state_id, 'validation' AS phase,
  item_id || '_' || store_id AS key FROM series""",
    ["series"],
)
def parse_series_id(t: BoundTables) -> DataFrame:
    parts = S.series_id_parts(F.col("id"))
    parsed = t.series.select("id", *[c.alias(n) for n, c in parts.items()])
    return parsed.withColumn("key", F.concat_ws("_", "item_id", "store_id"))


# ---- reshaping ---------------------------------------------------------------

def wide_sales(t: BoundTables) -> DataFrame:
    """All training days as one column per day; a few cells are unknown."""
    number = F.element_at(F.split("item_id", "_"), -1).cast("int")
    gap = (number % 10 == 0) & (F.col("day_num") % 13 == 0)
    long = t.sales().withColumn("sales", F.when(~gap, F.col("sales")))
    names = [f"d_{d}" for d in range(1, t.study.train_last + 1)]
    return long.groupBy(*IDS).pivot("d", names).agg(F.first("sales"))


@query(
    "melt_wide_sales",
    """SELECT id, item_id, dept_id, cat_id, store_id, state_id, CAST((day_num - 1) // 28 AS INTEGER) AS block, count(*) AS n_days,
  count(*) - count(v) AS n_unknown, coalesce(sum(v), 0.0) AS sales, coalesce(sum(v * day_num), 0.0) AS by_day
FROM (SELECT *, CASE WHEN CAST(right(item_id, 3) AS INTEGER) % 10 = 0 AND day_num % 13 = 0 THEN NULL ELSE sales END AS v FROM sales)
GROUP BY ALL""",
    ["sales"],
    compact="item",
)
def melt_wide_sales(t: BoundTables) -> DataFrame:
    """Every cell of the wide matrix as a row of its own, summed up by series and 28 days."""
    long = reshape.melt_days(wide_sales(t), IDS).withColumn("day_num", S.day_ordinal(F.col("d")))
    block = F.floor((F.col("day_num") - 1) / 28).cast("int").alias("block")
    return long.groupBy(*IDS, block).agg(
        F.count("*").alias("n_days"),
        (F.count("*") - F.count("sales")).alias("n_unknown"),
        F.coalesce(F.sum("sales"), F.lit(0.0)).alias("sales"),
        F.coalesce(F.sum(F.col("sales") * F.col("day_num")), F.lit(0.0)).alias("by_day"),
    )


#: Departments of the bound tables, as the check SQL has to name its columns.
_BY_DEPT = ", ".join(
    f"max(demand) FILTER (WHERE dept_id = '{d}') AS \"{d}\""
    for d in ("ECONOMY_1", "LARGE_1", "MEDIUM_1", "PROMO_1", "SMALL_1", "STANDARD_1")
)


def dept_names(t: BoundTables) -> list[str]:
    """Department names for pivot headers: a size-checked set read from the item dimension."""
    bound = 1_000
    rows = t.items.select("dept_id").distinct().orderBy("dept_id").limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"more than {bound} departments cannot become columns")
    return [r.dept_id for r in rows]


@query(
    "pivot_dept_matrix",
    f"""SELECT store_id, day_num, {_BY_DEPT} FROM panel GROUP BY store_id, day_num""",
    ["panel"],
)
def pivot_dept_matrix(t: BoundTables) -> DataFrame:
    panel = t.panel().select(*KEYS, "day_num", "demand")
    return reshape.series_matrix(panel, ["store_id", "day_num"], "dept_id", "demand", dept_names(t))


@query(
    "unpivot_forecast_matrix",
    """SELECT store_id, day_num, dept_id, demand_fcast FROM naive""",
    ["naive"],
)
def unpivot_forecast_matrix(t: BoundTables) -> DataFrame:
    naive = submission.naive_forecast(t)
    wide = reshape.series_matrix(naive, ["store_id", "day_num"], "dept_id", "demand_fcast", dept_names(t))
    renamed = wide.toDF("store_id", "day_num", *[f"d_level_{c}_fcast" for c in wide.columns[2:]])
    long = reshape.matrix_to_long(
        renamed, ["store_id", "day_num"], "dept_id", "demand_fcast", prefix="d_level_", suffix="_fcast"
    )
    return long.where(F.col("demand_fcast").isNotNull())


@query(
    "scaffold_future",
    """SELECT store_id, dept_id, day_num, demand FROM panel
UNION ALL SELECT s.store_id, d.dept_id, c.day_num, NULL FROM (SELECT DISTINCT store_id FROM panel) s
CROSS JOIN (SELECT DISTINCT dept_id FROM panel) d CROSS JOIN calendar c WHERE c.day_num BETWEEN 2469 AND 2499""",
    ["panel", "calendar"],
    compact="dept",
)
def scaffold_future(t: BoundTables) -> DataFrame:
    s = t.study
    panel = t.panel().select(*KEYS, "day_num", "demand")
    pairs = t.panel(s.train_last)
    future = reshape.scaffold(pairs, *KEYS, "day_num", s.forecast_first, s.forecast_last + s.lead_days)
    return reshape.union_all(panel, future)


@query(
    "horizon_index",
    """SELECT o.store_id, o.dept_id, o.day_num AS origin, CAST(h.range AS INTEGER) AS step,
  CAST(o.day_num + h.range AS INTEGER) AS day_num, CAST(o.date + CAST(h.range AS INTEGER) AS DATE) AS date, c.wday
FROM panel o CROSS JOIN range(1, 29) h JOIN calendar c ON c.day_num = o.day_num + h.range
WHERE o.day_num IN (2440, 2386, 2332, 2278, 2224, 2468)""",
    ["panel", "calendar"],
)
def horizon_index(t: BoundTables) -> DataFrame:
    s = t.study
    origins = [first - 1 for first, _ in s.windows] + [s.train_last]
    panel = t.panel().where(F.col("day_num").isin(origins))
    index = reshape.horizon_index(
        panel.withColumnRenamed("day_num", "origin"), "origin", s.horizon, [*KEYS, "date"]
    ).withColumn("date", F.date_add("date", F.col("step")))
    wdays = t.calendar.select("day_num", "wday")
    return index.join(F.broadcast(wdays), "day_num").select(*KEYS, "origin", "step", "day_num", "date", "wday")


@query(
    "horizon_index_all",
    """SELECT store_id, dept_id, day_num AS origin, CAST(28 AS BIGINT) AS n_steps, CAST(day_num + 1 AS INTEGER) AS first_day,
  CAST(day_num + 28 AS INTEGER) AS last_day, CAST(date + 28 AS DATE) AS last_date FROM panel""",
    ["panel"],
)
def horizon_index_all(t: BoundTables) -> DataFrame:
    """The steps of every origin of the history, one row an origin."""
    index = reshape.horizon_index(t.panel().withColumnRenamed("day_num", "origin"), "origin", t.study.horizon, [*KEYS, "date"])
    return index.groupBy(*KEYS, "origin").agg(
        F.count("*").alias("n_steps"),
        F.min("day_num").alias("first_day"),
        F.max("day_num").alias("last_day"),
        F.max(F.date_add("date", F.col("step"))).alias("last_date"),
    )


# ---- joins -------------------------------------------------------------------


@query(
    "join_calendar_left",
    """SELECT store_id, dept_id, day_num, demand, wm_yr_wk, weekday, wday, month, year, event_name_1 FROM panel_cal""",
    ["panel_cal"],
)
def join_calendar_left(t: BoundTables) -> DataFrame:
    cols = ["demand", "wm_yr_wk", "weekday", "wday", "month", "year", "event_name_1"]
    return t.panel_calendar().select(*KEYS, "day_num", *cols)


@query(
    "join_calendar_price",
    """SELECT s.store_id, s.dept_id, s.day_num, count(*) AS priced_items, sum(s.sales) AS sales,
  round(sum(p.sell_price), 4) AS price_sum
FROM sales s JOIN calendar c ON c.d = s.d
JOIN prices p ON p.store_id = s.store_id AND p.item_id = s.item_id AND p.wm_yr_wk = c.wm_yr_wk
GROUP BY ALL""",
    ["sales", "calendar", "prices"],
    compact="item",
)
def join_calendar_price(t: BoundTables) -> DataFrame:
    """Every item-day that was on sale, summarised per department and day."""
    priced = t.priced_sales(carry=True)
    return priced.groupBy(*KEYS, "day_num").agg(
        F.count(F.lit(1)).alias("priced_items"),
        F.sum("sales").alias("sales"),
        F.round(F.sum("sell_price"), 4).alias("price_sum"),
    )


@query(
    "dollar_sales_trailing",
    "SELECT id, item_id, dept_id, cat_id, store_id, state_id, round(dollar_sales, 6) AS dollar_sales FROM dollars",
    ["dollars"],
    compact="item",
)
def dollar_sales_trailing(t: BoundTables) -> DataFrame:
    return submission.trailing_dollars(t).select(*IDS, r6("dollar_sales"))


@query(
    "join_exog",
    f"""SELECT store_id, dept_id, day_num, demand, {SNAP_SQL} AS snap, event_type_1,
  lead(event_type_1, 1) OVER w AS L1_event_type_1, lead(event_type_1, 2) OVER w AS L2_event_type_1,
  lead(event_type_1, 3) OVER w AS L3_event_type_1, month
FROM panel_cal WINDOW w AS (PARTITION BY store_id, dept_id ORDER BY day_num)""",
    ["panel_cal"],
    compact="dept",
)
def join_exog(t: BoundTables) -> DataFrame:
    """Panel rows joined to a separate table of exogenous columns on (store, department, day)."""
    cal = features.add_leads(t.panel_calendar(), KEYS, "day_num", ["event_type_1"], [1, 2, 3])
    exog = cal.select(
        *KEYS,
        "day_num",
        t.snap(F.col("store_id")).alias("snap"),
        *[c for c in cal.columns if c.endswith("event_type_1")],
        "month",
    )
    return t.panel().select(*KEYS, "day_num", "demand").join(exog, [*KEYS, "day_num"], "left")


@query(
    "join_predictions_keyed",
    """SELECT p.store_id, p.dept_id, p.day_num, p.demand, n.demand_fcast
FROM panel_all p LEFT JOIN naive n USING (store_id, dept_id, day_num) WHERE p.day_num BETWEEN 2469 AND 2496""",
    ["panel_all", "naive"],
    compact="dept",
)
def join_predictions_keyed(t: BoundTables) -> DataFrame:
    s = t.study
    actual = t.panel(s.forecast_first, s.forecast_last).select(*KEYS, "day_num", "demand")
    return actual.join(submission.naive_forecast(t), [*KEYS, "day_num"], "left")


@query(
    "join_right_keys",
    f"""SELECT store_id, dept_id, day_num, date, demand, {window_case('day_num')} AS valid_window
FROM panel WHERE {IN_WINDOWS('day_num')}""",
    ["panel"],
    compact="dept",
)
def join_right_keys(t: BoundTables) -> DataFrame:
    """Validation features keep their rows and regain the descriptive columns."""
    _, valid = split.blocked_split(t.panel(), "day_num", t.study.windows)
    return t.panel().select(*KEYS, "day_num", "date").join(valid.drop("date"), [*KEYS, "day_num"], "right")


@query(
    "lag_by_date_join",
    """SELECT c.store_id, c.dept_id, c.day_num, c.demand, e.demand AS lag_7
FROM daily c LEFT JOIN daily e ON e.store_id = c.store_id AND e.dept_id = c.dept_id AND e.day_num = c.day_num - 7""",
    ["daily"],
)
def lag_by_date_join(t: BoundTables) -> DataFrame:
    return features.lag_by_date_join(t.daily(), KEYS, "day_num", "demand", 7, "lag_7")


@query(
    "lag_by_date_window",
    """SELECT store_id, dept_id, day_num, demand,
  max(demand) OVER (w RANGE BETWEEN 7 PRECEDING AND 7 PRECEDING) AS lag_7,
  max(demand) OVER (w RANGE BETWEEN 28 PRECEDING AND 28 PRECEDING) AS lag_28
FROM daily WINDOW w AS (PARTITION BY store_id, dept_id ORDER BY day_num)""",
    ["daily"],
)
def lag_by_date_window(t: BoundTables) -> DataFrame:
    return features.add_lags_by_day(t.daily(), KEYS, "day_num", "demand", {"lag_7": 7, "lag_28": 28})


# ---- aggregates --------------------------------------------------------------


@query(
    "agg_store_dept_daily",
    "SELECT store_id, dept_id, day_num, demand FROM daily",
    ["daily"],
)
def agg_store_dept_daily(t: BoundTables) -> DataFrame:
    return t.daily()


@query(
    "check_weights_sum",
    """SELECT store_id, dept_id, round(sum(weight), 6) AS sum_weight FROM weights GROUP BY ALL""",
    ["weights"],
    compact="item",
)
def check_weights_sum(t: BoundTables) -> DataFrame:
    totals = weights.check_totals(submission.item_weights(t).select(*KEYS, "weight"), KEYS)
    return totals.select(*KEYS, r6("sum_weight"))


@query("count_by_day", "SELECT day_num, count(*) AS n FROM base GROUP BY day_num", ["base"])
def count_by_day(t: BoundTables) -> DataFrame:
    return t.facts().groupBy("day_num").agg(F.count(F.lit(1)).alias("n"))


@query("distinct_keys", "SELECT DISTINCT store_id, dept_id FROM base", ["base"])
def distinct_keys(t: BoundTables) -> DataFrame:
    return t.rollup(t.facts(), DEPT_KEYS, F.count(F.lit(1)).alias("n")).select(*KEYS)


@query(
    "table_shapes",
    """SELECT 'lineitem' AS table_name, count(*) AS n_rows, 4 AS n_cols FROM lineitem
UNION ALL SELECT 'calendar_days_sold', count(DISTINCT day_num), 1 FROM base
UNION ALL SELECT 'sales', count(*), 10 FROM sales UNION ALL SELECT 'prices', count(*), 4 FROM prices
UNION ALL SELECT 'panel', count(*), 5 FROM panel""",
    ["base", "sales", "prices", "panel"],
    compact="item",
)
def table_shapes(t: BoundTables) -> DataFrame:
    frames = {
        "lineitem": t.lines(),
        "calendar_days_sold": t.facts().select("day_num").distinct(),
        "sales": t.sales(),
        "prices": t.prices,
        "panel": t.panel(),
    }
    counts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_cols")
        )
        for name, df in frames.items()
    ]
    return reshape.union_all(*counts)


def scored_windows(t: BoundTables) -> DataFrame:
    """Validation rows with two closed-form forecasts: lag 28 and the mean of lags 28 and 35."""
    panel = features.add_lags(t.panel(), KEYS, "day_num", "demand", {"lag_28": 28, "lag_35": 35})
    _, valid = split.blocked_split(panel, "day_num", t.study.windows)
    return valid.withColumn("blend", (F.col("lag_28") + F.col("lag_35")) / 2)


_SCORED_SQL = f"""WITH scored AS (SELECT *, {window_case('day_num')} AS valid_window FROM (
  SELECT *, lag(demand, 28) OVER w AS lag_28, lag(demand, 35) OVER w AS lag_35 FROM panel
  WINDOW w AS (PARTITION BY store_id, dept_id ORDER BY day_num)) WHERE {IN_WINDOWS('day_num')})"""


@query(
    "rmse_by_window",
    _SCORED_SQL
    + """ SELECT valid_window, store_id, dept_id, round(sqrt(avg((demand - lag_28) ** 2)), 6) AS rmse
FROM scored GROUP BY ALL""",
    ["panel"],
)
def rmse_by_window(t: BoundTables) -> DataFrame:
    scored = metrics.rmse_by(scored_windows(t), ["valid_window", *KEYS], "demand", "lag_28")
    return scored.select("valid_window", *KEYS, r6("rmse"))


@query(
    "wrmse_by_window",
    _SCORED_SQL
    + """, per AS (SELECT valid_window, store_id, dept_id, sqrt(avg((demand - lag_28) ** 2)) AS rmse
FROM scored GROUP BY ALL)
SELECT valid_window, round(sum(w.dollar_sales * rmse), 6) AS wrmse
FROM per JOIN dept_weights w USING (store_id, dept_id) GROUP BY valid_window""",
    ["panel", "dept_weights"],
    compact="item",
)
def wrmse_by_window(t: BoundTables) -> DataFrame:
    out = metrics.wrmse_by(
        scored_windows(t), "valid_window", KEYS, submission.dept_weights(t), "demand", "lag_28"
    )
    return out.select("valid_window", r6("wrmse"))


@query(
    "wrmse_csv_weights",
    _SCORED_SQL
    + """, per AS (SELECT valid_window, store_id, dept_id, sqrt(avg((demand - lag_28) ** 2)) AS rmse
FROM scored GROUP BY ALL)
SELECT valid_window, round(sum(w.dollar_sales * rmse), 6) AS wrmse
FROM per JOIN dept_weights w USING (store_id, dept_id) GROUP BY valid_window""",
    ["panel", "dept_weights"],
    compact="item",
)
def wrmse_csv_weights(t: BoundTables) -> DataFrame:
    """The weighted error with weights read from a CSV file of the published layout."""
    path = shared_path(t.spark, "weights")
    tables.write_csv(submission.dept_weights(t).select(*KEYS, "dollar_sales"), path)
    out = metrics.wrmse_by(scored_windows(t), "valid_window", KEYS, tables.load_weights(t.spark, path), "demand", "lag_28")
    return out.select("valid_window", r6("wrmse"))


@query(
    "rmse_two_models",
    _SCORED_SQL
    + """ SELECT valid_window, round(sqrt(avg((demand - lag_28) ** 2)), 6) AS base_rmse,
round(sqrt(avg((demand - (lag_28 + lag_35) / 2) ** 2)), 6) AS final_rmse FROM scored GROUP BY valid_window""",
    ["panel"],
)
def rmse_two_models(t: BoundTables) -> DataFrame:
    both = metrics.rmse_models(
        scored_windows(t), ["valid_window"], "demand", {"base_rmse": "lag_28", "final_rmse": "blend"}
    )
    return both.select("valid_window", r6("base_rmse"), r6("final_rmse"))


# ---- windows -----------------------------------------------------------------


@query(
    "lag_demand",
    """SELECT store_id, dept_id, day_num, demand, lag(demand, 7) OVER w AS L7_demand,
  lag(demand, 14) OVER w AS L14_demand, lag(demand, 28) OVER w AS L28_demand
FROM panel WINDOW w AS (PARTITION BY store_id, dept_id ORDER BY day_num)""",
    ["panel"],
)
def lag_demand(t: BoundTables) -> DataFrame:
    panel = t.panel().select(*KEYS, "day_num", "demand")
    return features.add_lags(panel, KEYS, "day_num", "demand", {f"L{n}_demand": n for n in (7, 14, 28)})


@query(
    "lead_events",
    "SELECT store_id, dept_id, day_num, "
    + ", ".join(f"lead({c}, {n}) OVER w AS L{n}_{c}" for n in (1, 2, 3) for c in ("event_name_1", "event_type_1"))
    + " FROM panel_cal WINDOW w AS (PARTITION BY store_id, dept_id ORDER BY day_num)",
    ["panel_cal"],
)
def lead_events(t: BoundTables) -> DataFrame:
    df = t.panel_calendar().select(*KEYS, "day_num", "event_name_1", "event_type_1")
    led = features.add_leads(df, KEYS, "day_num", ["event_name_1", "event_type_1"], [1, 2, 3])
    return led.drop("event_name_1", "event_type_1")


@query(
    "rolling_mean_lagged",
    """SELECT store_id, dept_id, day_num,
  CASE WHEN count(demand) OVER (w ROWS BETWEEN 34 PRECEDING AND 28 PRECEDING) = 7
    THEN round(avg(demand) OVER (w ROWS BETWEEN 34 PRECEDING AND 28 PRECEDING), 6) END AS mean_demand_28_7,
  CASE WHEN count(demand) OVER (w ROWS BETWEEN 55 PRECEDING AND 28 PRECEDING) = 28
    THEN round(avg(demand) OVER (w ROWS BETWEEN 55 PRECEDING AND 28 PRECEDING), 6) END AS mean_demand_28_28
FROM panel WINDOW w AS (PARTITION BY store_id, dept_id ORDER BY day_num)""",
    ["panel"],
)
def rolling_mean_lagged(t: BoundTables) -> DataFrame:
    specs = {"mean_demand_28_7": (28, 7), "mean_demand_28_28": (28, 28)}
    means = features.add_rolling_means(t.panel(), KEYS, "day_num", "demand", specs)
    return means.select(*KEYS, "day_num", *[r6(c) for c in specs])


BOTTOM_LAGS = {"lag_7": 7, "lag_28": 28}
BOTTOM_MEANS = {f"rmean_{lag}_{win}": (lag, win) for win in (7, 28) for lag in (7, 28)}
_BOTTOM_SQL = ", ".join(
    [f"lag(sales, {n}) OVER w AS {name}" for name, n in BOTTOM_LAGS.items()]
    + [
        f"CASE WHEN count(sales) OVER (w ROWS BETWEEN {lag + win - 1} PRECEDING AND {lag} PRECEDING) = {win} "
        f"THEN avg(sales) OVER (w ROWS BETWEEN {lag + win - 1} PRECEDING AND {lag} PRECEDING) END AS {name}"
        for name, (lag, win) in BOTTOM_MEANS.items()
    ]
)


@query(
    "features_bottom_train",
    "SELECT store_id, dept_id, day_num, "
    + ", ".join(f"round(sum({c}), 4) AS {c}, count({c}) AS n_{c}" for c in [*BOTTOM_LAGS, *BOTTOM_MEANS])
    + f""" FROM (SELECT *, {_BOTTOM_SQL} FROM (
  SELECT s.* FROM sales s JOIN calendar c ON c.day_num = s.day_num
  JOIN prices p ON p.store_id = s.store_id AND p.item_id = s.item_id AND p.wm_yr_wk = c.wm_yr_wk)
  WINDOW w AS (PARTITION BY id ORDER BY day_num)) GROUP BY ALL""",
    ["sales", "calendar", "prices"],
    compact="item",
)
def features_bottom_train(t: BoundTables) -> DataFrame:
    """Positional lags and full-window means of every item series, totalled per department and day."""
    priced = t.priced_sales(carry=True)
    key = ["store_id", "item_id"]
    df = features.add_lags(priced, key, "day_num", "sales", BOTTOM_LAGS)
    df = features.add_rolling_means(df, key, "day_num", "sales", BOTTOM_MEANS)
    names = [*BOTTOM_LAGS, *BOTTOM_MEANS]
    return df.groupBy(*KEYS, "day_num").agg(
        *[a for c in names for a in (F.round(F.sum(c), 4).alias(c), F.count(c).alias(f"n_{c}"))]
    )


@query(
    "rolling_mean_by_date",
    """SELECT store_id, dept_id, day_num, """
    + ", ".join(
        f"round(avg(demand) OVER (w RANGE BETWEEN {lag + win - 1} PRECEDING AND {lag} PRECEDING), 6) AS {name}"
        for name, (lag, win) in BOTTOM_MEANS.items()
    )
    + " FROM daily WINDOW w AS (PARTITION BY store_id, dept_id ORDER BY day_num)",
    ["daily"],
)
def rolling_mean_by_date(t: BoundTables) -> DataFrame:
    """Partial calendar windows over the gappy daily series."""
    means = features.add_rolling_means_by_day(t.daily(), KEYS, "day_num", "demand", BOTTOM_MEANS)
    return means.select(*KEYS, "day_num", *[r6(c) for c in BOTTOM_MEANS])


@query(
    "level_reconstruct",
    """SELECT store_id, dept_id, day_num, round(first_value(demand) OVER w
  + sum(coalesce(demand - prev, 0)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS level
FROM (SELECT *, lag(demand) OVER (PARTITION BY store_id, dept_id ORDER BY day_num) AS prev FROM panel)
WINDOW w AS (PARTITION BY store_id, dept_id ORDER BY day_num)""",
    ["panel"],
)
def level_reconstruct(t: BoundTables) -> DataFrame:
    """Levels rebuilt from the first known value and the running sum of differences."""
    w = features.series_window(KEYS, "day_num")
    panel = t.panel().select(*KEYS, "day_num", "demand")
    deltas = panel.withColumn("delta", F.coalesce(F.col("demand") - F.lag("demand").over(w), F.lit(0.0))).withColumn(
        "start", F.first("demand").over(w)
    )
    return features.cumulate_level(deltas, KEYS, "day_num", "start", "delta", "level").select(
        *KEYS, "day_num", r6("level")
    )


@query(
    "last_level",
    """SELECT store_id, dept_id, arg_max(demand, day_num) AS last_demand, max(day_num) AS last_demand_day_num
FROM daily WHERE day_num <= 2468 GROUP BY ALL""",
    ["daily"],
)
def last_level(t: BoundTables) -> DataFrame:
    return features.last_known(t.daily(t.study.train_last), KEYS, "day_num", "demand", "last_demand")


_RESID_LAGS = {f"resid_lag{n}": n for n in range(1, 8)}
_RESID_SQL = f"""WITH r AS (SELECT p.store_id, p.dept_id, p.day_num, p.demand - h.demand AS resid,
  unnest(range(p.day_num - 27, p.day_num + 1)) AS origin FROM panel p
  JOIN panel h ON h.store_id = p.store_id AND h.dept_id = p.dept_id AND h.day_num = p.day_num - 28),
l AS (SELECT *, {", ".join(f"lag(resid, {n}) OVER w AS {c}" for c, n in _RESID_LAGS.items())},
  CASE WHEN count(resid) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) = 7
    THEN avg(resid) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) END AS rmean_1_7
  FROM r WHERE origin BETWEEN 29 AND 2441 WINDOW w AS (PARTITION BY store_id, dept_id, origin ORDER BY day_num))
SELECT store_id, dept_id, CAST(origin AS INTEGER) AS origin, count(*) AS n_steps, sum(resid) AS resid,
  {", ".join(f"sum(resid * {c}) AS {c}" for c in _RESID_LAGS)}, count(rmean_1_7) AS n_means,
  round(sum(rmean_1_7 * day_num), 4) AS rmean_1_7 FROM l GROUP BY ALL"""


def naive_residuals(t: BoundTables) -> DataFrame:
    """Residuals of the lag-28 forecast at every step of every origin whose whole horizon is known."""
    s = t.study
    panel = features.add_lags(t.panel(), KEYS, "day_num", "demand", {"demand_fcast": s.horizon})
    day = F.col("day_num")
    origins = F.sequence(F.greatest(day - s.horizon + 1, F.lit(s.horizon + 1)), F.least(day, F.lit(s.train_last - s.horizon + 1)))
    known = panel.where((day > s.horizon) & (F.greatest(day - s.horizon + 1, F.lit(s.horizon + 1)) <= s.train_last - s.horizon + 1))
    return known.select(*KEYS, F.explode(origins).alias("origin"), "day_num", (F.col("demand") - F.col("demand_fcast")).alias("resid"))


@query("lag_residual", _RESID_SQL, ["panel"])
def lag_residual(t: BoundTables) -> DataFrame:
    """Residual lags and their weekly mean within each origin, summed up by origin."""
    key = [*KEYS, "origin"]
    df = features.add_lags(naive_residuals(t), key, "day_num", "resid", _RESID_LAGS)
    df = features.add_rolling_means(df, key, "day_num", "resid", {"rmean_1_7": (1, 7)})
    return df.groupBy(*key).agg(
        F.count("*").alias("n_steps"),
        F.sum("resid").alias("resid"),
        *[F.sum(F.col("resid") * F.col(c)).alias(c) for c in _RESID_LAGS],
        F.count("rmean_1_7").alias("n_means"),
        F.round(F.sum(F.col("rmean_1_7") * F.col("day_num")), 4).alias("rmean_1_7"),
    )


@query(
    "season_decompose",
    """SELECT store_id, dept_id, day_num, round(season, 6) AS season, round(level, 6) AS level,
  round(d_level, 6) AS d_level FROM levels""",
    ["levels"],
)
def season_decompose(t: BoundTables) -> DataFrame:
    df = features.decompose(t.panel_calendar(), KEYS, "day_num", "wday", "demand")
    return df.select(*KEYS, "day_num", r6("season"), r6("level"), r6("d_level"))


@query(
    "season_add_back",
    """SELECT n.store_id, n.dept_id, n.day_num, round(n.demand_fcast - s0.season, 6) AS level_fcast,
  round(n.demand_fcast - s0.season + s1.season, 6) AS demand_fcast
FROM naive n JOIN calendar c0 ON c0.day_num = n.day_num - 28 JOIN calendar c1 ON c1.day_num = n.day_num
JOIN season s0 ON s0.store_id = n.store_id AND s0.dept_id = n.dept_id AND s0.wday = c0.wday
LEFT JOIN season s1 ON s1.store_id = n.store_id AND s1.dept_id = n.dept_id AND s1.wday = c1.wday""",
    ["naive", "calendar", "season"],
    compact="dept",
)
def season_add_back(t: BoundTables) -> DataFrame:
    """A level forecast (the level 28 days earlier) turned back into demand."""
    s = t.study
    panel = t.panel_calendar()
    levels = features.decompose(panel, KEYS, "day_num", "wday", "demand")
    ahead = (F.col("day_num") + s.horizon).alias("day_num")
    fcast = levels.select(*KEYS, ahead, F.col("level").alias("level_fcast")).where(F.col("day_num") > s.train_last)
    seasons = features.season_levels(panel, KEYS, "wday", "demand")
    wdays = t.calendar.select("day_num", "wday")
    joined = fcast.join(F.broadcast(wdays), "day_num").join(seasons, [*KEYS, "wday"], "left")
    return joined.select(
        *KEYS, "day_num", r6("level_fcast"), r6(F.col("level_fcast") + F.col("season"), "demand_fcast")
    )


@query(
    "hybrid_combine",
    """SELECT store_id, dept_id, day_num, demand - lag_28 AS resid,
  round(lag_28 + (lag_35 - lag_28) / 2, 6) AS demand_fcast_final FROM (
  SELECT *, lag(demand, 28) OVER w AS lag_28, lag(demand, 35) OVER w AS lag_35 FROM panel
  WINDOW w AS (PARTITION BY store_id, dept_id ORDER BY day_num))""",
    ["panel"],
)
def hybrid_combine(t: BoundTables) -> DataFrame:
    """Base forecast plus predicted residual on all days, with a closed-form residual model."""
    panel = features.add_lags(t.panel(), KEYS, "day_num", "demand", {"lag_28": 28, "lag_35": 35})
    df = panel.withColumn("resid_fcast", (F.col("lag_35") - F.col("lag_28")) / 2)
    final = F.col("lag_28") + F.col("resid_fcast")
    return df.select(
        *KEYS, "day_num", (F.col("demand") - F.col("lag_28")).alias("resid"), r6(final, "demand_fcast_final")
    )


# ---- splits, samples, order --------------------------------------------------


@query(
    "sample_holdout",
    """SELECT *, CASE WHEN row_number() OVER (ORDER BY md5(store_id || '|' || dept_id || '|' || day_num || '|64')) <= 2000
  THEN 'holdout' ELSE 'train' END AS part FROM (SELECT store_id, dept_id, day_num, demand FROM panel)""",
    ["panel"],
    compact="dept",
)
def sample_holdout(t: BoundTables) -> DataFrame:
    panel = t.panel().select(*KEYS, "day_num", "demand")
    train, holdout = split.sample_holdout(panel, [*KEYS, "day_num"], 2_000, seed=64)
    return reshape.union_all(train.withColumn("part", F.lit("train")), holdout.withColumn("part", F.lit("holdout")))


@query(
    "split_origin",
    f"""SELECT o.day_num AS origin, count(*) AS n,
  CAST(count(*) FILTER (WHERE o.day_num <= 2441 AND NOT {IN_WINDOWS('p.day_num')}) AS BIGINT) AS n_train,
  CAST(count(*) FILTER (WHERE {IN_WINDOWS('p.day_num')}) AS BIGINT) AS n_valid,
  CAST(count(*) FILTER (WHERE {IN_WINDOWS('p.day_num')} AND o.day_num IN (2441, 2387, 2333, 2279, 2225)) AS BIGINT) AS n_scored
FROM calendar o JOIN panel p ON p.day_num BETWEEN o.day_num AND o.day_num + 27
WHERE o.day_num BETWEEN 30 AND 2441 GROUP BY 1""",
    ["calendar", "panel"],
    compact="dept",
)
def split_origin(t: BoundTables) -> DataFrame:
    """Rows of every forecast origin by the part of the split they fall into."""
    s = t.study
    rows = t.panel().select(
        *KEYS,
        "day_num",
        F.explode(F.sequence(F.col("day_num") - s.horizon + 1, F.col("day_num"))).alias("origin"),
    )
    rows = rows.where(F.col("origin").between(s.var_lags + 2, s.train_last - s.horizon + 1))
    train, valid, scored = split.origin_split(rows, "origin", "day_num", s.windows[0][0], s.windows)
    parts = [
        df.groupBy("origin").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit(name))
        for name, df in (("n", rows), ("n_train", train), ("n_valid", valid), ("n_scored", scored))
    ]
    names = ["n", "n_train", "n_valid", "n_scored"]
    return reshape.union_all(*parts).groupBy("origin").agg(
        *[F.coalesce(F.sum(F.when(F.col("part") == n, F.col("n"))), F.lit(0)).alias(n) for n in names]
    )


@query(
    "top_n_rows",
    """SELECT * FROM (SELECT store_id, dept_id, day_num, demand, 'head' AS side FROM daily
  ORDER BY store_id, dept_id, day_num LIMIT 100)
UNION ALL SELECT * FROM (SELECT store_id, dept_id, day_num, demand, 'tail' AS side FROM daily
  ORDER BY store_id DESC, dept_id DESC, day_num DESC LIMIT 100)""",
    ["daily"],
)
def top_n_rows(t: BoundTables) -> DataFrame:
    order = [*KEYS, "day_num"]
    daily = t.daily()
    head = daily.orderBy(*order).limit(100).withColumn("side", F.lit("head"))
    tail = daily.orderBy(*[F.col(c).desc() for c in order]).limit(100).withColumn("side", F.lit("tail"))
    return reshape.union_all(head, tail)


@query(
    "sort_multi_key",
    "SELECT store_id, dept_id, day_num, demand FROM daily ORDER BY store_id, dept_id, day_num",
    ["daily"],
)
def sort_multi_key(t: BoundTables) -> DataFrame:
    return t.daily().orderBy(*KEYS, "day_num")


# ---- weights and submissions -------------------------------------------------


@query(
    "weights_dollar_share",
    """SELECT id, item_id, dept_id, cat_id, store_id, state_id, round(dollar_sales, 6) AS dollar_sales,
  round(dept_dollars, 6) AS dept_dollars, round(weight, 6) AS weight FROM weights""",
    ["weights"],
    compact="item",
)
def weights_dollar_share(t: BoundTables) -> DataFrame:
    cols = ["dollar_sales", "dept_dollars", "weight"]
    return submission.item_weights(t).select(*IDS, *[r6(c) for c in cols])


@query(
    "share_over_window",
    """SELECT store_id, dept_id, round(dollar_sales / nullif(sum(dollar_sales) OVER (PARTITION BY store_id), 0), 6) AS share
FROM dept_weights""",
    ["dept_weights"],
    compact="item",
)
def share_over_window(t: BoundTables) -> DataFrame:
    shares = weights.share_over_window(submission.dept_weights(t), ["store_id"], "dollar_sales", "share")
    return shares.select(*KEYS, r6("share"))


_PHASES = "(SELECT unnest(['validation', 'evaluation']) AS phase)"


@query(
    "disaggregate_forecast",
    f"""SELECT s.item_id || '_' || s.store_id || '_' || ph.phase AS id, n.day_num,
  round(n.demand_fcast, 6) AS demand_fcast, round(n.demand_fcast * w.weight, 6) AS demand_submission
FROM series s CROSS JOIN {_PHASES} ph LEFT JOIN weights w ON w.id = s.id
LEFT JOIN naive n ON n.store_id = s.store_id AND n.dept_id = s.dept_id""",
    ["series", "weights", "naive"],
    compact="item",
)
def disaggregate_forecast(t: BoundTables) -> DataFrame:
    out = weights.disaggregate(
        submission.submission_ids(t), submission.item_weights(t), submission.naive_forecast(t)
    )
    return out.select("id", "day_num", r6("demand_fcast"), r6("demand_submission"))


_STEPS_AGG = ", ".join(f"round(max(v) FILTER (WHERE day_num = {2468 + i}), 6) AS F{i}" for i in range(1, 29))


_SUBMISSION_AGG = (
    f"""SELECT id, {_STEPS_AGG} FROM (
  SELECT s.item_id || '_' || s.store_id || '_' || ph.phase AS id, n.day_num, n.demand_fcast * w.weight AS v
  FROM series s CROSS JOIN {_PHASES} ph LEFT JOIN weights w ON w.id = s.id
  LEFT JOIN naive n ON n.store_id = s.store_id AND n.dept_id = s.dept_id) GROUP BY id ORDER BY id""",
    ["series", "weights", "naive"],
)


@query("submission_agg", *_SUBMISSION_AGG, compact="item")
def submission_agg(t: BoundTables) -> DataFrame:
    out = submission.aggregate_submission(
        submission.submission_ids(t),
        submission.item_weights(t),
        submission.naive_forecast(t),
        "demand_fcast",
        t.study,
    )
    return out.select("id", *[r6(c) for c in out.columns if c != "id"]).orderBy("id")


@query("submission_agg_csv", *_SUBMISSION_AGG, compact="item")
def submission_agg_csv(t: BoundTables) -> DataFrame:
    """The same submission from CSV files to a CSV file: the tables are written as a bundle first."""
    folder = shared_path(t.spark, "bundle")
    first = t.study.weight_first
    write_bundle(t, folder, first)
    out = submission_agg(BundleTables(t.spark, folder, t.study, first_day=first))
    tables.write_csv(out, f"{folder}/submission.csv")
    return tables.read_csv(t.spark, f"{folder}/submission.csv", tables.submission_schema(t.study.horizon))


_STEPS_BOTTOM = ", ".join(f"coalesce(max(sales) FILTER (WHERE rk = {i}), 0.0) AS F{i}" for i in range(1, 29))


@query(
    "submission_bottom",
    f"""SELECT replace(id, 'validation', ph.phase) AS id, {_STEPS_BOTTOM} FROM (
  SELECT s.id, s.sales, s.day_num + 28 - 2468 AS rk FROM sales s
  JOIN calendar c ON c.day_num = s.day_num + 28
  JOIN prices p ON p.store_id = s.store_id AND p.item_id = s.item_id AND p.wm_yr_wk = c.wm_yr_wk
  WHERE s.day_num + 28 BETWEEN 2469 AND 2496) CROSS JOIN {_PHASES} ph GROUP BY 1 ORDER BY 1""",
    ["sales", "calendar", "prices"],
    compact="item",
)
def submission_bottom(t: BoundTables) -> DataFrame:
    """Lag-28 item forecast on the days an item is priced, labelled, pivoted and doubled."""
    s = t.study
    lagged = t.sales(s.train_last - s.horizon + 1)
    future = lagged.withColumn("day_num", F.col("day_num") + s.horizon)
    priced = future.join(F.broadcast(t.calendar.select("day_num", "wm_yr_wk")), "day_num").join(
        t.prices, ["store_id", "item_id", "wm_yr_wk"], "left_semi"
    )
    evaluation = priced.select(
        F.replace("id", F.lit("validation"), F.lit("evaluation")).alias("id"), "day_num", "sales"
    )
    return submission.bottom_submission(evaluation, "day_num", "sales", s.forecast_first, s.horizon)
