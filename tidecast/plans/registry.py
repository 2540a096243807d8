"""Registry of named queries and the SQL each one is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from tidecast.config import TESTBED
from tidecast.sources.binding import BoundTables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_S = TESTBED
LAST = _S.train_last


def _in_windows(day: str) -> str:
    return "(" + " OR ".join(f"{day} BETWEEN {a} AND {b}" for a, b in _S.windows) + ")"


def window_case(day: str) -> str:
    whens = " ".join(f"WHEN {day} BETWEEN {a} AND {b} THEN {i}" for i, (a, b) in enumerate(_S.windows, 1))
    return f"CASE {whens} ELSE 0 END"


IN_WINDOWS = _in_windows

# Shared building blocks of the check SQL, in dependency order.
_CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "base": (
        (),
        """SELECT p_type || '_1_' || lpad(substr(p_brand, 7), 3, '0') AS item_id, p_type || '_1' AS dept_id,
  p_type AS cat_id, upper(left(r_name, 2)) || '_' || CAST(l_suppkey % 2 + 1 AS VARCHAR) AS store_id,
  upper(left(r_name, 2)) AS state_id, CAST(l_shipdate AS DATE) AS date,
  CAST(date_diff('day', DATE '1995-01-02', CAST(l_shipdate AS DATE)) + 1 AS INTEGER) AS day_num,
  l_quantity AS units, p_retailprice
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    ),
    "days": ((), f"SELECT CAST(range AS INTEGER) AS day_num FROM range(1, {_S.calendar_days + 1})"),
    "cal0": (
        ("days",),
        """SELECT day_num, CAST(DATE '1995-01-02' + (day_num - 1) AS DATE) AS date,
  CAST((day_num + 1) // 7 AS INTEGER) AS wk0, CAST((day_num + 1) % 7 AS INTEGER) AS wd0 FROM days""",
    ),
    "calendar": (
        ("cal0",),
        """SELECT date, wk0 + 1 AS wm_yr_wk, dayname(date) AS weekday, wd0 + 1 AS wday,
  CAST(month(date) AS INTEGER) AS month, CAST(year(date) AS INTEGER) AS year, 'd_' || day_num AS d, day_num,
  CASE WHEN strftime(date, '%m-%d') = '12-25' THEN 'Christmas' WHEN strftime(date, '%m-%d') = '07-04' THEN 'IndependenceDay'
       WHEN strftime(date, '%m-%d') = '02-14' THEN 'ValentinesDay' WHEN strftime(date, '%m-%d') = '10-31' THEN 'Halloween'
       WHEN strftime(date, '%m-%d') = '01-07' THEN 'OrthodoxChristmas'
       WHEN month(date) = 2 AND day(date) <= 7 AND dayofweek(date) = 0 THEN 'SuperBowl' END AS event_name_1,
  CASE WHEN strftime(date, '%m-%d') IN ('12-25', '07-04') THEN 'National'
       WHEN strftime(date, '%m-%d') IN ('02-14', '10-31') THEN 'Cultural'
       WHEN strftime(date, '%m-%d') = '01-07' THEN 'Religious'
       WHEN month(date) = 2 AND day(date) <= 7 AND dayofweek(date) = 0 THEN 'Sporting' END AS event_type_1,
  CASE WHEN strftime(date, '%m-%d') = '02-14' AND dayofweek(date) = 0 THEN 'SundayEvent' END AS event_name_2,
  CASE WHEN strftime(date, '%m-%d') = '02-14' AND dayofweek(date) = 0 THEN 'Cultural' END AS event_type_2,
  CASE WHEN day(date) <= 10 THEN 1 ELSE 0 END AS snap_AF,
  CASE WHEN day(date) <= 15 AND day(date) % 2 = 1 THEN 1 ELSE 0 END AS snap_AM,
  CASE WHEN day(date) <= 10 THEN 1 ELSE 0 END AS snap_AS,
  CASE WHEN day(date) BETWEEN 2 AND 11 THEN 1 ELSE 0 END AS snap_EU,
  CASE WHEN day(date) <= 15 AND day(date) % 2 = 1 THEN 1 ELSE 0 END AS snap_MI
FROM cal0""",
    ),
    "daily": (
        ("base",),
        "SELECT store_id, dept_id, day_num, sum(units) AS demand FROM base GROUP BY ALL",
    ),
    "panel_all": (
        ("daily", "calendar"),
        """SELECT s.store_id, s.dept_id, c.day_num, c.date, coalesce(d.demand, 0.0) AS demand
FROM (SELECT DISTINCT store_id, dept_id FROM daily) s CROSS JOIN calendar c
LEFT JOIN daily d ON d.store_id = s.store_id AND d.dept_id = s.dept_id AND d.day_num = c.day_num""",
    ),
    "panel": (("panel_all",), f"SELECT * FROM panel_all WHERE day_num <= {LAST}"),
    "panel_cal": (
        ("panel", "calendar"),
        """SELECT p.*, c.* EXCLUDE (date, day_num) FROM panel p LEFT JOIN calendar c ON p.day_num = c.day_num""",
    ),
    "cells": (
        ("base",),
        """SELECT item_id || '_' || store_id || '_validation' AS id, item_id, dept_id, cat_id, store_id, state_id, day_num,
  sum(units) AS units FROM base GROUP BY ALL""",
    ),
    "series": (
        ("base",),
        """SELECT item_id || '_' || store_id || '_validation' AS id, item_id, dept_id, cat_id, store_id, state_id,
  min(day_num) AS first_day, max(p_retailprice) AS list_price FROM base GROUP BY ALL""",
    ),
    "sales": (
        ("series", "cells", "calendar"),
        f"""SELECT s.id, s.item_id, s.dept_id, s.cat_id, s.store_id, s.state_id, c.d, c.day_num, c.date,
  coalesce(x.units, 0.0) AS sales
FROM series s CROSS JOIN calendar c LEFT JOIN cells x ON x.id = s.id AND x.day_num = c.day_num
WHERE c.day_num <= {LAST}""",
    ),
    "prices": (
        ("series", "calendar"),
        """SELECT s.store_id, s.item_id, w.wm_yr_wk, s.list_price * (1 + w.wm_yr_wk % 4 * 0.05::DOUBLE) AS sell_price
FROM series s JOIN (SELECT DISTINCT wm_yr_wk FROM calendar) w ON w.wm_yr_wk >= (s.first_day + 1) // 7 + 1
WHERE NOT (CAST(right(s.item_id, 3) AS INTEGER) % 10 = 0 AND w.wm_yr_wk % 13 = 0)""",
    ),
    "dollars": (
        ("sales", "calendar", "prices"),
        f"""SELECT s.id, s.item_id, s.dept_id, s.cat_id, s.store_id, s.state_id,
  sum(p.sell_price * s.sales) AS dollar_sales
FROM sales s JOIN calendar c ON c.day_num = s.day_num
JOIN prices p ON p.store_id = s.store_id AND p.item_id = s.item_id AND p.wm_yr_wk = c.wm_yr_wk
WHERE s.day_num BETWEEN {_S.weight_first} AND {LAST}
GROUP BY ALL HAVING count(DISTINCT s.day_num) = {_S.weight_days}""",
    ),
    "weights": (
        ("dollars",),
        """SELECT d.*, g.dept_dollars, d.dollar_sales / nullif(g.dept_dollars, 0) AS weight
FROM dollars d JOIN (SELECT store_id, dept_id, sum(dollar_sales) AS dept_dollars FROM dollars GROUP BY ALL) g
ON g.store_id = d.store_id AND g.dept_id = d.dept_id""",
    ),
    "dept_weights": (
        ("dollars",),
        """SELECT store_id, dept_id, sum(dollar_sales) / (SELECT sum(dollar_sales) FROM dollars) AS dollar_sales
FROM dollars GROUP BY store_id, dept_id""",
    ),
    "naive": (
        ("panel",),
        f"""SELECT store_id, dept_id, day_num + 28 AS day_num, demand AS demand_fcast FROM panel
WHERE day_num + 28 BETWEEN {_S.forecast_first} AND {_S.forecast_last}""",
    ),
    "season": (
        ("panel_cal",),
        """SELECT store_id, dept_id, wday, avg(demand) - any_value(m) AS season
FROM (SELECT *, avg(demand) OVER (PARTITION BY store_id, dept_id) AS m FROM panel_cal) GROUP BY store_id, dept_id, wday""",
    ),
    "levels": (
        ("panel_cal", "season"),
        """SELECT *, level - lag(level) OVER (PARTITION BY store_id, dept_id ORDER BY day_num) AS d_level FROM (
  SELECT p.store_id, p.dept_id, p.day_num, p.wday, p.demand, s.season, p.demand - s.season AS level
  FROM panel_cal p JOIN season s ON s.store_id = p.store_id AND s.dept_id = p.dept_id AND s.wday = p.wday)""",
    ),
}


def with_ctes(body: str, uses: Sequence[str]) -> str:
    needed: list[str] = []

    def visit(name: str) -> None:
        for dep in _CTES[name][0]:
            visit(dep)
        if name not in needed:
            needed.append(name)

    for name in uses:
        visit(name)
    if not needed:
        return body
    # materialized, so a block used twice is computed once
    blocks = ",\n".join(f"fx_{n} AS MATERIALIZED ({_prefixed(_CTES[n][1])})" for n in needed)
    joiner = ",\n" if body.startswith("WITH ") else "\n"
    return f"WITH {blocks}{joiner}{_prefixed(body.removeprefix('WITH '))}"


def _prefixed(sql: str) -> str:
    """Block names are written short in the texts above and get an ``fx_`` prefix as table references."""
    names = "|".join(sorted(_CTES, key=len, reverse=True))
    return re.sub(rf"\b(FROM|JOIN)\s+({names})\b", r"\1 fx_\2", sql)


def query(name: str, sql: str | None = None, uses: Sequence[str] = (), compact: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with its check SQL.

    ``compact`` (``"item"`` or ``"dept"``) hands over tables whose sale lines are
    already written as daily totals, for plans that derive several frames.
    """

    def wrap(fn: Callable[[BoundTables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tables = BoundTables(spark, sf_dir)
            return fn(tables.compacted(compact) if compact else tables)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_ctes(sql, uses)
        return fn

    return wrap
