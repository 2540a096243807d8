"""Features known ahead of time: calendar columns, events and their leads, benefit days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.functions import scalars as S
from tidecast.sources.binding import BoundTables

EVENTS = ("event_name_1", "event_type_1", "event_name_2", "event_type_2")
LEADS = (1, 2, 3)
LEAD_EVENTS = tuple(f"L{n}_{c}" for n in LEADS for c in ("event_type_1", "event_name_1"))


def calendar_features(t: BoundTables) -> DataFrame:
    """The calendar with event leads and date parts; one row per day, so it may be broadcast."""
    cal = t.calendar
    base = cal
    for n in LEADS:
        ahead = base.select(
            (F.col("day_num") - n).alias("day_num"),
            F.col("event_type_1").alias(f"L{n}_event_type_1"),
            F.col("event_name_1").alias(f"L{n}_event_name_1"),
        )
        cal = cal.join(F.broadcast(ahead), "day_num", "left")
    parts = S.date_features(F.col("date"), F.col("wday"))
    # keep the calendar's own month and year columns, add what it lacks
    extra = {k: parts[k].cast("int") for k in ("week", "quarter", "mday")}
    return cal.withColumns(extra).na.fill("none", [*EVENTS, *LEAD_EVENTS])


def _with_days(df: DataFrame, days: DataFrame) -> DataFrame:
    """Join calendar rows on ``day_num``; a day that the calendar does not hold is an error."""
    joined = df.join(F.broadcast(days.withColumn("_held", F.lit(True))), "day_num", "left")
    missing = F.raise_error(F.concat(F.lit("the calendar has no day "), F.col("day_num").cast("string"))).cast("int")
    return joined.withColumn("day_num", F.when(F.col("_held").isNull(), missing).otherwise(F.col("day_num"))).drop("_held")


def add_known(df: DataFrame, t: BoundTables, *columns: str) -> DataFrame:
    """Join calendar features on ``day_num``; ``snap`` is the flag of the store's own state."""
    joined = _with_days(df, calendar_features(t).drop("date"))
    joined = joined.withColumn("snap", t.snap(F.col("store_id")).cast("string"))
    return joined.select(*df.columns, *[c for c in columns if c not in df.columns])


def exog_names() -> list[str]:
    names = [f"event_type_{e}" for e in S.EVENT_TYPES]
    names += [f"L{n}_event_type_{e}" for n in LEADS for e in S.EVENT_TYPES]
    return [*names, "snap", *[f"month_{m}" for m in S.DUMMY_MONTHS]]


def add_exog_array(df: DataFrame, t: BoundTables) -> DataFrame:
    """``exog``: event-type dummies at leads 0..3, the benefit flag and month dummies, as one array."""
    cal = calendar_features(t)
    dummies = S.event_dummies(F.col("event_type_1"))
    for n in LEADS:
        dummies |= S.event_dummies(F.col(f"L{n}_event_type_1"), f"L{n}_")
    months = S.month_dummies(F.col("month"))
    flags = [f"snap_{s}" for s in t.study.states]
    days = cal.select(
        "day_num", F.array(*dummies.values()).alias("_events"), F.array(*months.values()).alias("_months"), *flags
    )
    snap = F.array(t.snap(F.col("store_id")).cast("double"))
    joined = _with_days(df, days)
    return joined.withColumn("exog", F.concat("_events", snap, "_months")).select(*df.columns, "exog")
