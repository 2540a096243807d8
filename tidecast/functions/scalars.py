"""Scalar expressions over ids, day labels, dates and events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Event types that get a dummy column; the remaining level is the base.
EVENT_TYPES = ("Cultural", "National", "Religious", "Sporting")
# Months that get a dummy column; January is the base.
DUMMY_MONTHS = tuple(range(2, 13))


def day_ordinal(label: Column) -> Column:
    """``d_17`` -> 17."""
    return F.split_part(label, F.lit("_"), F.lit(2)).cast("int")


def day_label(day_num: Column) -> Column:
    return F.concat(F.lit("d_"), day_num.cast("string"))


def step_label(step: Column) -> Column:
    return F.concat(F.lit("F"), step.cast("string"))


def series_id_parts(series_id: Column) -> dict[str, Column]:
    """Keys encoded in ``<cat>_<n>_<item>_<state>_<n>_<phase>``."""
    p = F.split(series_id, "_")
    at = [p.getItem(i) for i in range(6)]
    return {
        "item_id": F.concat_ws("_", at[0], at[1], at[2]),
        "dept_id": F.concat_ws("_", at[0], at[1]),
        "cat_id": at[0],
        "store_id": F.concat_ws("_", at[3], at[4]),
        "state_id": at[3],
        "phase": at[5],
    }


def snap_flag(store_id: Column, flags: dict[str, Column]) -> Column:
    """The flag of the store's own state; 0 when no state matches."""
    state = F.substring(store_id, 1, 2)
    out: Column | None = None
    for code, flag in flags.items():
        out = F.when(state == code, flag) if out is None else out.when(state == code, flag)
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def valid_window_number(day_num: Column, windows: Sequence[tuple[int, int]]) -> Column:
    """1 for the first listed window, 2 for the next one, 0 outside all of them."""
    out: Column | None = None
    for number, (first, last) in enumerate(windows, start=1):
        hit = day_num.between(first, last)
        out = F.when(hit, F.lit(number)) if out is None else out.when(hit, F.lit(number))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def date_features(date: Column, wday: Column | None = None) -> dict[str, Column]:
    """Calendar features of a date; ``wday`` keeps the calendar's own weekday when there is one."""
    return {
        "wday": (F.weekday(date) if wday is None else wday).cast("smallint"),
        "week": F.weekofyear(date).cast("smallint"),
        "month": F.month(date).cast("smallint"),
        "quarter": F.quarter(date).cast("smallint"),
        "year": F.year(date).cast("smallint"),
        "mday": F.dayofmonth(date).cast("smallint"),
    }


def level_dummy(value: Column, level: str | int) -> Column:
    """1.0 where ``value`` equals ``level`` and 0.0 elsewhere, nulls included."""
    return F.when(value == level, F.lit(1.0)).otherwise(F.lit(0.0))


def month_dummies(month: Column) -> dict[str, Column]:
    return {f"month_{m}": level_dummy(month, m) for m in DUMMY_MONTHS}


def event_dummies(event_type: Column, prefix: str = "") -> dict[str, Column]:
    return {f"{prefix}event_type_{e}": level_dummy(event_type, e) for e in EVENT_TYPES}


def ratio(num: Column, den: Column) -> Column:
    """Division that yields null for a zero denominator instead of failing."""
    return F.try_divide(num, den)
