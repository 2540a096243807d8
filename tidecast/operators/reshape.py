"""Wide/long reshaping, day scaffolds and horizon indexes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def melt_days(df: DataFrame, ids: Sequence[str], var: str = "d", value: str = "sales", prefix: str = "d_") -> DataFrame:
    """One row per (id row, day column); null cells are kept.

    The day columns become one array, so the plan is the same however many there are.
    """
    days = [c for c in df.columns if c.startswith(prefix)]
    if not days:
        return df.select(*ids, F.lit(None).cast("string").alias(var), F.lit(None).cast("double").alias(value)).limit(0)
    cells = F.posexplode(F.array(*[F.col(f"`{c}`") for c in days])).alias("_at", value)
    names = F.array(*[F.lit(c) for c in days])
    return df.select(*ids, cells).select(*ids, F.get(names, F.col("_at")).alias(var), value)


def pivot_horizon(df: DataFrame, keys: Sequence[str], step: str, value: str, steps: Sequence) -> DataFrame:
    """One column per step, in the order given; a repeated (keys, step) cell is an error."""
    single = F.when(
        F.count(F.lit(1)) > 1, F.raise_error(F.lit(f"duplicate ({', '.join(keys)}, {step}) in pivot")).cast("double")
    ).otherwise(F.first(value))
    return df.groupBy(*keys).pivot(step, list(steps)).agg(single)


def day_range(first: int, last: int) -> Column:
    return F.explode(F.sequence(F.lit(first), F.lit(last)))


def key_product(df: DataFrame, outer: str, inner: str, buckets: int = 64) -> DataFrame:
    """Every ``outer`` key with every ``inner`` key, pairs never seen together included.

    A replicated equi-join: an ``outer`` key goes to one bucket by its hash, every ``inner`` key to all of them, so each
    pair meets once, no task holds more than its bucket, and the plan has no nested-loop join.
    """
    left = df.select(outer).where(F.col(outer).isNotNull()).distinct()
    left = left.withColumn("_bucket", F.pmod(F.xxhash64(outer), F.lit(buckets)).cast("int"))
    right = df.select(inner).where(F.col(inner).isNotNull()).distinct()
    right = right.select(inner, F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("_bucket"))
    return left.join(right, "_bucket").select(outer, inner)


def scaffold(df: DataFrame, outer: str, inner: str, day: str, first: int, last: int) -> DataFrame:
    """Every ``outer`` key x every ``inner`` key x every day of the range."""
    return key_product(df, outer, inner).select(outer, inner, day_range(first, last).alias(day))


def fill_days(
    df: DataFrame, keys: Sequence[str], day: str, value: str, first: int, last: int, fill: float = 0.0
) -> DataFrame:
    """Make every series daily over ``[first, last]``, missing days set to ``fill``.

    Input holds at most one row per (keys, day). Each row is stretched up to the
    day before its successor, so one window replaces the usual key-by-day
    scaffold and its join, and the input is read once.
    """
    w = W.partitionBy(*keys).orderBy(day)
    d = F.col(day)
    bounds = df.withColumn("_from", F.when(F.lag(day).over(w).isNull(), F.lit(first)).otherwise(d)).withColumn(
        "_to", F.coalesce(F.lead(day).over(w) - 1, F.lit(last))
    )
    clipped = bounds.withColumn("_from", F.greatest("_from", F.lit(first))).withColumn(
        "_to", F.least("_to", F.lit(last))
    )
    carried = [c for c in df.columns if c not in (day, value)]
    stretched = clipped.where(F.col("_from") <= F.col("_to")).select(
        *carried, d.alias("_seen"), value, F.explode(F.sequence("_from", "_to")).alias(day)
    )
    filled = F.when(F.col(day) == F.col("_seen"), F.coalesce(F.col(value), F.lit(fill))).otherwise(F.lit(fill))
    return stretched.select(*carried, day, filled.alias(value))


def horizon_index(origins: DataFrame, origin_day: str, horizon: int, keys: Sequence[str]) -> DataFrame:
    """For each origin the steps 1..horizon and the day each step falls on."""
    return origins.select(
        *keys, F.col(origin_day), F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")
    ).withColumn("day_num", F.col(origin_day) + F.col("step"))


def series_matrix(df: DataFrame, keys: Sequence[str], series: str, value: str, names: Sequence[str]) -> DataFrame:
    """One column per series name, one row per key."""
    return df.groupBy(*keys).pivot(series, list(names)).agg(F.first(value))


def matrix_to_long(
    df: DataFrame, keys: Sequence[str], series: str, value: str, prefix: str = "", suffix: str = ""
) -> DataFrame:
    """Inverse of ``series_matrix``; the series key is recovered from the column name."""
    columns = [c for c in df.columns if c not in keys]
    name = F.expr(f"substring(left(_column, length(_column) - {len(suffix)}), {len(prefix) + 1})")
    return df.unpivot(list(keys), columns, "_column", value).select(*keys, name.alias(series), value)


def union_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Append frames by column name; a column missing on one side becomes null."""
    out = first
    for other in others:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def priced_days(
    cells: DataFrame, prices: DataFrame, weeks: DataFrame, key: Sequence[str], day: str, value: str, price: str, first: int, last: int
) -> DataFrame:
    """Daily rows of every series over ``[first, last]`` on the days that it has a price, ``value`` 0 where nothing sold.

    ``cells`` holds ``key``, ``day`` and ``value`` where something sold, ``prices`` one row a series and week with ``key``,
    the week, ``price`` and columns to carry, ``weeks`` the week's days ``_from`` to ``_to`` (a calendar, so it may be
    broadcast). Sparse cells and weekly prices are brought together by ``key`` once; each row is then stretched to the
    day before the next one or to the end of its price's week. The daily rows come out partitioned by ``key``, so the
    windows of a series behind it need no exchange, and they are never joined.
    """
    week = next(c for c in weeks.columns if c not in ("_from", "_to"))
    carried = [c for c in prices.columns if c not in (*key, week)]
    spells = prices.join(F.broadcast(weeks), week).where((F.col("_to") >= first) & (F.col("_from") <= last))
    spells = spells.select(
        *key,
        F.greatest("_from", F.lit(first)).alias(day),
        F.struct(F.least("_to", F.lit(last)).alias("_to"), *carried).alias("_spell"),
    )
    sold = cells.where(F.col(day).between(first, last)).select(*key, day, value)
    rows = spells.unionByName(sold, allowMissingColumns=True).repartition(*key)
    rows = rows.groupBy(*key, day).agg(F.first("_spell", ignorenulls=True).alias("_spell"), F.sum(value).alias(value))
    own = W.partitionBy(*key).orderBy(day)
    until = own.rowsBetween(W.unboundedPreceding, W.currentRow)
    runs = rows.withColumns({"_spell": F.last("_spell", ignorenulls=True).over(until), "_next": F.lead(day).over(own)})
    ends = F.least(F.col("_spell._to"), F.coalesce(F.col("_next") - 1, F.col("_spell._to")))
    runs = runs.where(F.col(day) <= F.col("_spell._to"))
    stretched = runs.select(*key, F.col(day).alias("_seen"), value, "_spell", F.explode(F.sequence(F.col(day), ends)).alias(day))
    filled = F.when(F.col(day) == F.col("_seen"), F.coalesce(F.col(value), F.lit(0.0))).otherwise(F.lit(0.0))
    return stretched.select(*key, *[F.col(f"_spell.`{c}`").alias(c) for c in carried], day, filled.alias(value))
