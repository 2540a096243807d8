"""A daily fact laid out for the windows and day ranges of its series."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def month_number(when: Column | date):
    """Months since the year 0, of a date or a date column."""
    if isinstance(when, date):
        return when.year * 12 + when.month - 1
    return F.year(when) * 12 + F.month(when) - 1


@dataclass(frozen=True)
class ClusteredFact:
    """A table partitioned by month, bucketed and sorted by series.

    A day range reads the folders of its months only. All rows of a series lie in one bucket, so windows, aggregates and
    joins by the series need no exchange. The table lives in the session's catalog and warehouse until ``drop``.
    """

    spark: SparkSession
    name: str
    key: tuple[str, ...]
    date: str

    @classmethod
    def write(cls, rows: DataFrame, key: Sequence[str], date: str, buckets: int) -> ClusteredFact:
        """``rows`` by series ``key`` and ``date`` column; ``buckets`` is as many tasks as a scan of the series gets."""
        spark, name = rows.sparkSession, f"clustered_{uuid.uuid4().hex}"
        placed = rows.withColumn("month_no", month_number(F.col(date))).repartition(buckets, *key)
        writer = placed.write.partitionBy("month_no").bucketBy(buckets, *key).sortBy(*key, date)
        writer.format("parquet").saveAsTable(name)
        return cls(spark, name, tuple(key), date)

    def range(self, first: date, last: date) -> DataFrame:
        """Rows of the days ``first`` to ``last``."""
        months = F.col("month_no").between(month_number(first), month_number(last))
        days = F.col(self.date).between(F.lit(first), F.lit(last))
        return self.spark.table(self.name).where(months & days).drop("month_no")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
