"""Places in a sorted order, found without bringing the rows together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidecast.session import materialize


def numbered(df: DataFrame, order: Sequence[str], name: str, by: Sequence[str] = (), descending: Sequence[str] = ()) -> DataFrame:
    """Add ``name``: places from 0 in the order of the columns ``order``, within each value of ``by``; nulls come first.

    Rows are sorted across partitions by range, so a partition knows the places of its rows up to the number of rows in
    the partitions before it. Those counts, one row for each partition and each value of ``by`` in it, are summed and
    joined back: no task sees more than its share of the rows, however many there are. ``order`` (with ``by``) should
    name rows uniquely; rows that tie share out their places in any way. The sorted rows are written once, so that a
    lost executor cannot place them anew.
    """
    keys = [F.col(c).asc_nulls_first() for c in by]
    keys += [F.col(c).desc_nulls_last() if c in descending else F.col(c).asc_nulls_first() for c in order]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = materialize(placed.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    runs = placed.groupBy(*by, part.alias("_part")).agg(F.min("_at").alias("_low"), F.count("*").alias("_rows"))
    before = F.sum("_rows").over(W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    runs = runs.withColumn("_base", F.coalesce(before, F.lit(0)) - F.col("_low"))
    same = [F.col(f"p.`{c}`").eqNullSafe(F.col(f"r.`{c}`")) for c in by]
    joined = placed.withColumn("_part", part).alias("p").join(runs.alias("r"), [F.col("p._part") == F.col("r._part"), *same])
    return joined.select(*[F.col(f"p.`{c}`") for c in df.columns], (F.col("p._at") + F.col("r._base")).alias(name))
