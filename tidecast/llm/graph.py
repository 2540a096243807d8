"""Connected components over edges of any number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """``(v, root)`` for every end of the edges ``(a, b)``, ``root`` being the smallest end reachable.

    Every round, each root hooks onto the smallest root beside it and all paths are halved, so rounds grow with the
    logarithm of the longest path. Only counts of changes reach the driver; each round's labels are written, which cuts
    the lineage, and minima are taken before the shuffle, so that a node of very many edges is no burden.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("v"), F.least("a", "b").alias("root"))
    labels = materialize(labels, "labels")
    while True:
        beside = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy("a").agg(F.min("root").alias("low"))
        beside = labels.join(beside.withColumnRenamed("a", "v"), "v").where("low < root")
        hooks = beside.groupBy("root").agg(F.min("low").alias("low"))  # of roots
        hooks = materialize(hooks, "hooks")
        if hooks.isEmpty():
            return labels
        moved = labels.join(hooks, "root", "left").select("v", F.least("root", F.coalesce("low", "root")).alias("root"))
        moved = materialize(moved, "moved")
        above = moved.select(F.col("v").alias("root"), F.col("root").alias("above"))
        labels = moved.join(above, "root", "left").select("v", F.least("root", F.coalesce("above", "root")).alias("root"))
        labels = materialize(labels, "labels")
