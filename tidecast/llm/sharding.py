"""Two-pass external shuffle into shards of equal row counts, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of text that one bucket holds in memory while it is shuffled.
BUCKET_BYTES = 16 << 20


def shuffled_shards(
    docs: DataFrame, shards: int = 8, seed: int = 1, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every row with ``shard`` (0 to ``shards`` - 1) and ``slot`` (its place there, gapless from 0) added.

    Pass one scatters rows into buckets by a seeded hash of id and text, as many buckets as keep one within
    ``bucket_bytes`` on average; pass two shuffles each bucket in memory (``shuffle`` is Fisher-Yates) and appends the
    buckets to each other. Shards are equal parts of that order, so their counts differ by one at most (law ``rows``).

    Null text counts as empty. Rows of equal text but other ids scatter; rows that agree in both stay in one bucket.
    Shards may stay empty if there are fewer rows. Columns of ``docs`` named ``shard`` or ``slot`` are replaced.
    """
    bare = docs.drop("shard", "slot")
    size = F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) + 1
    total = docs.agg(F.count("*").alias("rows"), F.sum(size).alias("bytes")).first()
    rows, buckets = total.rows, max(1, -(-(total.bytes or 0) // bucket_bytes))
    place = F.xxhash64(F.lit(seed), F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))
    bucket = F.pmod(place, F.lit(buckets)).cast("int")
    counts = docs.select(bucket.alias("_bucket")).groupBy("_bucket").count()
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    firsts = counts.select("_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    filled = (
        bare.select(F.struct(*[F.col(f"`{c}`") for c in bare.columns]).alias("_row"), bucket.alias("_bucket"), place.alias("_place"))
        .repartitionById(buckets, "_bucket")  # one bucket a task
        .sortWithinPartitions("_bucket", "_place")
        .groupBy("_bucket")
        .agg(F.collect_list("_row").alias("_rows"))
        .select("_bucket", F.posexplode(F.shuffle("_rows", F.lit(seed))).alias("_at", "_row"))
    )
    at = F.col("_first") + F.col("_at")
    shard = F.expr(f"(_g * {shards}) DIV {max(rows, 1)}")
    return (
        filled.join(F.broadcast(firsts), "_bucket")  # one row for each bucket_bytes of text; rows move only once
        .withColumn("_g", at)
        .withColumn("_shard", shard)
        .select(
            *[F.col(f"_row.`{c}`") for c in bare.columns],
            F.col("_shard").cast("int").alias("shard"),
            F.expr(f"_g - (_shard * {rows} + {shards - 1}) DIV {shards}").alias("slot"),
        )
    )


def write_shards(sharded: DataFrame, path: str, files: int) -> None:
    """Write shards as folders ``shard=N`` of Parquet files, each a run of slots in order."""
    sharded.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
