"""Type narrowing, categorical codes, and categories as numbers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.operators.rank import numbered
from tidecast.operators.split import key_digest
from tidecast.session import materialize

# Strict bounds of the integer types, smallest first.
INTEGER_TYPES = (
    ("tinyint", -(2**7), 2**7 - 1),
    ("smallint", -(2**15), 2**15 - 1),
    ("int", -(2**31), 2**31 - 1),
    ("bigint", -(2**63), 2**63 - 1),
)
FLOAT_MAX = 3.4028234663852886e38


def narrowed_type(dtype: T.DataType, low, high, floats: bool = False) -> str:
    """Smallest type whose open bounds contain ``[low, high]``."""
    current = dtype.simpleString()
    if low is None:
        return current
    if isinstance(dtype, T.IntegralType):
        return next((name for name, lo, hi in INTEGER_TYPES if lo < low and high < hi), current)
    if floats and -FLOAT_MAX < low and high < FLOAT_MAX:
        return "float"
    return current


def numeric_fields(df: DataFrame) -> list[T.StructField]:
    plain = (T.IntegralType, T.FloatType, T.DoubleType)
    return [f for f in df.schema.fields if isinstance(f.dataType, plain)]


def column_ranges(df: DataFrame) -> DataFrame:
    """Minimum and maximum of every numeric column, in one aggregation."""
    fields = numeric_fields(df)
    return df.agg(*[g(f.name).alias(f"{p}_{f.name}") for f in fields for p, g in (("min", F.min), ("max", F.max))])


def narrow_numeric_types(df: DataFrame, floats: bool = False) -> DataFrame:
    """Cast each numeric column to the narrowest type that holds its values."""
    row = column_ranges(df).first()
    casts = {
        f.name: F.col(f.name).cast(narrowed_type(f.dataType, row[f"min_{f.name}"], row[f"max_{f.name}"], floats))
        for f in numeric_fields(df)
    }
    return df.withColumns(casts) if casts else df


def dictionary(df: DataFrame, column: str, code: str) -> DataFrame:
    """Distinct values of ``column`` and their sorted codes from 0; a null sorts first.

    Values are ranked across range partitions (``rank.numbered``), so a dictionary of any length is spread over the tasks.
    """
    ranked = numbered(df.select(column).distinct(), [column], "_rank")
    return ranked.select(column, F.col("_rank").cast("int").alias(code))


def category_codes(df: DataFrame, columns: Sequence[str], suffix: str = "_code") -> DataFrame:
    """Rank codes within the frame itself: nulls get 0 and shift the others by one."""
    out = df
    for c in columns:
        codes = dictionary(df, c, f"{c}{suffix}").withColumnRenamed(c, "_value")
        out = out.join(codes, F.col(c).eqNullSafe(F.col("_value")), "left").drop("_value")
    return out


def fit_codes(df: DataFrame, columns: Sequence[str]) -> dict[str, DataFrame]:
    """Learn one dictionary per column."""
    return {c: dictionary(df, c, "code") for c in columns}


def apply_codes(
    df: DataFrame, codes: dict[str, DataFrame], on_unseen: str = "error", suffix: str = "_code"
) -> DataFrame:
    """Encode with dictionaries learned elsewhere; an unseen label raises or becomes null."""
    if on_unseen not in ("error", "null"):
        raise ValueError("on_unseen must be 'error' or 'null'")
    out = df
    for c, table in codes.items():
        renamed = table.select(F.col(c).alias("_value"), F.col("code").alias("_code"))
        out = out.join(renamed, F.col(c).eqNullSafe(F.col("_value")), "left")
        code = F.col("_code")
        if on_unseen == "error":
            message = F.concat(F.lit(f"unseen label in {c}: "), F.coalesce(F.col(c).cast("string"), F.lit("null")))
            code = F.when(code.isNull(), F.raise_error(message).cast("int")).otherwise(code)
        out = out.withColumn(f"{c}{suffix}", code).drop("_value", "_code")
    return out


@dataclass
class TargetMeans:
    """Smoothed mean label of every category, with what each fold of the training rows adds to it.

    ``table`` holds one row a category: ``n``, ``s`` and ``by_fold``, a map from fold to its part of both.
    """

    column: str
    key: list[str]
    folds: int
    seed: int
    prior: float
    table: DataFrame
    totals: dict[int, tuple[int, float]]

    def _mean(self, without: int | None = None) -> float:
        left = [v for f, v in self.totals.items() if f != without] or list(self.totals.values())
        n = sum(v[0] for v in left)
        return sum(v[1] for v in left) / n if n else 0.0

    def encode(self, df: DataFrame, name: str, trained: Column | bool = False) -> DataFrame:
        """Add ``name``: ``(s + prior m) / (n + prior)`` with the mean ``m`` of all labels; an unseen category gets ``m``.

        A row for which ``trained`` holds was one of the training rows: its own fold is left out of ``n``, ``s`` and
        ``m``, so that no label enters its own feature.
        """
        trained = F.lit(trained) if isinstance(trained, bool) else trained
        held = self.table.withColumnRenamed(self.column, "_value")
        fold = F.when(trained, fold_of(self.key, self.folds, self.seed))
        joined = df.withColumn("_fold", fold).join(held, F.col(self.column).eqNullSafe(F.col("_value")), "left")
        own = F.try_element_at("_by_fold", F.col("_fold"))
        n = F.coalesce("_n", F.lit(0)) - F.coalesce(own["n"], F.lit(0))
        s = F.coalesce("_s", F.lit(0.0)) - F.coalesce(own["s"], F.lit(0.0))
        means = F.array(*[F.lit(self._mean(f)) for f in range(self.folds)])
        mean = F.coalesce(F.get(means, F.col("_fold")), F.lit(self._mean()))
        encoded = (s + self.prior * mean) / (n + self.prior)
        return joined.withColumn(name, encoded).drop("_value", "_n", "_s", "_by_fold", "_fold")


def fold_of(key: Sequence[str], folds: int, seed: int = 64) -> Column:
    """Fold of a row, from the digest of its key."""
    return F.pmod(F.conv(F.substring(key_digest(key, seed), 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int")


def fit_target_means(
    df: DataFrame, column: str, label: str, key: Sequence[str], *, folds: int = 5, seed: int = 64, prior: float = 20.0
) -> TargetMeans:
    """Learn the mean label of every category of ``column`` by folds of the rows' keys, in two aggregations.

    Labels that are null count for nothing. There is no list of categories anywhere but in the table itself; the driver
    sees one total a fold.
    """
    sums = [F.count(label).alias("n"), F.coalesce(F.sum(F.col(label).cast("double")), F.lit(0.0)).alias("s")]
    cells = materialize(df.groupBy(column, fold_of(key, folds, seed).alias("fold")).agg(*sums), "fold-sums")
    totals = {r.fold: (r.n, r.s) for r in cells.groupBy("fold").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()}
    table = cells.groupBy(column).agg(
        F.sum("n").alias("_n"),
        F.sum("s").alias("_s"),
        F.map_from_entries(F.collect_list(F.struct("fold", F.struct("n", "s")))).alias("_by_fold"),
    )
    return TargetMeans(column, list(key), folds, seed, prior, table, totals)
