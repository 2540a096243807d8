"""Train/validation splits: blocked windows, forecast origins and fixed-size hash samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.functions.scalars import valid_window_number
from tidecast.session import materialize


def blocked_split(
    df: DataFrame, day: str, windows: Sequence[tuple[int, int]]
) -> tuple[DataFrame, DataFrame]:
    """Rows outside all windows (later days included) and rows inside one of them."""
    number = valid_window_number(F.col(day), windows)
    tagged = df.withColumn("valid_window", number)
    return tagged.where(F.col("valid_window") == 0).drop("valid_window"), tagged.where(F.col("valid_window") > 0)


def origin_split(
    df: DataFrame, origin: str, day: str, last_origin: int, windows: Sequence[tuple[int, int]]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Training rows, validation rows and the validation rows that get scored.

    Training takes origins up to ``last_origin`` and days outside the windows;
    scoring only looks at origins that open a window.
    """
    train, valid = blocked_split(df, day, windows)
    starts = [first for first, _ in windows]
    return train.where(F.col(origin) <= last_origin), valid, valid.where(F.col(origin).isin(starts))


def key_digest(key: Sequence[str], seed: int):
    """Hex digest of a row's business key: the random order of the sample."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed))).cast("binary"))


#: Hex digits of the digest that one step of the selection looks at, as many counters as ``16 ** DIGITS``.
DIGITS = 4


def nth_digest(digests: DataFrame, n: int) -> str | None:
    """The least prefix that parts the ``n`` smallest of unique hex digests from the others; None for fewer than ``n``.

    Radix selection: count the digests by their next digits, follow the value that holds the n-th one, and look at the
    digits behind it in the rows of that value only, until the prefix holds no row behind the n-th one.
    Nothing is sorted or ranked; the driver sees at most ``16 ** DIGITS`` counters a step.
    """
    prefix, left = "", n
    while len(prefix) < 32:
        step = F.substring("_digest", len(prefix) + 1, DIGITS).alias("_next")
        sizes = sorted((r._next, r["count"]) for r in digests.groupBy(step).count().collect())
        for value, size in sizes:
            if size >= left:
                break
            left -= size
        else:
            return None
        prefix += value
        if size == left:
            return prefix
        digests = materialize(digests.where(F.col("_digest").startswith(prefix)), "digests")
    return prefix


def sample_flag(df: DataFrame, key: Sequence[str], n: int, seed: int = 64, name: str = "held") -> DataFrame:
    """Mark exactly ``n`` random rows, without a sort.

    Rows are ordered by the digest of their unique key; the n-th smallest digest
    is the cut (``nth_digest``) and each row is then placed by a plain
    comparison. The result does not depend on partitioning.
    """
    if n <= 0:
        return df.withColumn(name, F.lit(False))
    digest = key_digest(key, seed)
    cut = nth_digest(df.select(digest.alias("_digest")), n)
    # a cut that is a prefix takes in all digests that begin with it
    return df.withColumn(name, F.lit(True) if cut is None else F.substring(digest, 1, len(cut)) <= cut)


def sample_holdout(df: DataFrame, key: Sequence[str], n: int, seed: int = 64) -> tuple[DataFrame, DataFrame]:
    """``(train, holdout)`` with exactly ``n`` random holdout rows; see ``sample_flag``."""
    marked = sample_flag(df, key, n, seed, "_held")
    return marked.where(~F.col("_held")).drop("_held"), marked.where("_held").drop("_held")


def without(df: DataFrame, other: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key does not occur in ``other``."""
    return df.join(other.select(*key), list(key), "left_anti")
