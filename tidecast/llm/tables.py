"""Reading the text tables, identifying rows, and small column helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters of ``[\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(_id, _h, _text)``: the id, a digest of the text that tells rows of one id apart, the text (null: empty).

    ``(_id, _h)`` names a row in joins. Rows that agree in id and text share a name and get the same result;
    rows of one id with other texts stay documents of their own.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text).alias("_h"), text.alias("_text"))


def boxed(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one, so that columns added for a while cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")


def unboxed(docs: DataFrame) -> list[Column]:
    return [F.col(f"_row.`{c}`").alias(c) for c in docs.columns]


def same_row(a: str, b: str) -> Column:
    """Join condition on the row names of the aliases ``a`` and ``b``; a null id equals a null id."""
    return F.col(f"{a}._id").eqNullSafe(F.col(f"{b}._id")) & (F.col(f"{a}._h") == F.col(f"{b}._h"))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The (UTF-8) bytes of a string or binary column without nulls, and where each value starts (one more entry: the end)."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), starts.astype(np.int64)


def blocks(starts: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Cut rows into runs ``[a, b)`` of about ``limit`` bytes; a longer row makes a run of its own."""
    a = 0
    while a < len(starts) - 1:
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + limit, side="right")) - 1)
        yield a, b
        a = b


def sieve(keys: DataFrame, key: str, bits: int = 24) -> DataFrame:
    """A bitmap of 64-bit keys as rows ``(_word, _bits)``: at most ``2 ** (bits - 6)`` of them, whatever the input."""
    slot = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    return (
        keys.select(F.shiftright(slot, 6).alias("_word"), F.expr(f"shiftleft(1L, CAST(pmod(xxhash64({key}), 64) AS INT))").alias("_bits"))
        .groupBy("_word")
        .agg(F.bit_or("_bits").alias("_bits"))
    )


def sifted(rows: DataFrame, key: str, bitmap: DataFrame, bits: int = 24) -> DataFrame:
    """``rows`` with ``_maybe``: false only where the key is surely not among those of the bitmap.

    The bitmap is broadcast: its size is bounded by ``sieve``. A full bitmap lets everything through, so it only saves
    work; what uses it has to decide exactly afterwards.
    """
    named = rows.withColumn("_slot", F.pmod(F.xxhash64(key), F.lit(1 << bits)))
    joined = named.join(F.broadcast(bitmap), F.shiftright("_slot", 6) == F.col("_word"), "left")
    maybe = F.expr("_bits IS NOT NULL AND (shiftright(_bits, CAST(pmod(_slot, 64) AS INT)) & 1L) = 1L")
    return joined.withColumn("_maybe", maybe).drop("_slot", "_word", "_bits")
