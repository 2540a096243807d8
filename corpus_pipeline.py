"""From raw documents to packed sequences: STAGES in order, each written as Parquet and read again by the next one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm import quality
from tidecast.llm.decontaminate import contamination
from tidecast.llm.ngram_join import one_of_each
from tidecast.llm.packing import pack
from tidecast.llm.suffix_dedup import remove_repeats, whole_characters
from tidecast.llm.tables import read_table
from tidecast.session import materialize



def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that keep all rules."""
    out = quality.judge(docs.withColumnsRenamed({c: f"_own_{c}" for c in docs.columns if c in quality.ADDED})).where("kept")
    return out.select(*[F.col(f"_own_{c}" if c in quality.ADDED else f"`{c}`").alias(c) for c in docs.columns])


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    return one_of_each(docs, size=5, percent=80)


#: Bytes that two places have to share for the stage to cut them: fewer than the shortest passage of 50 words is long.
PASSAGE_BYTES, PASSAGE_GRAM = 256, 96


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of strings of ``PASSAGE_BYTES`` that occur more than once.

    A passage of over 50 words is longer than that in the languages at hand (the shortest in the test tables has 285
    bytes), so what is cut holds all of it. A cut may fall inside a character; what is left of it goes, too. ``n_chars``
    follows the text. Documents of which nothing is left stay as empty ones.
    """
    own = docs.withColumnsRenamed({c: f"_own_{c}" for c in docs.columns if c in ("removed", "kept")})
    out = remove_repeats(own, window=PASSAGE_BYTES, gram=PASSAGE_GRAM)
    out = out.withColumn("text", F.when(F.size("removed") > 0, whole_characters(F.col("kept"))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        changed = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.size("removed") > 0, changed).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"_own_{c}" if c in ("removed", "kept") else f"`{c}`").alias(c) for c in docs.columns])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    added = ("n_words", "hit", "items")
    out = contamination(docs.withColumnsRenamed({c: f"_own_{c}" for c in docs.columns if c in added}), read_table(spark, sf_dir, "benchmark"))
    return out.where("size(hit) = 0").select(*[F.col(f"_own_{c}" if c in added else f"`{c}`").alias(c) for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents and their places in sequences of 4096 tokens."""
    out = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("suffix-array dedup", suffix_array_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

#: Byte strings of one document in another and token ids are beyond SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
