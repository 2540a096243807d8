"""Removal of word windows that an earlier document has, by super-k-mer partitioning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.minimizers import WordIds, gram_ids, runs
from tidecast.llm.suffix_dedup import merged
from tidecast.llm.tables import boxed, keyed, same_row, sieve, sifted, text_bytes, unboxed
from tidecast.session import materialize

#: Words whose windows are grouped together inside a task.
BLOCK = 1 << 16
#: Neighbouring windows that travel in one packed string.
CLASS = 8

_RUNS = "_id long, _h long, lo int, n int, off int, bucket long, content long"
_PACKED = "_id long, _h long, core int, class int, first int, last int, c1 long, c2 long, lead int, packed string"
#: Null ids come before all others.
_RANK = f"coalesce(_id, {-(2**63) + 1} - 1)"


def _scan(window: int, gram: int):
    """Super-k-mers of every text: runs of windows that share a minimiser, with the identifier of their words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordIds()

        def found(batch: pa.RecordBatch, rows: list[int], at: list[int], parts: list[np.ndarray]) -> pa.RecordBatch | None:
            units = np.concatenate(parts)
            cuts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            ids = gram_ids(units, gram)
            first, last, place, owner = runs(ids, cuts, gram, window)
            if not len(first):
                return None
            view = memoryview(units)
            content = [xxhash.xxh3_64_intdigest(view[a : b + window]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
            row = pa.array(np.array(rows)[owner])
            lo = first - cuts[owner] + np.array(at)[owner]
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(row), batch.column(1).take(row)]
                + [pa.array(x.astype(np.int32)) for x in (lo, last - first + 1, place - first)]
                + [pa.array(ids[place].view(np.int64)), pa.array(np.array(content, np.uint64).view(np.int64))],
                names=["_id", "_h", "lo", "n", "off", "bucket", "content"],
            )

        for batch in batches:
            data, starts = text_bytes(batch.column(2))
            rows, at, parts, size = [], [], [], 0
            for i in range(len(batch)):
                words = data[starts[i] : starts[i + 1]].tobytes().split()
                if len(words) < window:
                    continue
                units = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
                # a long text goes in pieces that overlap, so that every window is whole in one of them
                for begin in range(0, len(units) - window + 1, BLOCK):
                    part = units[begin : begin + BLOCK + window - 1]
                    rows, at, parts, size = [*rows, i], [*at, begin], [*parts, part], size + len(part)
                    if size >= BLOCK:
                        if (out := found(batch, rows, at, parts)) is not None:
                            yield out
                        rows, at, parts, size = [], [], [], 0
            if parts and (out := found(batch, rows, at, parts)) is not None:
                yield out

    return scan


def _pack(window: int):
    """The packed strings of runs: ``CLASS`` neighbouring windows each, with the words that all of them share as key."""
    length = window - CLASS + 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_bytes(batch.column(2))
            rows, keys, packed = [], [], []
            for i, found in enumerate(batch.column(3).to_pylist()):
                words = data[starts[i] : starts[i + 1]].tobytes().split()
                for run in found:
                    place, most = run["lo"] + run["off"], run["off"]
                    least = most - run["n"] + 1
                    for c in range(least // CLASS, most // CLASS + 1):
                        core = place - c * CLASS
                        before = max(0, core - CLASS + 1)
                        keys.append(xxhash.xxh3_128_digest(b" ".join(words[core : core + length])))
                        packed.append(b" ".join(words[before : core + length + CLASS - 1]))
                        inside = (max(least, c * CLASS), min(most, c * CLASS + CLASS - 1))
                        rows.append((i, core, c, *inside, core - before))
            if rows:
                i, core, c, first, last, lead = (list(x) for x in zip(*rows, strict=True))
                digest = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(i)), batch.column(1).take(pa.array(i))]
                    + [pa.array(x, pa.int32()) for x in (core, c, first, last)]
                    + [pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(lead, pa.int32())]
                    + [pa.array(packed, pa.binary()).cast(pa.string())],
                    names=["_id", "_h", "core", "class", "first", "last", "c1", "c2", "lead", "packed"],
                )

    return pack


def covered_words(docs: DataFrame, window: int = 50, gram: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words in ``window``-word windows that also start in a document of smaller id: ``(_id, _h, spans)``.

    ``spans`` holds the maximal runs ``(lo, hi)`` of word places, ``hi`` not included; texts without any have no row.

    Windows that choose the same minimiser travel together as one super-k-mer. Equal super-k-mers are reduced to the
    smallest id that has them before the shuffle, which settles every later copy. Only buckets that hold several
    contents go on: there the first owners' windows travel as packed strings, keyed by the words that all windows of a
    string share, so that no bucket outgrows a task; shared keys are unpacked and their windows sorted and counted.
    """
    if not CLASS < gram <= window - CLASS:
        raise ValueError(f"gram has to lie between {CLASS} and {window - CLASS}")
    texts = keyed(docs, id_col, text_col)
    found = materialize(texts.mapInArrow(_scan(window, gram), _RUNS), "superkmers")
    owners = [F.expr(f"min({_RANK})").alias("owner"), F.expr(f"max({_RANK})").alias("latest")]
    buckets = materialize(
        found.groupBy("bucket")
        .agg(*owners, F.min("content").alias("a"), F.max("content").alias("b"))
        .where("owner < latest")
        .selectExpr("bucket", "owner", "a < b AS mixed"),
        "buckets",
    )
    again = sifted(found, "bucket", sieve(buckets, "bucket")).where("_maybe").drop("_maybe").join(buckets, "bucket")
    again = materialize(again, "again")
    span = ["_id", "_h", "lo", f"lo + n + {window - 1} AS hi"]
    whole = again.where(f"NOT mixed AND {_RANK} > owner").selectExpr(*span)
    mixed = again.where("mixed").drop("owner")
    # both sides of the join are tables, so that Spark can split a content that very many documents have
    contents = materialize(mixed.groupBy("bucket", "content").agg(*owners), "contents")
    mixed = materialize(mixed.join(contents, ["bucket", "content"]), "owned")
    later = mixed.where(f"{_RANK} > owner").selectExpr(*span)
    own = mixed.where(f"{_RANK} = owner")
    firsts = own.groupBy("_id", "_h").agg(F.collect_list(F.struct("lo", "n", "off")).alias("found"))
    wanted = sifted(texts, "_h", sieve(own, "_h")).where("_maybe")
    packed = (
        wanted.alias("t")
        .join(firsts.alias("k"), same_row("t", "k"))
        .select("t._id", "t._h", "_text", "found")
        .mapInArrow(_pack(window), _PACKED)
    )
    packed = materialize(packed, "packed")
    key = ["class", "c1", "c2"]
    shared = packed.groupBy(*key).agg(F.expr(f"min({_RANK})").alias("a"), F.expr(f"max({_RANK})").alias("b")).where("a < b").select(*key)
    words = F.expr(f"array_join(slice(words, lead - (d - class * {CLASS}) + 1, {window}), ' ')")
    windows = (
        packed.join(shared, key, "left_semi")
        .withColumn("words", F.split("packed", " "))
        .withColumn("d", F.explode(F.sequence("first", "last")))
        .withColumn("window", words)
        .select(
            "_id",
            "_h",
            F.expr(f"core - (d - class * {CLASS})").alias("lo"),
            F.xxhash64("window").alias("w1"),
            F.xxhash64(F.lit(1), "window").alias("w2"),
        )
    )
    windows = materialize(windows, "windows")
    earliest = windows.groupBy("w1", "w2").agg(*owners).where("owner < latest")
    single = (
        windows.join(earliest.select("w1", "w2", "owner"), ["w1", "w2"])
        .where(f"{_RANK} > owner")
        .selectExpr("_id", "_h", "lo", f"lo + {window} AS hi")
    )
    return merged(whole.unionByName(later).unionByName(single))


def remove_windows(docs: DataFrame, window: int = 50, gram: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with ``words`` (how many it had), ``removed`` (runs ``(lo, hi)`` of words) and ``kept`` (text) added.

    ``kept`` joins the remaining words by one space. Null text has no words; texts shorter than ``window`` keep all;
    rows of one id never remove words from each other, and a null id is smaller than all others. Columns of ``docs``
    named like the added ones are replaced. An empty table gives an empty result.
    """
    spans = covered_words(docs, window, gram, id_col, text_col)
    bare = docs.drop("words", "removed", "kept")
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = bare.select(boxed(bare), F.col(id_col).cast("long").alias("_id"), F.xxhash64(text).alias("_h"))
    words = F.expr(f"filter(split(coalesce(_row.`{text_col}`, ''), '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w != '')")
    spans = materialize(spans, "spans")
    named = sifted(named, "_h", sieve(spans, "_h"))
    # only texts that may have lost words are shuffled
    touched = named.where("_maybe").alias("n").join(spans.alias("s"), same_row("n", "s"), "left")
    none = F.array().cast("array<struct<lo:int,hi:int>>")
    joined = touched.select("_row", "spans").unionByName(named.where("NOT _maybe").select("_row", none.alias("spans")))
    joined = joined.withColumn("_words", words)
    kept = F.expr(
        """CASE WHEN coalesce(size(spans), 0) <= 0 THEN array_join(_words, ' ') ELSE array_join(flatten(transform(
             sequence(0, size(spans)),
             i -> slice(_words, if(i = 0, 0, spans[i - 1].hi) + 1,
               if(i = size(spans), size(_words), spans[i].lo) - if(i = 0, 0, spans[i - 1].hi)))), ' ') END"""
    )
    return joined.select(
        *unboxed(bare),
        F.size("_words").cast("long").alias("words"),
        F.coalesce("spans", none).alias("removed"),
        kept.alias("kept"),
    )
