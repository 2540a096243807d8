"""Exact removal of long repeated byte strings: windows bucketed by a shared q-gram, buckets refined by content."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidecast.llm.minimizers import BYTE_IDS, gram_ids, runs
from tidecast.llm.tables import blocks, boxed, keyed, same_row, sieve, sifted, text_bytes, unboxed
from tidecast.session import materialize

#: Bytes of text whose places are ranked together inside a task.
BLOCK = 1 << 18
#: Neighbouring windows that share one core, in the refinements after the runs.
WIDTHS = (32, 8, 1)
CLASS = WIDTHS[0]

_RUNS = "_id long, _h long, lo int, n int, off int, bucket long, content long"
_CORES = "_id long, _h long, core int, class int, open boolean, first int, last int, c1 long, c2 long, lead int, around binary"


def _digests(pieces: Iterator[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, pieces)), "<i8").reshape(-1, 2)


def _scan(window: int, gram: int):
    """Runs of windows of every text: where they are, their bucket (identifier of the gram) and their content."""

    def pieces(starts: np.ndarray):
        for a, b in blocks(starts, BLOCK):
            begin, end = int(starts[a]), int(starts[b])
            if end - begin <= BLOCK:
                yield a, begin, starts[a : b + 1] - begin
                continue
            for at in range(begin, max(begin + 1, end - window + 1), BLOCK):
                yield a, at, np.array([0, min(BLOCK + window - 1, end - at)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_bytes(batch.column(2))
            for row, begin, cuts in pieces(starts):
                part = data[begin : begin + int(cuts[-1])]
                ids = gram_ids(BYTE_IDS[part], gram)
                first, last, place, owner = runs(ids, cuts, gram, window)
                if not len(first):
                    continue
                view = memoryview(part)
                content = [xxhash.xxh3_64_intdigest(view[a : b + window]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                owner = owner + row
                lo = begin + first - starts[owner]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner)), batch.column(1).take(pa.array(owner))]
                    + [pa.array(x.astype(np.int32)) for x in (lo, last - first + 1, place - first)]
                    + [pa.array(ids[place].view(np.int64)), pa.array(np.array(content, np.uint64).view(np.int64))],
                    names=["_id", "_h", "lo", "n", "off", "bucket", "content"],
                )

    return scan


def _cores(window: int):
    """Cut runs whose bucket has other content, too, into classes of neighbouring windows, each with its shared core."""
    length = window - CLASS + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_bytes(batch.column(2))
            rows, cores, around = [], [], []
            for i, found in enumerate(batch.column(3).to_pylist()):
                text = memoryview(data[starts[i] : starts[i + 1]])
                for run in found:
                    place, most = run["lo"] + run["off"], run["off"]
                    least = most - run["n"] + 1
                    for c in range(least // CLASS, most // CLASS + 1):
                        core = place - c * CLASS
                        before = max(0, core - CLASS + 1)
                        cores.append(text[core : core + length])
                        around.append(bytes(text[before:core]) + bytes(text[core + length : core + length + CLASS - 1]))
                        inside = (max(least, c * CLASS), min(most, c * CLASS + CLASS - 1))
                        rows.append((i, core, c, run["open"], *inside, core - before))
            if rows:
                i, core, c, is_open, first, last, lead = (list(x) for x in zip(*rows, strict=True))
                digest = _digests(iter(cores))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(i)), batch.column(1).take(pa.array(i))]
                    + [pa.array(core, pa.int32()), pa.array(c, pa.int32()), pa.array(is_open)]
                    + [pa.array(first, pa.int32()), pa.array(last, pa.int32())]
                    + [pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(lead, pa.int32()), pa.array(around, pa.binary())],
                    names=["_id", "_h", "core", "class", "open", "first", "last", "c1", "c2", "lead", "around"],
                )

    return cut


def repeated_spans(docs: DataFrame, window: int = 400, gram: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes covered by ``window``-byte strings that start more than once: ``(_id, _h, spans)``, see ``tables.keyed``.

    ``spans`` holds the maximal runs ``(lo, hi)`` in order of place, ``hi`` not included; texts without any have no row.

    The sorted order of suffixes matters only where two of them share ``window`` bytes, so places are never sorted one
    by one. The initial buckets are those of the q-gram every window chooses (``minimizers``); a bucket of one content
    is decided at once. The others are refined by the identifiers of later offsets: by the whole run of windows, then
    by the core that 32, 8 and 1 neighbouring windows share, each identifier made of the one before and of the bytes
    that follow around it. Each refinement works only on what the one before left undecided. Identifiers are made of
    content (two 64-bit ones decide), so tasks agree on them without exchanging ranks.
    """
    if not CLASS < gram <= window - CLASS:
        raise ValueError(f"gram has to lie between {CLASS} and {window - CLASS}")
    texts = keyed(docs, id_col, text_col)
    found = materialize(texts.mapInArrow(_scan(window, gram), _RUNS), "runs")
    buckets = materialize(
        found.groupBy("bucket")
        .agg(F.count("*").alias("c"), F.min("content").alias("a"), F.max("content").alias("b"))
        .where("c > 1")
        .selectExpr("bucket", "a < b AS mixed"),
        "buckets",
    )
    again = sifted(found, "bucket", sieve(buckets, "bucket")).where("_maybe").drop("_maybe").join(buckets, "bucket")
    again = materialize(again, "again")
    spans = [again.where("NOT mixed").selectExpr("_id", "_h", "lo", f"lo + n + {window - 1} AS hi")]
    mixed = again.where("mixed")
    contents = materialize(
        mixed.groupBy("bucket", "content")
        .agg(F.count("*").alias("c"), *[F.first(x).alias(x) for x in ("_id", "_h", "lo", "n", "off")]),
        "contents",
    )
    twice = contents.where("c > 1").select("bucket", "content")
    whole = mixed.join(twice, ["bucket", "content"], "left_semi")
    spans.append(whole.selectExpr("_id", "_h", "lo", f"lo + n + {window - 1} AS hi"))
    kinds = contents.groupBy("_id", "_h").agg(F.collect_list(F.struct("lo", "n", "off", F.expr("c = 1").alias("open"))).alias("found"))
    wanted = sifted(texts, "_h", sieve(contents, "_h")).where("_maybe")
    cores = (
        wanted.alias("t")
        .join(kinds.alias("k"), same_row("t", "k"))
        .select("t._id", "t._h", "_text", "found")
        .mapInArrow(_cores(window), _CORES)
    )
    rows = materialize(cores, "cores")
    for width, finer in zip(WIDTHS, (*WIDTHS[1:], 0), strict=True):
        full = F.xxhash64("c2", "around", "lead", "first", "last")
        shared = (
            rows.groupBy("class", "c1")
            .agg(F.count("*").alias("k"), F.max("open").alias("any"), F.min(full).alias("a"), F.max(full).alias("b"))
            .where("k > 1 AND any")
            .selectExpr("class", "c1", "a = b AS same")
        )
        rows = materialize(rows.join(shared, ["class", "c1"]), "shared")
        # equal in all bytes around the core: every window of the class is repeated
        equal = rows.where("same AND open")
        spans.append(equal.selectExpr("_id", "_h", f"core - last + class * {width} AS lo", f"core - first + class * {width} + {window} AS hi"))
        if finer:
            rows = _refined(rows.where("NOT same").drop("same"), width, finer)
    out = spans[0]
    for more in spans[1:]:
        out = out.unionByName(more)
    return merged(out)


def _refined(rows: DataFrame, width: int, finer: int) -> DataFrame:
    """Classes of ``width`` windows cut into classes of ``finer``, named by the old core and the bytes added to it."""
    cut = rows.withColumn("c", F.explode(F.sequence(F.expr(f"first DIV {finer}"), F.expr(f"last DIV {finer}"))))
    cut = cut.withColumn("j", F.expr(f"c * {finer} - class * {width}"))  # bytes that join the core on the left
    right = width - finer
    piece = F.expr(f"substring(around, lead - j + 1, {right})")
    before = F.expr(f"greatest(lead - j - {finer - 1}, 0)")
    cut = cut.withColumns({"piece": piece, "before": before})
    return cut.select(
        "_id",
        "_h",
        F.expr("core - j").cast("int").alias("core"),
        F.col("c").alias("class"),
        "open",
        F.expr(f"greatest(first, c * {finer})").alias("first"),
        F.expr(f"least(last, c * {finer} + {finer - 1})").alias("last"),
        F.xxhash64("c1", "j", "piece").alias("c1"),
        F.xxhash64("piece", "c2", "j").alias("c2"),
        F.expr("lead - j - before").alias("lead"),
        F.expr(
            f"concat(substring(around, before + 1, lead - j - before), substring(around, lead - j + {right} + 1, {finer - 1}))"
        ).alias("around"),
    )


def merged(spans: DataFrame) -> DataFrame:
    """Union of the intervals ``[lo, hi)`` of each row name, in order; touching intervals become one."""
    own = Window.partitionBy("_id", "_h").orderBy("lo", "hi")
    before = F.max("hi").over(own.rowsBetween(Window.unboundedPreceding, -1))
    return (
        spans.withColumn("new", F.when(F.col("lo") <= before, 0).otherwise(1))
        .withColumn("part", F.sum("new").over(own))
        .groupBy("_id", "_h", "part")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .groupBy("_id", "_h")
        .agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
    )


def whole_characters(data: Column) -> Column:
    """Bytes as text; what a cut has left of a character goes."""
    text = data.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit("")))


def remove_repeats(docs: DataFrame, window: int = 400, gram: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with ``removed`` (runs ``(lo, hi)`` of bytes) and ``kept`` (the remaining bytes) added.

    Null text counts as empty; texts shorter than ``window`` keep all bytes; rows that repeat id and text are copies of
    each other and lose all that one of them alone would share with the other. Columns of ``docs`` named ``removed`` or
    ``kept`` are replaced. An empty table gives an empty result.
    """
    spans = repeated_spans(docs, window, gram, id_col, text_col)
    bare = docs.drop("removed", "kept")
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = bare.select(boxed(bare), F.col(id_col).cast("long").alias("_id"), F.xxhash64(text).alias("_h"))
    spans = materialize(spans, "spans")
    named = sifted(named, "_h", sieve(spans, "_h"))
    data = F.encode(F.coalesce(F.col(f"_row.`{text_col}`"), F.lit("")), "utf-8")
    touched = named.where("_maybe").alias("n").join(spans.alias("s"), same_row("n", "s"), "left").select("_row", "spans")
    joined = touched.withColumns({"_data": data, "_end": F.octet_length(data)})
    # the bytes between the runs: each piece begins where one run ends and stops where the next begins
    kept = F.expr(
        """CASE WHEN spans IS NULL THEN _data ELSE aggregate(
             sequence(0, size(spans)), CAST('' AS BINARY),
             (sum, i) -> concat(sum, substring(_data, if(i = 0, 0, spans[i - 1].hi) + 1,
               if(i = size(spans), _end, spans[i].lo) - if(i = 0, 0, spans[i - 1].hi)))) END"""
    )
    none = F.array().cast("array<struct<lo:int,hi:int>>")
    cut = joined.select(*unboxed(bare), F.coalesce("spans", none).alias("removed"), kept.alias("kept"))
    clean = named.where("NOT _maybe").select(*unboxed(bare), none.alias("removed"), data.alias("kept"))
    return cut.unionByName(clean)
