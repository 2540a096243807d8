"""How far the sources of a language differ in their terms: all pairs of sources, and the terms each overuses."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidecast.llm.tables import blocks, text_bytes
from tidecast.operators.rank import numbered
from tidecast.session import materialize

#: Bytes of text whose terms are counted together inside a task; counting holds about forty times as many.
BLOCK = 1 << 22
#: Sources whose bitmaps of one block of terms travel in one row.
BUNDLE = 32

_COUNTED = "lang string, source string, term string, n long, docs long"
_LETTERS = np.zeros(256, bool)
_LETTERS[ord("A") : ord("Z") + 1] = _LETTERS[ord("a") : ord("z") + 1] = _LETTERS[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _terms(data: np.ndarray, cuts: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
    """Maximal runs of letters (ASCII ones lower-cased) of texts that lie one behind another, and the text of each."""
    letter = _LETTERS[data]
    inside = letter.copy()
    inside[1:] &= letter[:-1]
    starts = cuts[:-1][cuts[:-1] < len(data)]
    inside[starts] = False  # a run never goes on in the next text
    last = letter.copy()
    last[:-1] &= ~inside[1:]
    at = np.flatnonzero(letter & ~inside)
    ends = np.zeros(len(at) + 1, np.int32)
    np.cumsum(np.flatnonzero(last) + 1 - at, out=ends[1:])
    packed = _LOWER[data[letter]]
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(packed))
    return words, np.searchsorted(cuts, at, side="right") - 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of every term, and documents that hold it, for each group of each run of texts."""
    for batch in batches:
        data, starts = text_bytes(batch.column(2))
        groups: dict[tuple, int] = {}
        group = np.array([groups.setdefault(k, len(groups)) for k in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True)], np.int64)
        names = [pa.array(x, pa.string()) for x in zip(*groups, strict=True)]
        for a, b in blocks(starts, BLOCK):
            words, owner = _terms(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a])
            if not len(words):
                continue
            coded = words.dictionary_encode()
            size = len(coded.dictionary)
            code = coded.indices.to_numpy().astype(np.int64)
            cell = group[a + owner] * size + code
            found, n = np.unique(cell, return_counts=True)
            once = np.unique(owner * size + code)
            _, docs = np.unique(group[a + once // size] * size + once % size, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [names[0].take(pa.array(found // size)), names[1].take(pa.array(found // size)), coded.dictionary.take(pa.array(found % size))]
                + [pa.array(n.astype(np.int64)), pa.array(docs.astype(np.int64))],
                names=["lang", "source", "term", "n", "docs"],
            )


def share(count: str, total: str, kept: str) -> str:
    """SQL of ``1 + floor(10^9 (count + 2) / (total + 2 kept))``, exact for every count that a long can hold."""
    wide = "CAST({} AS DECIMAL(20, 0))".format
    return f"1 + (CAST(1000000000 AS DECIMAL(10, 0)) * {wide(f'{count} + 2')}) DIV {wide(f'{total} + 2 * {kept}')}"


def gap(p: str, q: str) -> str:
    """SQL of ``floor((p - q)^2 / (p + q))``; shares lie below 2^31, so the square fits into a long."""
    return f"(({p} - {q}) * ({p} - {q})) DIV ({p} + {q})"


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _joint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every two sources of two bundles: joint cells of one block of terms, times what they add to the pair.

    A bitmap is one machine word, so the cell of two levels is a popcount of their AND. A cell of levels ``x`` and ``y``
    adds ``f(x, y)`` and takes back what its terms would have added with a zero on either side (see ``divergences``).
    """
    for batch in batches:
        langs, sides = batch.column(0), []
        for side in (batch.column(1), batch.column(2)):
            sides.append((side.offsets.to_numpy(), [x.to_numpy() for x in side.values.flatten()]))
        rows, one, two, total = [], [], [], []
        for i in range(batch.num_rows):
            (ga, px, zx, ba), (gb, py, zy, bb) = ([x[at[i] : at[i + 1]] for x in fields] for at, fields in sides)
            cells = np.bitwise_count(ba.view(np.uint64)[:, None] & bb.view(np.uint64)[None, :])
            cells[ga[:, None] >= gb[None, :]] = 0
            x, y = np.nonzero(cells)
            if not len(x):
                continue
            n = cells[x, y].astype(np.int64)
            p, q, p0, q0 = px[x], py[y], zx[x], zy[y]
            v = n * (_gap(p, q) - _gap(p, q0) - _gap(p0, q) + _gap(p0, q0))
            pair, inverse = np.unique(np.stack([ga[x], gb[y]]), axis=1, return_inverse=True)
            sums = np.zeros(pair.shape[1], np.int64)
            np.add.at(sums, inverse.ravel(), v)
            rows.append(np.full(len(sums), i))
            one.append(pair[0])
            two.append(pair[1])
            total.append(sums)
        if rows:
            yield pa.RecordBatch.from_arrays(
                [langs.take(pa.array(np.concatenate(rows))), *(pa.array(np.concatenate(x)) for x in (one, two, total))],
                names=["lang", "one", "two", "v"],
            )


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences of every term in each group, and documents that hold it.

    Null text, language or source counts as empty. Counted inside the tasks first, so a group of any size is spread.
    """
    bare = [F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (lang_col, source_col, text_col)]
    texts = docs.select(bare[0].alias("lang"), bare[1].alias("source"), bare[2].alias("text"))
    return texts.mapInArrow(_count, _COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def divergences(docs: DataFrame, least_docs: int = 10, top: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Rows ``(lang, source, part, item, value, rank)``: ``pair`` for every other source, ``term`` for the ``top`` terms.

    Each language keeps the terms of at least ``least_docs`` of its documents and numbers them by frequency. The terms
    that a source has ``n`` times are one bitset, held as one machine word for each 64 terms, so a row of ``bits`` is a
    (source, count) level inside a block. With ``f0`` for a count of zero, the value of two sources is, by complement,

        V f(0, 0) + sum over levels x of the first |x| (f(x, 0) - f(0, 0)) + the same for the second
        + sum over joint cells of levels x, y above zero |x AND y| (f(x, y) - f(x, 0) - f(0, y) + f(0, 0)),

    so blocks that only one of them has need no joint work. All arithmetic is on whole numbers. Null text, language or
    source counts as empty; sources without kept terms have zero counts for all of them; a language of one source has
    no pairs; without kept terms the value of a pair is 0. An empty table gives no rows. Other columns are ignored.
    """
    counts = materialize(term_counts(docs, text_col, lang_col, source_col), "term-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total")).where(F.col("docs") >= least_docs)
    kept = materialize(numbered(kept.select("lang", "term", "total"), ["total", "term"], "place", ["lang"], ["total"]), "kept-terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_total"))
    cells = materialize(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "place", "total"), "kept-counts")

    groups = docs.select(F.coalesce(F.col(f"`{lang_col}`"), F.lit("")).alias("lang"), F.coalesce(F.col(f"`{source_col}`"), F.lit("")).alias("source"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    groups = groups.distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["n_group", "kept", "lang_total"])
    zero = F.when(F.col("kept") > 0, F.expr(share("0L", "n_group", "greatest(kept, 1L)"))).otherwise(F.lit(0))
    groups = materialize(numbered(groups.withColumn("p0", zero), ["source"], "g", ["lang"]), "groups")

    bits = cells.groupBy("lang", "source", F.expr("place DIV 64").alias("block"), "n").agg(F.expr("bit_or(shiftleft(1L, CAST(place % 64 AS INT)))").alias("bits"))
    named = groups.select("lang", "source", "g", "p0", "n_group", "kept")
    bits = bits.join(named, ["lang", "source"]).withColumn("p", F.expr(share("n", "n_group", "kept")))
    bits = materialize(bits.select("lang", "block", "g", "p", "p0", "bits"), "levels")
    return _pairs(bits, groups).unionByName(_terms_over(cells, groups, top))


def _pairs(bits: DataFrame, groups: DataFrame) -> DataFrame:
    sides = groups.where("kept > 0").select("lang", "g", "p0", "kept")
    both = sides.alias("a").join(sides.alias("b"), (F.col("a.lang") == F.col("b.lang")) & (F.col("a.g") != F.col("b.g")))
    both = both.select("a.lang", F.col("a.g").alias("x"), F.col("b.g").alias("y"), F.col("a.p0").alias("p0"), F.col("b.p0").alias("q0"), "a.kept")
    # what the levels of x add while y has none of their terms
    levels = bits.groupBy("lang", "g", "p").agg(F.sum(F.bit_count("bits")).alias("size"))
    levels = levels.groupBy("lang", F.col("g").alias("x")).agg(F.collect_list(F.struct("p", F.col("size").cast("long").alias("size"))).alias("levels"))
    alone = both.join(levels, ["lang", "x"], "left").withColumn("f00", F.expr(gap("p0", "q0")))
    alone = alone.withColumn("v", F.expr(f"coalesce(aggregate(levels, 0L, (s, l) -> s + l.size * ({gap('l.p', 'q0')} - f00)), 0L)"))
    one_way = alone.select("lang", "x", "y", F.expr("v + if(x < y, kept * f00, 0L)").alias("v"))

    level = F.struct("g", "p", "p0", "bits")
    packed = bits.withColumn("bundle", F.expr(f"g DIV {BUNDLE}")).groupBy("lang", "block", "bundle").agg(F.sort_array(F.collect_list(level)).alias("levels"))
    packed = materialize(packed, "bundles")
    a, b = packed.alias("a"), packed.alias("b")
    tiles = a.join(b, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.block") == F.col("b.block")) & (F.col("a.bundle") <= F.col("b.bundle")))
    tiles = tiles.select("a.lang", F.col("a.levels").alias("one"), F.col("b.levels").alias("two"))
    joint = tiles.mapInArrow(_joint, "lang string, one long, two long, v long")
    joint = joint.select("lang", F.col("one").alias("x"), F.col("two").alias("y"), "v")

    halves = one_way.select("lang", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "v").unionByName(joint)
    value = halves.groupBy("lang", "x", "y").agg(F.sum("v").alias("v"))
    value = value.select("lang", F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("s"), "v").select("lang", "s.x", "s.y", "v")
    # every two sources of a language, with value 0 where it keeps no term
    own, other = groups.select("lang", "source", F.col("g").alias("x")), groups.select("lang", F.col("source").alias("item"), F.col("g").alias("y"))
    pairs = own.join(other, "lang").where("x != y").join(value, ["lang", "x", "y"], "left")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("v", F.lit(0)).alias("value"))
    return pairs.withColumn("rank", F.row_number().over(order))


def _terms_over(cells: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    known = groups.select("lang", "source", "n_group", "kept", "lang_total")
    rows = cells.join(known, ["lang", "source"])
    rows = rows.withColumns({"p": F.expr(share("n", "n_group", "kept")), "q": F.expr(share("total", "lang_total", "kept"))}).where("p > q")
    rows = rows.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(gap("p", "q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


_SHARE = "1 + (1000000000::HUGEINT * ({} + 2)) // ({} + 2 * v)"
#: DuckDB SQL for the query over ``documents``.
ORACLE = rf"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 10),
l AS (SELECT lang, count(*) AS v, sum(total) AS lang_n FROM k GROUP BY lang),
c AS (SELECT t.lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT x.lang, x.source, coalesce(sum(c.n), 0) AS group_n FROM (SELECT DISTINCT lang, source FROM d) x
  LEFT JOIN c USING (lang, source) GROUP BY x.lang, x.source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, CAST({_SHARE.format("coalesce(c.n, 0)", "group_n")} AS BIGINT) AS p,
  CAST({_SHARE.format("k.total", "lang_n")} AS BIGINT) AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM o)
WHERE part = 'pair' OR rank <= 10"""
