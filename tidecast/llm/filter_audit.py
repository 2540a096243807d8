"""Interaction of filters: what each one removes under every order of application, read off weighted decision diagrams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidecast.llm.tables import boxed
from tidecast.session import materialize

STEPS = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


@dataclass
class Diagram:
    """A decision diagram over one variable a level; a path spells a mask and ends at the weights of that mask.

    Nodes are ``(low, high)`` numbers into ``nodes``; ``low`` is taken where the filter of the level passes, ``high``
    where it fails. Every path visits every level, equal nodes are held once, and ``weight[n]`` adds up all masks below.
    """

    order: list[int]
    nodes: list[tuple[int, int]] = field(default_factory=list)
    weight: list[np.ndarray] = field(default_factory=list)
    known: dict = field(default_factory=dict)
    root: int = 0

    @classmethod
    def of(cls, table: np.ndarray) -> Diagram:
        """``table[mask]`` holds the weights of a mask; bit ``v`` of the mask says that filter ``v`` fails."""
        size = int(len(table)).bit_length() - 1
        out = cls(list(range(size)))

        def grown(level: int, mask: int) -> int:
            if level == size:
                return out.leaf(table[mask])
            return out.node(level, grown(level + 1, mask), grown(level + 1, mask | 1 << level))

        out.root = grown(0, 0)
        return out

    def leaf(self, weights: np.ndarray) -> int:
        return self._held(("leaf", *map(int, weights)), (-1, -1), weights)

    def node(self, variable: int, low: int, high: int) -> int:
        return self._held((variable, low, high), (low, high), self.weight[low] + self.weight[high])

    def _held(self, key: tuple, children: tuple[int, int], weights: np.ndarray) -> int:
        if key not in self.known:
            self.known[key] = len(self.nodes)
            self.nodes.append(children)
            self.weight.append(weights)
        return self.known[key]

    def swap(self, level: int) -> None:
        """Exchange the variables of ``level`` and the one below: only nodes of these two levels are made anew."""
        above, below = self.order[level], self.order[level + 1]

        def swapped(n: int) -> int:
            (ll, lh), (hl, hh) = (self.nodes[c] for c in self.nodes[n])
            return self.node(below, self.node(above, ll, hl), self.node(above, lh, hh))

        def rebuilt(n: int, at: int) -> int:
            if at == level:
                return swapped(n)
            low, high = self.nodes[n]
            return self.node(self.order[at], rebuilt(low, at + 1), rebuilt(high, at + 1))

        self.root = rebuilt(self.root, 0)
        self.order[level], self.order[level + 1] = below, above

    def all_pass_path(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(variable, weights that pass, weights that fail)`` of each level, given that all levels above passed."""
        n = self.root
        for variable in self.order:
            low, high = self.nodes[n]
            yield variable, self.weight[low], self.weight[high]
            n = low

    def fails_only(self, variable: int) -> np.ndarray:
        n = self.root
        for v in self.order:
            n = self.nodes[n][v == variable]
        return self.weight[n]

    def fails(self, variable: int) -> np.ndarray:
        """Weights of all masks in which ``variable`` fails."""
        level, at = self.order.index(variable), [self.root]
        for _ in range(level):
            at = [c for n in at for c in self.nodes[n]]
        return sum((self.weight[self.nodes[n][1]] for n in at), np.zeros_like(self.weight[self.root]))


def adjacent_swaps(size: int) -> Iterator[int]:
    """Levels to swap with the one below, one after the other, so that all orders of ``size`` variables come by once."""
    perm, way = list(range(size)), [-1] * size
    while True:
        mobile = [
            v for i, v in enumerate(perm) if 0 <= i + way[v] < size and perm[i + way[v]] < v
        ]
        if not mobile:
            return
        v = max(mobile)
        i = perm.index(v)
        j = i + way[v]
        perm[i], perm[j] = perm[j], perm[i]
        yield min(i, j)
        for w in range(v + 1, size):
            way[w] = -way[w]


def steps(table: np.ndarray, names: str) -> list[tuple]:
    """All orders and steps of one part, from the weights (documents, good, toxic) of every mask."""
    diagram = Diagram.of(table)
    size = len(names)
    alone = [int(diagram.fails_only(v)[0]) for v in range(size)]
    total = [int(diagram.fails(v)[0]) for v in range(size)]
    paths = [list(diagram.all_pass_path())]
    for level in adjacent_swaps(size):
        diagram.swap(level)
        paths.append(list(diagram.all_pass_path()))
    share = [0] * size
    for path in paths:
        for v, _, gone in path:
            share[v] += int(gone[0])
    rows = []
    for path in paths:
        order = "".join(names[v] for v, *_ in path)
        for k, (v, passed, gone) in enumerate(path, 1):
            n, good, toxic = map(int, gone)
            rows.append((order, k, int(passed[0]), n, total[v] - n, alone[v], good, toxic, share[v]))
    return rows


def masks(docs: DataFrame, filters: dict[str, Column], part: Column, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", copies: str | None = None) -> DataFrame:
    """Documents, good and toxic ones by ``(part, mask)``; bit ``i`` of the mask is set where filter ``i`` fails.

    ``filters`` maps a one-letter name to its failure condition over the columns of ``docs``; a condition that is null
    does not fail. ``copies`` names one more filter: it fails where a row with a smaller id, of any part, has the same
    text (null: empty). A row without an id is no smaller one and never fails it. Several label rows of an id count as
    one that says 1 where any of them does. Texts are compared by their SHA-256.
    """
    bits = [F.when(F.coalesce(c, F.lit(False)), 1 << i).otherwise(0) for i, c in enumerate(filters.values())]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    facts = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("_id"),
        part.alias("part"),
        F.unhex(F.sha2(F.encode(text, "utf-8"), 256)).alias("_digest"),
        sum(bits[1:], bits[0]).cast("int").alias("mask"),
    )
    facts = materialize(facts, "filter-facts")
    said = labels.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("_good"), F.max((F.col("toxic") == 1).cast("int")).alias("_toxic")
    )
    rows = facts.join(said, "_id", "left").na.fill(0, ["_good", "_toxic"])
    kind = ["part", "mask", "_good", "_toxic"]
    if copies:
        counted = _copies_told(rows, kind, 1 << len(filters))
    else:
        counted = rows.groupBy(*kind).agg(F.count("*").alias("n"))
    sums = {"n": F.col("n"), "good": F.col("n") * F.col("_good"), "toxic": F.col("n") * F.col("_toxic")}
    return counted.groupBy("part", "mask").agg(*[F.sum(c).cast("long").alias(name) for name, c in sums.items()])


def _copies_told(rows: DataFrame, kind: list[str], bit: int) -> DataFrame:
    """Rows counted by ``kind``, with ``bit`` set in the mask of those whose text a smaller id has.

    The rows of a text are counted by kind before they meet, so a text of any number of copies brings a few rows to the
    task that finds its smallest id.
    """
    by_id = rows.groupBy("_digest", *kind, "_id").agg(F.count("*").alias("n"))
    by_kind = by_id.groupBy("_digest", *kind).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("_id").isNull(), F.col("n")).otherwise(0)).alias("_loose"),
        F.min("_id").alias("_first"),
        F.min_by("n", "_id").alias("_n_first"),
    )
    least = F.min("_first").over(Window.partitionBy("_digest"))
    own = F.when(F.col("_first") == F.col("_least"), F.col("_n_first")).otherwise(0)
    told = by_kind.withColumn("_least", least).withColumn("_fails", F.col("n") - F.col("_loose") - own)
    both = F.array(
        F.struct(F.col("mask"), (F.col("n") - F.col("_fails")).alias("n")),
        F.struct((F.col("mask") + bit).alias("mask"), F.col("_fails").alias("n")),
    )
    rest = [c for c in kind if c != "mask"]
    return told.select(*rest, F.explode(both).alias("s")).select(*rest, "s.mask", "s.n").where("n > 0")


def audit(counted: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per part, order of all filters and step, zeros included, from the counts of ``masks``.

    A task sees one part at a time: ``2 ** len(names)`` masks at most, whatever the number of documents. An empty table
    has no parts and gives no rows.
    """
    letters = "".join(names)

    def of_part(frame: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros((1 << len(letters), 3), np.int64)
        table[frame["mask"]] = frame[["n", "good", "toxic"]]
        found = pd.DataFrame(steps(table, letters), columns=[c.split()[0] for c in STEPS.split(", ")[1:]])
        found.insert(0, "part", frame["part"].iloc[0])
        return found

    return counted.groupBy("part").applyInPandas(of_part, STEPS)


def _sql_words(text: str) -> str:
    return rf"filter(split({text}, '[\\x20\\x09-\\x0D]+'), x -> x != '')"


#: Measures of a text, each computed once: words, distinct words, capitals, code points, whether it holds a symbol.
_MEASURES = rf"""transform(array(coalesce(`{{0}}`, '')), _t -> transform(array({_sql_words("_t")}), w -> named_struct(
  'words', size(w), 'distinct', size(array_distinct(w)), 'capitals', length(regexp_replace(_t, '[^A-Z]+', '')),
  'chars', length(_t), 'symbols', _t RLIKE '[#$%&*|]'))[0])"""


def text_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Five filters on text, audited per language: A short, B repetitive, C capitals, D symbols, E copies.

    Null text counts as empty, a null part as the empty string. Other columns of ``docs`` are ignored, whatever their
    names. The measures come out of a generator of one row, so that they are computed once however many filters use them.
    """
    bare = docs.select(boxed(docs))
    measured = bare.select(
        F.col(f"_row.`{id_col}`").alias("_own_id"),
        F.col(f"_row.`{text_col}`").alias("_own_text"),
        F.coalesce(F.col(f"_row.`{part_col}`"), F.lit("")).alias("_part"),
        F.expr(f"inline({_MEASURES.format(f'_row`.`{text_col}')})"),
    )
    filters = {
        "A": F.expr("words < 100"),
        "B": F.expr("100L * distinct < 80L * words"),
        "C": F.expr("100L * capitals > 10L * chars"),
        "D": F.col("symbols"),
    }
    counted = masks(measured, filters, F.col("_part"), labels, "_own_id", "_own_text", copies="E")
    return audit(counted, [*filters, "E"])


#: DuckDB SQL for the query over ``documents`` and ``labels``.
ORACLE = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part,
  list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
first AS (SELECT t, min(doc_id) AS m FROM d GROUP BY t),
said AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS g, max(CAST(toxic = 1 AS INTEGER)) AS x FROM labels GROUP BY doc_id),
v AS (SELECT part, CAST(len(w) < 100 AS INTEGER) + 2 * CAST(100 * len(list_distinct(w)) < 80 * len(w) AS INTEGER)
  + 4 * CAST(100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) AS INTEGER)
  + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER) + 16 * CAST(coalesce(m < d.doc_id, FALSE) AS INTEGER) AS mask,
  coalesce(g, 0) AS g, coalesce(x, 0) AS x
  FROM d JOIN first USING (t) LEFT JOIN said ON said.doc_id = d.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(g) AS g, sum(x) AS x FROM v GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT p.f || q.f || r.f || s.f || u.f AS o, [p.b, q.b, r.b, s.b, u.b] AS bits FROM f p, f q, f r, f s, f u
  WHERE p.b + q.b + r.b + s.b + u.b = 31 AND len(list_distinct([p.b, q.b, r.b, s.b, u.b])) = 5),
k AS (SELECT o, step, bits[step] AS b, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS before
  FROM o, (SELECT unnest(range(1, 6)) AS step)),
m AS (SELECT c.part, o, step, b,
  sum(CASE WHEN mask & (before + b) = 0 THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN mask & before = 0 AND mask & b <> 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & before <> 0 AND mask & b <> 0 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN mask = b THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & before = 0 AND mask & b <> 0 THEN g ELSE 0 END) AS good_lost,
  sum(CASE WHEN mask & before = 0 AND mask & b <> 0 THEN x ELSE 0 END) AS toxic_lost
  FROM c, k GROUP BY ALL)
SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, b) AS BIGINT) AS shapley FROM m"""
