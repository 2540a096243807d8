"""N-gram Jaccard join: documents whose shingle sets agree, found by T-occurrence search over inverted lists."""

from __future__ import annotations

from collections.abc import Iterator
from math import log2

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecast.llm.graph import components
from tidecast.llm.minimizers import WordIds, gram_ids, joined
from tidecast.llm.tables import boxed, keyed, same_row, sieve, sifted, text_bytes, unboxed
from tidecast.session import materialize

#: Slots that hold how frequent shingles are, two bits each; their number does not depend on the corpus.
SLOT_BITS = 27
#: Document counts from which on a shingle is in class 1, 2 and 3; class 0 is left to shingles of one document.
OFTEN = (2, 4, 32)
#: Shingles that one task sorts at a time, when it counts its own and when it sums a range of identifiers.
RUN_SHINGLES = 1 << 21
#: Shingles of one block of documents, which a task holds twice.
BLOCK_SHINGLES = 1 << 20


def shingles(words: list[bytes], known: WordIds, size: int) -> np.ndarray:
    """Sorted identifiers of the distinct ``size``-word shingles; fewer words are one shingle, no words none."""
    units = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    return np.unique(gram_ids(units, min(size, len(units)))) if len(units) else units


def _of(batch: pa.RecordBatch, column: int, known: WordIds, size: int) -> Iterator[np.ndarray]:
    data, starts = text_bytes(batch.column(column))
    for i in range(len(batch)):
        yield shingles(data[starts[i] : starts[i + 1]].tobytes().lower().split(), known, size)


def least_overlap(n: int, m: int, percent: int) -> int:
    """Shingles that sets of ``n`` and ``m`` must share: 100 * shared >= percent * (n + m - shared)."""
    return -(-percent * (n + m) // (100 + percent))


def rarity(texts: DataFrame, size: int) -> np.ndarray:
    """How frequent shingles are: for every slot (top bits of an identifier) the class of the largest document count,
    four slots in a byte. A shingle in a slot of class 0 is surely in one document only.

    All shingles of all documents are counted by the first 40 bits of their identifiers. They travel as sorted runs of
    differences, one for each range of identifiers, and every range is summed by a group of its own; there are as many
    ranges as the bytes of text ask for. The result is an order of shingles and nothing else: slots that clash make it
    less sharp, never wrong.
    """
    expected = (texts.agg(F.sum(F.octet_length("_text")).alias("n")).first().n or 0) // 6
    range_bits = min(SLOT_BITS - 3, max(6, (expected // RUN_SHINGLES).bit_length()))
    span = SLOT_BITS - range_bits

    def told(held: list[np.ndarray]) -> pa.RecordBatch:
        every, times = np.unique(np.concatenate(held), return_counts=True)
        cuts = np.searchsorted(every, np.arange(1 << range_bits, dtype=np.uint64) << np.uint64(40 - range_bits))
        rows = []
        for r, (a, b) in enumerate(zip(cuts, np.append(cuts[1:], len(every)), strict=True)):
            if a < b:
                steps = np.diff(every[a:b], prepend=every[a : a + 1]).astype("<u8").view(np.uint8).reshape(-1, 8)
                packed = zstandard.compress(np.ascontiguousarray(steps[:, :5].T).tobytes(), 1)
                rows.append((r, int(every[a]), packed, zstandard.compress(times[a:b].astype("<u4").tobytes(), 1)))
        columns = zip(*rows, strict=True)
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "first", "steps", "times"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, n = WordIds(), [], 0
        for batch in batches:
            for s in _of(batch, 0, known, size):
                held.append(s >> np.uint64(24))
                n += len(s)
                if n > RUN_SHINGLES:
                    yield told(held)
                    held, n = [], 0
        if n:
            yield told(held)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, times = [], []
        for first, steps, n in zip(pdf["first"], pdf["steps"], pdf["times"], strict=True):
            n = np.frombuffer(zstandard.decompress(n), "<u4")
            wide = np.zeros((len(n), 8), np.uint8)
            wide[:, :5] = np.frombuffer(zstandard.decompress(steps), np.uint8).reshape(5, -1).T
            ids.append(np.cumsum(wide.view("<u8").reshape(-1)) + np.uint64(first))
            times.append(n)
        ids, times = np.concatenate(ids), np.concatenate(times)
        order = np.argsort(ids, kind="stable")
        ids, times = ids[order], times[order].astype(np.int64)
        start = np.flatnonzero(np.diff(ids, prepend=ids[:1] - np.uint64(1)))
        df = np.add.reduceat(times, start)
        often = df > 1
        classes = np.zeros(1 << span, np.uint8)
        slot = (ids[start][often] >> np.uint64(40 - SLOT_BITS)).astype(np.int64) & ((1 << span) - 1)
        np.maximum.at(classes, slot, np.searchsorted(OFTEN, df[often], side="right").astype(np.uint8))
        classes = np.bitwise_or.reduce(classes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8), axis=1)
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "classes": [zstandard.compress(classes.tobytes(), 3)]})

    runs = texts.select("_text").mapInArrow(count, "part int, first long, steps binary, times binary")
    out = np.zeros((1 << range_bits, 1 << (span - 2)), np.uint8)
    for r in runs.groupBy("part").applyInPandas(add, "part int, classes binary").toLocalIterator():
        out[r.part] = np.frombuffer(zstandard.decompress(r.classes), np.uint8)
    return out.reshape(-1)


def class_of(s: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The class of each shingle, see ``rarity``."""
    slot = (s >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
    return classes[slot >> 2] >> (2 * (slot & 3)).astype(np.uint8) & np.uint8(3)


def keys(s: np.ndarray, classes: np.ndarray, percent: int) -> np.ndarray:
    """Identifiers of which the sorted set ``s`` has one in common with every other set that it links with.

    Both sets are put in one order, by class and identifier, and two shingles that follow each other there make a key.
    Of all shingles that one of the sets has, an ``a`` are only in ``s`` and ``b`` only in the other one. Before the
    first two shared ones that follow each other, every shared one is followed by one that is not, so these two are
    among the first ``2a + b + 2`` of ``s``; that is largest, ``2 * (1 - percent) * n + 2``, if the other set is a part of
    ``s``. They exist if the sets differ and ``percent`` is 67 or more; below that, single shingles are keys. Texts that
    share a rare shingle by chance seldom share two that follow each other. Keys of shingles that are surely in one
    document only are left out.
    """
    kind = class_of(s, classes)
    order = np.lexsort((s, kind))
    if percent < 67:
        order = order[: len(s) - -(-percent * len(s) // 100) + 1]
        return s[order[kind[order] > 0]]
    order = order[: 2 * len(s) * (100 - percent) // 100 + 2]
    order = order[kind[order] > 0]
    return joined(s[order[:-1]], s[order[1:]], 2)


def _described(texts: DataFrame, size: int, percent: int, classes: np.ndarray) -> DataFrame:
    """Each text's number of shingles, the identifier of its set, and its keys."""
    shared = texts.sparkSession.sparkContext.broadcast(classes)  # of fixed size

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, classes = WordIds(), shared.value
        for batch in batches:
            n, digest, own = [], [], []
            for s in _of(batch, 2, known, size):
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s))
                own.append(keys(s, classes, percent).view(np.int64))
            digest = np.frombuffer(b"".join(digest), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1])]
                + [pa.array(own, pa.list_(pa.int64()))],
                names=["_id", "_h", "n", "s1", "s2", "keys"],
            )

    return texts.mapInArrow(describe, "_id long, _h long, n long, s1 long, s2 long, keys array<long>")


class _Sets:
    """Union-find over documents of a group, and the search for links between them."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sets, self.percent = sets, percent
        self.size = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), self.size)
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        every, self.owner = every[order], owner[order]
        self.tokens, self.begin, count = np.unique(every, return_index=True, return_counts=True)
        self.end = self.begin + count
        self.parent = np.arange(len(sets))
        self.links: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def search(self, q: int, wanted: np.ndarray) -> None:
        """Link document ``q`` with all that share enough with it, leaving out those it is connected with already.

        DivideSkip: of the inverted lists of its shingles, the ``long`` longest are not merged. The short ones are, and
        a document found ``least - long`` times there is looked up in the long lists by binary search.
        """
        s = self.sets[q]
        at = np.searchsorted(self.tokens, s)
        length = self.end[at] - self.begin[at]
        least = -(-self.percent * len(s) // 100)
        heavy = int(least / (0.01 * log2(max(2, length.max())) + 1)) if len(s) else 0
        long = min(heavy, least - 1)
        order = np.argsort(length, kind="stable")
        short, rest = at[order[: len(s) - long]], order[len(s) - long :]
        # sorted lists of document numbers, merged by counting
        merged = np.concatenate([self.owner[self.begin[t] : self.end[t]] for t in short])
        counts = np.bincount(merged, minlength=len(self.sets))
        mine = self.percent * self.size <= 100 * len(s)
        near = mine & (self.percent * len(s) <= 100 * self.size) & wanted & (counts >= max(1, least - long))
        near[q] = False
        for c in np.flatnonzero(near)[np.argsort(-counts[near], kind="stable")].tolist():
            a, b = self.root(q), self.root(c)
            if a == b:
                continue
            need = least_overlap(len(s), int(self.size[c]), self.percent)
            if counts[c] + long < need:
                continue
            other = self.sets[c]
            i = np.minimum(np.searchsorted(other, s[rest]), len(other) - 1)
            if counts[c] + int((other[i] == s[rest]).sum()) >= need:
                self.parent[max(a, b)] = min(a, b)
                self.links.append((q, c))


def spanning_links(sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect documents as all links between them do; ``side`` tells the two blocks of a pair apart (both
    alike: links inside the block), links inside one of two blocks are left to its own group."""
    group = _Sets(sets, percent)
    apart = side.min() != side.max() if len(side) else False
    for q in np.argsort(group.size, kind="stable").tolist():
        if apart and side[q] == side.min():
            continue
        group.search(q, side != side[q] if apart else np.ones(len(sets), bool))
    return group.links


def linked(docs: DataFrame, size: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``_id``, ``_h`` (see ``tables.keyed``), ``n_shingles``, ``component_id`` and
    ``root`` (a name of the component in this result, null without words).

    Documents link when ``100 * shared >= percent * union`` of their ``size``-word shingles, after lower-casing A-Z; a
    text of fewer words is one shingle, and a text without words links with nothing. ``component_id`` is the smallest id
    reachable by links (null ids come last). Equal sets are one document here, however many copies there are.

    Shingles are ordered by rarity over all documents. Linked documents share two of their rarest shingles that follow
    each other in that order (``keys``), so documents that are connected by those form clusters, and all links lie
    inside clusters. Single shingles would not do: the larger the corpus, the more texts share a rare one by chance, until
    most texts are one cluster, of which every block meets every other. Clusters are cut into blocks of
    bounded size; every pair of blocks is a group of its own, in which ``_Sets.search`` finds the links over inverted
    lists. Documents that are connected already are not compared again, and only connecting links leave a group.
    """
    texts = keyed(docs, id_col, text_col)
    found = materialize(_described(texts, size, percent, rarity(texts, size)), "described")
    reps = (
        found.where("n > 0")
        .groupBy("s1", "s2")
        .agg(F.min("_id").alias("low"), *[F.first(c).alias(c) for c in ("_id", "_h", "n")], F.count("*").alias("copies"))
        .withColumn("uid", F.monotonically_increasing_id())
    )
    reps = materialize(reps, "sets")
    # keys of equal sets count once; a bitmap tells most of the others, which need not be moved for that
    named = sifted(found.where("size(keys) > 0"), "s1", sieve(reps.where("copies > 1"), "s1"))
    once = named.where("_maybe").groupBy("s1", "s2").agg(F.first("keys").alias("keys"))
    every = named.where("NOT _maybe").select("s1", "keys").unionByName(once.select("s1", "keys"))
    postings = every.select("s1", F.explode("keys").alias("key"))
    hubs = postings.withColumn("hub", F.min("s1").over(Window.partitionBy("key")))
    edges = hubs.where("s1 != hub").selectExpr("s1 AS a", "hub AS b").distinct()
    clusters = components(materialize(edges, "candidates"))
    members = materialize(reps.join(clusters.withColumnRenamed("v", "s1"), "s1").select("uid", "root", "_id", "_h", "n"), "members")
    totals = members.groupBy("root").agg(F.expr(f"CAST(CEIL(sum(n) / {BLOCK_SHINGLES}D) AS INT)").alias("blocks"))
    members = materialize(members.join(materialize(totals, "totals"), "root"), "members")
    pack = F.pandas_udf(lambda x: x.map(lambda t: zstandard.compress(t.encode(), 3)), "binary")
    wanted = sifted(texts, "_h", sieve(members, "_h")).where("_maybe")
    one = wanted.dropDuplicates(["_id", "_h"]).alias("t")
    grouped = (
        one.join(members.alias("m"), same_row("t", "m"))
        .select("uid", "root", "blocks", pack("_text").alias("text"))
        .withColumn("own", F.expr("CAST(pmod(xxhash64(uid), blocks) AS INT)"))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .select("uid", "root", "own", "text", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"))
    )

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        known = WordIds()
        sets = [shingles(zstandard.decompress(t).lower().split(), known, size) for t in pdf["text"]]
        uid = pdf["uid"].to_numpy()
        links = spanning_links(sets, pdf["own"].to_numpy(), percent) if pdf["one"].iloc[0] == pdf["two"].iloc[0] or pdf["own"].nunique() > 1 else []
        return pd.DataFrame({"a": [uid[i] for i, _ in links], "b": [uid[j] for _, j in links]}, dtype="int64")

    links = materialize(grouped.groupBy("root", "one", "two").applyInPandas(search, "a long, b long"), "links")
    joined = components(links)
    names = reps.select("uid", "s1", "s2", "low").join(joined.withColumnRenamed("v", "uid"), "uid", "left")
    names = materialize(names.withColumn("root", F.coalesce("root", "uid")), "names")
    lows = materialize(names.groupBy("root").agg(F.min("low").alias("component")), "lows")
    sets = materialize(names.join(lows, "root").select("s1", "s2", "root", "component"), "classes")
    return (
        found.drop("keys")
        .join(sets, ["s1", "s2"], "left")
        .select("_id", "_h", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("_id")).alias("component_id"), "root")
    )


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of ``linked``: the smallest id (null last), of equal ids the smallest text digest.

    Rows without words are linked with nothing, so all of them stay. Columns are those of ``docs``.
    """
    groups = linked(docs, size, percent, id_col, text_col)
    order = F.struct(F.isnull("_id").alias("_none"), "_id", "_h")
    best = groups.where("n_shingles > 0").groupBy("root").agg(F.min(order).alias("b")).select("b._none", "b._id", "b._h")
    best = materialize(best.select(F.coalesce("_id", F.lit(0)).alias("_id"), "_none", "_h"), "best")
    text, number = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col).cast("long")
    spoken = text.rlike(r"[^\x20\x09-\x0D]").alias("_spoken")
    names = [F.coalesce(number, F.lit(0)).alias("_id"), F.isnull(number).alias("_none"), F.xxhash64(text).alias("_h")]
    named = docs.select(boxed(docs), *names, spoken)
    # the join and the removal of repeated rows share one exchange
    kept = named.where("_spoken").join(best, ["_id", "_none", "_h"], "left_semi").dropDuplicates(["_id", "_none", "_h"])
    return kept.select("_row").unionByName(named.where("NOT _spoken").select("_row")).select(*unboxed(docs))
