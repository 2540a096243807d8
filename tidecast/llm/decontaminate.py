"""Benchmark decontamination by a prefix-filtered set join of word windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.llm.tables import boxed, text_bytes, unboxed

#: Words are made of digits, ASCII letters (lower-cased) and all bytes of other characters; the rest separates them.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
#: Bytes of benchmark text whose windows are searched for in one pass over the documents.
PASS_BYTES = 64 << 20
#: Codes of shingles are cut to so many bits; a clash only costs a comparison of words.
_CODE = (1 << 62) - 1
#: Words of a shingle, the token of the set join.
SHINGLE = 3


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Windows:
    """The distinct windows of benchmark items, their shingles, and the numbers of their words."""

    def __init__(self, items: list[tuple[int | None, str | None]], size: int):
        self.words: dict[bytes, int] = {}
        self.items: list[int | None] = []
        #: window (its word numbers) -> items that have it
        self.owners: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            w = [self.words.setdefault(x, len(self.words) + 1) for x in words_of((text or "").encode())]
            if not w:
                continue
            self.items.append(item)
            for i in range(max(1, len(w) - size + 1)):
                self.owners.setdefault(tuple(w[i : i + size]), set()).add(len(self.items) - 1)
        self.base = len(self.words) + 1
        #: shingle length -> sorted codes; an item of fewer words than a shingle is one shingle
        self.codes: dict[int, np.ndarray] = {}
        for k in sorted({min(SHINGLE, len(w)) for w in self.owners}):
            found = {self.code(w[i : i + k]) for w in self.owners if min(SHINGLE, len(w)) == k for i in range(len(w) - k + 1)}
            self.codes[k] = np.array(sorted(found), np.int64)

    def code(self, shingle: tuple[int, ...]) -> int:
        out = 0
        for w in shingle:
            out = out * self.base + w
        return out & _CODE

    def places(self, numbers: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Where shingles of length ``k`` of a document are shingles of a window, and which."""
        if len(numbers) < k or k not in self.codes:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        n = len(numbers) - k + 1
        whole, code = numbers[:n] > 0, numbers[:n].copy()
        for j in range(1, k):
            whole &= numbers[j : n + j] > 0
            code = code * self.base + numbers[j : n + j]
        at = np.flatnonzero(whole)
        code = code[at] & _CODE
        i = np.minimum(np.searchsorted(self.codes[k], code), len(self.codes[k]) - 1)
        hit = self.codes[k][i] == code
        return at[hit], i[hit]

    def numbers(self, text: bytes) -> np.ndarray:
        words, get = words_of(text), self.words.get
        return np.fromiter((get(w, 0) for w in words), np.int64, len(words))


def _prefixes(windows: Windows, counts: dict[int, np.ndarray]) -> dict[int, dict[int, list[tuple[int, tuple[int, ...]]]]]:
    """By shingle length and shingle: the windows that join on it, and where in them it stands.

    A window is contained only if all its shingles are, so the necessary prefix is its rarest one.
    """
    out: dict[int, dict[int, list[tuple[int, tuple[int, ...]]]]] = {k: {} for k in windows.codes}
    for w in windows.owners:
        k = min(SHINGLE, len(w))
        at = [int(np.searchsorted(windows.codes[k], windows.code(w[i : i + k]))) for i in range(len(w) - k + 1)]
        rarest = min(range(len(at)), key=lambda i: (counts[k][at[i]], at[i]))
        out[k].setdefault(at[rarest], []).append((rarest, w))
    return out


def _counts(texts: DataFrame, windows: Windows) -> dict[int, np.ndarray]:
    """How many documents have each shingle of the benchmark, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {k: np.zeros(len(c), np.int64) for k, c in windows.codes.items()}
        for batch in batches:
            data, starts = text_bytes(batch.column(0))
            for i in range(len(batch)):
                numbers = windows.numbers(data[starts[i] : starts[i + 1]].tobytes())
                for k in seen:
                    seen[k][np.unique(windows.places(numbers, k)[1])] += 1
        for k, n in seen.items():
            own = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), k)), pa.array(own), pa.array(n[own])], names=["k", "i", "n"])

    out = {k: np.zeros(len(c), np.int64) for k, c in windows.codes.items()}
    for r in texts.mapInArrow(count, "k long, i long, n long").groupBy("k", "i").agg(F.sum("n").alias("n")).collect():
        out[r.k][r.i] = r.n
    return out


def _search(texts: DataFrame, windows: Windows) -> DataFrame:
    """``texts`` with the places hit by windows (``_hit``, ascending) and the items they are from (``_items``)."""
    prefixes = _prefixes(windows, _counts(texts.select("_text"), windows))
    keys = {k: np.array(sorted(p), np.int64) for k, p in prefixes.items()}
    schema = T.StructType(texts.drop("_text").schema.fields)
    schema = schema.add("_n", "long").add("_hit", T.ArrayType(T.IntegerType())).add("_items", T.ArrayType(T.IntegerType()))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_bytes(batch.column(batch.schema.get_field_index("_text")))
            n, hits, items = [], [], []
            for i in range(len(batch)):
                numbers = windows.numbers(data[starts[i] : starts[i + 1]].tobytes())
                n.append(len(numbers))
                found, own = set(), set()
                for k, prefix in prefixes.items():
                    at, code = windows.places(numbers, k)
                    j = np.minimum(np.searchsorted(keys[k], code), len(keys[k]) - 1)
                    for place, c in zip(at[keys[k][j] == code].tolist(), code[keys[k][j] == code].tolist(), strict=True):
                        for shift, w in prefix[c]:
                            begin = place - shift
                            # bounds of place and length before the words themselves
                            if begin < 0 or begin + len(w) > len(numbers) or numbers[begin] != w[0] or numbers[begin + len(w) - 1] != w[-1]:
                                continue
                            if tuple(numbers[begin : begin + len(w)].tolist()) == w:
                                found.update(range(begin, begin + len(w)))
                                own |= windows.owners[w]
                hits.append(sorted(found))
                items.append(sorted(own))
            rest = [c for name, c in zip(batch.schema.names, batch.columns, strict=True) if name != "_text"]
            names = [x for x in batch.schema.names if x != "_text"]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(n, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.int32()))],
                names=[*names, "_n", "_hit", "_items"],
            )

    return texts.mapInArrow(find, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with ``n_words``, ``hit`` (places of its words inside benchmark windows) and ``items`` (their ids) added.

    A window is ``size`` consecutive words of an item; an item of fewer words, but not none, is one window. ``items``
    are distinct and in the order of their strings; items with a null id are searched for but not listed. Null text has
    no words. Columns of ``docs`` named like the added ones are replaced. An empty benchmark hits nothing.

    The benchmark is small against the documents but its size is checked all the same: the windows of ``PASS_BYTES``
    bytes of it go to the tasks at a time, and a larger benchmark takes more passes over the documents.
    """
    bare = docs.drop("n_words", "hit", "items")
    sized = benchmark.select(F.col("item_id").cast("long").alias("item"), F.col("text").alias("text"))
    total = sized.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    passes = -(-total // PASS_BYTES) or 1
    none = [F.array().cast("array<int>").alias("_all"), F.array().cast("array<long>").alias("_ids")]
    out = bare.select(boxed(bare), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *none)
    for k in range(passes):
        part = sized.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == k)
        windows = Windows([(r.item, r.text) for r in part.collect()], size)
        ids = F.array(*[F.lit(x).cast("long") for x in windows.items]) if windows.items else F.array().cast("array<long>")
        # the text goes through the search twice under two names: as a column of the rows and as what is read
        found = _search(out, windows) if passes == 1 else _search(out.withColumn("_kept", F.col("_text")), windows).withColumnRenamed("_kept", "_text")
        own = F.transform("_items", lambda i: ids[i])
        found = found.withColumns({"_all": F.array_union("_all", "_hit"), "_ids": F.array_union("_ids", own), "n_words": F.col("_n")})
        out = found.drop("_n", "_hit", "_items", "n_words") if k < passes - 1 else found
    named = F.expr("array_sort(transform(array_distinct(filter(_ids, x -> x IS NOT NULL)), x -> CAST(x AS STRING)))")
    return out.select(*unboxed(bare), "n_words", F.sort_array("_all").alias("hit"), named.alias("items"))
