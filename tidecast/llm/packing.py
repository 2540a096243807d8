"""Best-fit packing of token sequences: best-two-fit on the histogram of lengths."""

from __future__ import annotations

import re
import struct
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidecast.llm.tables import text_bytes
from tidecast.session import shared_path

#: Id that closes a document.
END = 1


class _Lengths:
    """Lengths that still have pieces, in order."""

    def __init__(self, counts: dict[int, int]):
        self.left = dict(counts)
        self.order = sorted(counts)

    def largest(self, most: int) -> int:
        """The largest length of at most ``most``, or 0."""
        i = bisect_right(self.order, most)
        return self.order[i - 1] if i else 0

    def take(self, length: int, n: int) -> None:
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]
            self.order.remove(length)


def best_pair(lengths: Sequence[int], left: dict[int, int], gap: int) -> tuple[int, int]:
    """The two lengths ``a >= b`` with the largest sum of at most ``gap``, or zeros."""
    best, low, high = (0, 0), 0, bisect_right(lengths, gap) - 1
    while low <= high:
        a, b = lengths[high], lengths[low]
        if a + b > gap or (low == high and left[a] < 2):
            high -= 1
            continue
        if a + b > sum(best):
            best = (a, b)
        low += 1
    return best


def plan(counts: dict[int, int], size: int) -> list[tuple[int, dict[int, int]]]:
    """Fill sequences of ``size`` tokens: ``(how many sequences, {length: pieces in each})``.

    Each sequence is filled greedily, the largest piece that fits first. If it is not full then, its smallest piece is
    taken out again where two unpacked pieces fit the wider gap more tightly. Pieces of one length are alike, so a
    filling is used as often as its lengths allow: every step exhausts a length or all but a part of it, and neither
    time nor memory depends on how many pieces there are.
    """
    todo, out = _Lengths({n: c for n, c in counts.items() if c}), []
    while todo.order:
        items: dict[int, int] = {}
        gap, n = size, todo.largest(size)
        while n:
            items[n] = min(gap // n, todo.left[n])
            gap -= items[n] * n
            n = todo.largest(min(gap, n - 1))
        if gap and len(items) + (max(items.values()) > 1) > 1:
            smallest = min(items)
            free = {n: c - items.get(n, 0) for n, c in todo.left.items()}
            wider = gap + smallest
            a, b = best_pair([n for n in todo.order if free[n] > 0 and n <= wider], free, wider)
            if a and a + b > smallest:
                items[smallest] -= 1
                for n in (a, b):
                    items[n] = items.get(n, 0) + 1
                items = {n: c for n, c in items.items() if c}
        times = min(todo.left[n] // k for n, k in items.items())
        out.append((times, items))
        for n, k in items.items():
            todo.take(n, k * times)
    return out


class _Encoded(dict):
    """Ids of lower-cased words as bytes (little-endian, 32 bits).

    The tokenizer lower-cases, and never joins characters across ASCII white space or between an ASCII letter or digit
    and the marks of ``TAIL``, so words and the marks behind them are looked up apart. Two generations of at most ``most``
    words are remembered: what is not asked for while one fills up is forgotten. Special strings are sought before the
    text is lower-cased, so a word that may hold one is looked up as it is written.

    A word of Latin letters only is one pre-token, each letter standing for itself, so it goes to the tokenizer's model
    at once; letters for which the tokenizer's own first steps say otherwise, and all other words, take the long way.
    """

    TAIL = b".,!?;:*#%$&|"

    def __init__(self, vocabulary: str, most: int = 300_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.vocabulary, self.most, self.tokenizer = vocabulary, most, Tokenizer.from_file(vocabulary)
        self.older: dict[bytes, bytes] = {}
        added = self.tokenizer.get_added_tokens_decoder().values()
        #: strings that the tokenizer looks for before it lower-cases
        self.special = [t.content.lower().encode() for t in added if not t.normalized]
        self.model = self.tokenizer.model
        self.letters = self._letters()
        told = "".join(map(chr, self.letters))
        pairs = "".join(a + b for a in told for b in told)  # every letter behind every other
        if self._first_steps(pairs) != [pairs.translate(self.letters)] or any(set(t.content) <= set(told) for t in added):
            self.letters, told = {}, ""
        self.plain = re.compile(f"[{told}]+" if told else r"(?!)").fullmatch

    def _first_steps(self, text: str) -> list[str]:
        """What the model gets of a text: pre-tokens of the normalized text."""
        normalizer, splitter = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        if normalizer is not None:
            text = normalizer.normalize_str(text)
        return [x for x, _ in splitter.pre_tokenize_str(text)] if splitter is not None else []

    def _letters(self) -> dict[int, str]:
        """Letters up to U+00FF (none of them combines with another) and what the model gets of each."""
        found = ((c, self._first_steps(chr(c))) for c in range(256) if chr(c).isalpha())
        return {c: steps[0] for c, steps in found if len(steps) == 1}

    def _ids(self, word: str) -> list[int]:
        if self.plain(word):
            return [t.id for t in self.model.tokenize(word.translate(self.letters))]
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def words(self, text: bytes) -> list[bytes]:
        """Words of a text as they are looked up: lower-cased, but for those that hold a special string in any case."""
        low = text.lower()
        if not any(s in low for s in self.special):
            return low.split()
        pairs = zip(low.split(), text.split(), strict=True)
        return [own if any(s in word for s in self.special) else word for word, own in pairs]

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        if (out := self.older.get(word)) is None:
            core = word.rstrip(self.TAIL)
            if len(core) < len(word) and (core[-1:].isalnum() or self.plain(core.decode())):
                out = self[core] + self[word[len(core) :]]
            else:
                ids = self._ids(word.decode())
                out = struct.pack(f"<{len(ids)}I", *ids)
        self[word] = out
        return out


_ENCODED: list[_Encoded] = []  # of this Python worker, which serves many tasks


def _encoded(vocabulary: str) -> _Encoded:
    if not _ENCODED or _ENCODED[0].vocabulary != vocabulary:
        _ENCODED[:] = [_Encoded(vocabulary)]
    return _ENCODED[0]


def token_pieces(docs: DataFrame, vocabulary: str, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts as token ids, cut into pieces of at most ``size``: written once, because packing needs all lengths first.

    ``_part`` and ``_k`` number the pieces of one length within the task that wrote them.
    """
    end = np.array([END], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part, seen = _encoded(vocabulary), TaskContext.get().partitionId(), {}
        for batch in batches:
            data, starts = text_bytes(batch.column(1))
            rows, held = [], 0
            for i in range(len(batch)):
                words = known.words(data[starts[i] : starts[i + 1]].tobytes())
                ids = b"".join(map(known.__getitem__, words)) + end
                for piece, at in enumerate(range(0, len(ids), 4 * size)):
                    own = ids[at : at + 4 * size]
                    n = len(own) // 4
                    seen[n] = k = seen.get(n, -1) + 1
                    rows.append((i, piece, at // 4, n, k, own))
                    held += len(own)
                if held > 1 << 23 or (i == len(batch) - 1 and rows):
                    at, piece, start, length, k, own = (list(x) for x in zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(at)), pa.array(piece, pa.int32()), pa.array(start, pa.int64())]
                        + [pa.array(length, pa.int32()), pa.array(own, pa.binary()), pa.array([part] * len(at), pa.int32())]
                        + [pa.array(k, pa.int64())],
                        names=["_id", "piece", "start", "length", "ids", "_part", "_k"],
                    )
                    rows, held = [], 0

    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    pieces = texts.mapInArrow(cut, "_id long, piece int, start long, length int, ids binary, _part int, _k long")
    path = shared_path(docs.sparkSession, "pieces")
    pieces.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(pieces.schema).parquet(path)


def pack(docs: DataFrame, vocabulary: str, size: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Place the tokens of all texts in sequences of ``size``: one row a piece.

    Columns: the id, ``piece``, ``start`` (ids of the text before it), ``length``, ``ids`` (binary, 32 bits each),
    ``ids_crc32``, ``sequence_id`` and ``offset``. Only texts longer than ``size`` are cut. Null and empty texts are the
    closing id alone. Repeated rows are packed as often as they occur. An empty table gives an empty result.

    The driver sees the number of pieces of each length (at most ``size`` numbers) and plans fillings for them; a piece
    finds its place by its length and its rank among pieces of that length, which is a sum of counts.
    """
    pieces = token_pieces(docs, vocabulary, size, id_col, text_col)
    counts = pieces.groupBy("_part", "length").count()
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("_base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    total = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}

    # for every length: from which rank a filling holds it, how often in one sequence, its first sequence, its place there
    table, used, sequence = [], dict.fromkeys(total, 0), 0
    for times, items in plan(total, size):
        place = 0
        for n in sorted(items, reverse=True):
            table.append((n << 44 | used[n], items[n], sequence, place))
            used[n] += items[n] * times
            place += n * items[n]
        sequence += times
    keys, each, firsts, places = (np.array(x, np.int64) for x in zip(*sorted(table), strict=True)) if table else [np.zeros(0, np.int64)] * 4

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        i = np.searchsorted(keys, n << 44 | r, side="right") - 1
        q = r - (keys[i] & ((1 << 44) - 1))
        return pd.DataFrame({"sequence_id": firsts[i] + q // each[i], "offset": places[i] + q % each[i] * n})

    found = (
        pieces.withColumn("ids_crc32", F.crc32("ids"))
        .join(bases, ["_part", "length"])
        .withColumn("_place", placed("length", F.col("_base") + F.col("_k")))
    )
    return found.select(F.col("_id").alias(id_col), "piece", "start", "length", "ids", "ids_crc32", "_place.sequence_id", "_place.offset")
