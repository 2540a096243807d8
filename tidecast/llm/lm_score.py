"""Masked pseudo-likelihood of documents under a small bidirectional window network trained in numpy."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.llm.tables import blocks, boxed, text_bytes
from tidecast.operators.rank import numbered
from tidecast.session import materialize

#: Words on each side that predict the one between.
SIDE = 2
BATCH = 1024


class Model(NamedTuple):
    """``hidden = tanh(sum of one embedding per place)``; a softmax over groups of neighbouring classes, then one over the
    classes of the target's group, so that a word costs about twice the square root of the number of classes."""

    inside: np.ndarray  # places x classes x hidden
    groups: np.ndarray  # hidden x groups
    group_bias: np.ndarray
    out: np.ndarray  # groups x (classes of a group) x hidden
    bias: np.ndarray  # groups x (classes of a group)

    def hidden(self, context: np.ndarray) -> np.ndarray:
        total = self.inside[0].take(context[:, 0], axis=0)
        for i in range(1, len(self.inside)):
            total += self.inside[i].take(context[:, i], axis=0)
        return np.tanh(total, out=total)

    def runs(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """An order of the targets by group, group and member of each in that order, and ``(group, first, end)`` of every run."""
        group, member = np.divmod(target, self.bias.shape[1])
        order = np.argsort(group.astype(np.int16), kind="stable")
        ends = np.bincount(group, minlength=len(self.bias)).cumsum().tolist()
        return order, group[order], member[order], [(g, a, b) for g, (a, b) in enumerate(zip([0, *ends], ends)) if a < b]

    def parts(self, hidden: np.ndarray, runs: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For rows in order of their groups: the hidden values with a one behind them, and the scores of all groups and
        of all members of the row's group, less the largest. Scores stand in columns, so that sums run along the rows."""
        wide = np.empty((len(hidden), hidden.shape[1] + 1), hidden.dtype)
        wide[:, :-1], wide[:, -1] = hidden, 1
        of_group = np.vstack([self.groups, self.group_bias]).T @ wide.T
        own = np.concatenate([self.out, self.bias[:, :, None]], axis=2)
        of_member = np.empty((self.bias.shape[1], len(hidden)), hidden.dtype)
        for g, a, b in runs:
            np.matmul(own[g], wide[a:b].T, out=of_member[:, a:b])
        of_group -= of_group.max(axis=0)
        of_member -= of_member.max(axis=0)
        return wide, of_group, of_member

    def log_probs(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        order, group, member, runs = self.runs(target)
        _, of_group, of_member = self.parts(self.hidden(context[order]), runs)
        rows, out = np.arange(len(target)), np.empty(len(target), of_group.dtype)
        both = np.exp(of_group).sum(axis=0) * np.exp(of_member).sum(axis=0)
        out[order] = of_group[group, rows] + of_member[member, rows] - np.log(both)
        return out


#: Score of the places that fill up the last group: no class.
NONE = -1e9


def start_model(counts: np.ndarray, hidden: int, seed: int) -> Model:
    """Small random embeddings; the biases are the log-frequencies of groups and classes, so training starts at the unigram model."""
    rng = np.random.default_rng(seed)
    classes = len(counts)
    size = math.isqrt(classes - 1) + 1
    number = -(-classes // size)
    share = np.zeros(number * size)
    share[:classes] = (counts + 1) / (counts.sum() + classes)
    share = share.reshape(number, size)
    of_group = share.sum(axis=1)
    bias = np.where(share > 0, np.log(np.maximum(share, 1e-300) / of_group[:, None]), NONE)
    return Model(
        rng.normal(0, 0.1, (2 * SIDE, classes, hidden)).astype(np.float32),
        rng.normal(0, 0.1, (hidden, number)).astype(np.float32),
        np.log(of_group).astype(np.float32),
        rng.normal(0, 0.1, (number, size, hidden)).astype(np.float32),
        bias.astype(np.float32),
    )


class Classes(dict):
    """Word -> class: the most frequent words have one of their own, the others share ``shared`` by their hash."""

    def __init__(self, words: list[bytes], shared: int):
        super().__init__({w: i + shared + 1 for i, w in enumerate(words)})
        self.own, self.shared = len(words), shared
        #: The words with classes of their own and their numbers.
        self.words, self.counts = words, [0] * len(words)
        #: Words after those with classes of their own, the most frequent first, and their numbers.
        self.known: list[tuple[bytes, int]] = []
        #: Number of all words in each shared class.
        self.totals = np.zeros(shared)
        #: Digests (``_word``) and numbers (``n``, 2 or more) of all words that are neither of these; None without any.
        self.rest: DataFrame | None = None

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.own + 200_000:
            for w in [w for w, c in self.items() if c <= self.shared]:
                del self[w]
        c = self[word] = xxhash.xxh3_64_intdigest(word) % self.shared + 1
        return c

    @property
    def size(self) -> int:
        """Number of classes; 0 stands before the first and after the last word."""
        return self.own + self.shared + 1


def digest(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


class Shares(dict):
    """Word -> place in ``classes`` and ``logs``, the logarithm of its share of its class.

    Place 0 stands before the first and after the last word. Places from ``rare`` on are those of words that are not
    held here, one a class, as if counted once: a class keeps that much for a word that no text had.
    """

    def __init__(self, words: list[bytes], shared: int, known: list[tuple[bytes, int]], totals: np.ndarray):
        super().__init__({w: i + 1 for i, w in enumerate([*words, *(w for w, _ in known)])})
        self.shared, self.rare = shared, len(self) + 1
        of_known = np.array([xxhash.xxh3_64_intdigest(w) % shared for w, _ in known], np.int64)
        every = np.log(totals + 1)
        self.classes = np.concatenate([[0], np.arange(len(words)) + shared + 1, of_known + 1, np.arange(shared) + 1]).astype(np.int64)
        self.logs = np.concatenate([np.zeros(len(words) + 1), np.log([float(n) for _, n in known]) - every[of_known], -every])

    def __missing__(self, word: bytes) -> int:
        return self.rare + xxhash.xxh3_64_intdigest(word) % self.shared


class Encoded(NamedTuple):
    """Rows that ``encode`` has written, and the classes of their words, as ``fit`` and ``score`` take them."""

    rows: DataFrame
    classes: Classes
    columns: list[str]


def width(classes: int) -> type[np.signedinteger]:
    """Whole numbers that hold any class."""
    return np.int16 if classes < 1 << 15 else np.int32


def contexts(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Classes left and right of the padded places ``at``, nearest last on the left and first on the right."""
    return np.stack([ids[at + d] for d in range(-SIDE, SIDE + 1) if d], axis=1)


def targets(size: int, k: int, rounds: int) -> np.ndarray:
    """Padded places of the words that round ``k`` takes as targets; over all rounds every word is one exactly once."""
    return np.arange(SIDE + k, SIDE + size, rounds)


class Trainer:
    """Mini-batch gradient descent with per-parameter steps (Adagrad)."""

    def __init__(self, model: Model, rate: float):
        self.model, self.rate = Model(*(x.copy() for x in model)), rate
        self.sums = Model(*(np.full_like(x, 1e-6) for x in model))
        places, classes, hidden = model.inside.shape
        # two neighbouring numbers are added as one complex number
        self.pair = np.result_type(model.inside, 1j) if hidden % 2 == 0 else model.inside.dtype
        if places * classes < 1 << 15:
            each = hidden // 2 if hidden % 2 == 0 else hidden
            self.cells = np.arange(classes * each).reshape(classes, each)
        else:
            self.cells = None

    def embedding_slopes(self, context: np.ndarray, back: np.ndarray) -> tuple[object, np.ndarray]:
        """``back`` summed by place and class: for all classes where they are few, else for those of the batch."""
        places, classes = self.model.inside.shape[:2]
        if self.cells is not None:
            total, added = np.zeros_like(self.model.inside), back.view(self.pair).ravel()
            held = np.empty((len(context), self.cells.shape[1]), np.int64)
            for i in range(places):
                self.cells.take(context[:, i], axis=0, out=held, mode="clip")
                np.add.at(total[i].view(self.pair).reshape(-1), held.ravel(), added)
            return slice(None), total
        keys = (context + np.arange(places, dtype=np.int64) * classes).ravel(order="F")
        sort = np.argsort(keys, kind="stable")
        keys = keys[sort]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        return np.divmod(keys[first], classes), np.add.reduceat(back.take(sort % len(context), axis=0), first, axis=0)

    def gradients(self, context: np.ndarray, target: np.ndarray) -> list[tuple[str, object, np.ndarray]]:
        """``(parameter, where, slope)`` of the mean loss of a batch; only what the batch touches."""
        model, n, rows = self.model, len(target), np.arange(len(target))
        order, group, member, runs = model.runs(target)
        context = context[order]
        hidden = model.hidden(context)
        wide, *scores = model.parts(hidden, runs)
        error, inner = (np.exp(x, out=x) for x in scores)
        for x, at in ((error, group), (inner, member)):
            x /= x.sum(axis=0) * n
            x[at, rows] -= 1 / n
        back, own = np.ascontiguousarray(error.T @ model.groups.T), np.empty_like(hidden)
        slopes = np.empty((len(runs), len(inner), wide.shape[1]), hidden.dtype)
        for i, (g, a, b) in enumerate(runs):
            np.matmul(inner[:, a:b].T, model.out[g], out=own[a:b])
            np.matmul(inner[:, a:b], wide[a:b], out=slopes[i])
        back += own
        back *= 1 - hidden * hidden
        top = wide.T @ error.T
        which = slice(None) if len(runs) == len(model.bias) else np.array([g for g, _, _ in runs])
        out = [("groups", slice(None), top[:-1]), ("group_bias", slice(None), top[-1])]
        out += [("out", which, slopes[:, :, :-1]), ("bias", which, slopes[:, :, -1])]
        return [*out, ("inside", *self.embedding_slopes(context, back))]

    def step(self, context: np.ndarray, target: np.ndarray) -> None:
        for name, where, slope in self.gradients(context, target):
            value, sums = getattr(self.model, name), getattr(self.sums, name)
            total = slope * slope
            total += sums[where]
            sums[where] = total
            np.sqrt(total, out=total)
            np.divide(slope, total, out=total)
            total *= self.rate
            value[where] -= total


def word_counts(texts: DataFrame) -> DataFrame:
    """Words of all texts, lower-cased (A-Z), with their numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def told() -> pa.RecordBatch:
            out = [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(out, names=["word", "n"])

        for batch in batches:
            data, starts = text_bytes(batch.column(0))
            for i in range(len(batch)):
                seen.update(data[starts[i] : starts[i + 1]].tobytes().lower().split())
            if len(seen) > 200_000:
                yield told()
                seen.clear()
        yield told()

    return texts.select("_text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def learned_classes(docs: DataFrame, words: int = 447, shared: int = 64, text_col: str = "text", known: int = 100_000) -> Classes:
    """The classes of the words of all texts, from the counts of all words.

    The counts of the ``known`` most frequent words are held, the others stay a table that grows with the corpus.
    """
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    counts = materialize(word_counts(texts), "words")
    # places are found by ranges of the sorted words, so the driver gets these words once, not the best of every task
    ranked = numbered(counts, ["n", "word"], "place", descending=["n"]).where(F.col("place") < max(known, words))
    top = [(bytes(r.word), r.n) for r in sorted(ranked.collect(), key=lambda r: r.place)]
    classes = Classes([w for w, _ in top[:words]], shared)
    classes.counts = [n for _, n in top[:words]]
    classes.known = top[words:]
    on_top = frozenset(w for w, _ in top)

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(shared, np.int64)
        for batch in batches:
            of = np.fromiter((xxhash.xxh3_64_intdigest(w) % shared for w in batch.column(0).to_pylist()), np.int64, len(batch))
            np.add.at(sums, of, batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(range(shared)), pa.array(sums)], names=["c", "n"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [(digest(w), n) for w, n in zip(*[c.to_pylist() for c in batch.columns], strict=True) if w not in on_top]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ([h for h, _ in kept], [n for _, n in kept])], names=["_word", "n"])

    # the sums of the classes of all words, less those with a class of their own
    for r in counts.mapInArrow(share, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).collect():
        classes.totals[r.c] = r.n
    for w, n in top[:words]:
        classes.totals[xxhash.xxh3_64_intdigest(w) % shared] -= n
    if len(top) == max(known, words):
        classes.rest = counts.where("n > 1").mapInArrow(others, "_word long, n long")
    return classes


def encode(docs: DataFrame, classes: Classes, text_col: str = "text", keep: list[str] | None = None, write: bool = True) -> Encoded:
    """Every text as the classes of its words, written once for all that ``fit`` and ``score`` do with it.

    A row holds the columns ``keep`` of ``docs`` (default: all), ``n_tokens``, ``_classes`` (whole numbers of ``width``, ``SIDE``
    zeros before and behind), ``_log`` (the words' shares of their classes, summed logarithms) and ``_rare`` (digests of
    the words whose counts are not held; they count once so far).
    """
    columns = docs.columns if keep is None else keep
    bare = docs.select(*[F.col(f"`{c}`") for c in columns]).drop("n_tokens", "log_prob", "mean_log_prob")
    names, shared, known, totals = classes.words, classes.shared, classes.known, classes.totals
    kind = width(classes.size)
    row = boxed(bare) if bare.columns else F.lit(True).alias("_row")
    texts = docs.select(row, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    schema = T.StructType(texts.select("_row").schema.fields).add("n_tokens", "long").add("_classes", "binary")
    schema = schema.add("_log", "double").add("_rare", T.ArrayType(T.LongType()))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Shares(names, shared, known, totals)
        place, of_place = places.__getitem__, places.classes.astype(kind)
        for batch in batches:
            data, starts = text_bytes(batch.column(1))
            n, logs = np.zeros(len(batch), np.int64), np.zeros(len(batch))
            told: list[bytes] = []
            rare: list[list[int]] = []
            for i in range(len(batch)):
                words = data[starts[i] : starts[i + 1]].tobytes().lower().split()
                at = np.zeros(len(words) + 2 * SIDE, np.int64)
                at[SIDE : SIDE + len(words)] = np.fromiter(map(place, words), np.int64, len(words))
                n[i], logs[i] = len(words), places.logs.take(at).sum()
                told.append(of_place.take(at).tobytes())
                rare.append([digest(words[x]) for x in np.flatnonzero(at >= places.rare) - SIDE])
            new = [pa.array(n), pa.array(told, pa.binary()), pa.array(logs), pa.array(rare, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *new], names=schema.names)

    rows = texts.mapInArrow(tell, schema).withColumn("_id", F.monotonically_increasing_id())
    return Encoded(materialize(rows, "encoded") if write else rows, classes, bare.columns)


def encoded_ids(column: pa.Array, kind: type[np.signedinteger]) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column ``_classes`` behind each other, and where each starts (one more entry: the end)."""
    if not len(column):
        return np.zeros(0, kind), np.zeros(1, np.int64)
    data, starts = text_bytes(column)
    size = np.dtype(kind).itemsize
    return data[starts[0] : starts[-1]].view(kind), (starts - starts[0]) // size


def fit(
    docs: DataFrame | Encoded,
    words: int = 447,
    shared: int = 64,
    hidden: int = 16,
    rounds: int = 2,
    rate: float = 0.05,
    seed: int = 7,
    text_col: str = "text",
    known: int = 100_000,
) -> tuple[Model, Classes]:
    """Train on all documents, or on what ``encode`` has made of them (with the classes that are there).

    Counts of all words give the classes; those of the ``known`` most frequent words are held, the others stay a table
    that grows with the corpus and that ``score`` joins. In every round each task descends from the same model over its documents,
    taking every ``rounds``-th word of each as target (each round begins one word later, so that every word is a target
    of one round), and the resulting models are averaged by their numbers of targets. The sums run as a Spark aggregation
    over single parameters; the driver holds ``known`` words and one model, whose sizes the arguments fix. Without any word the model stays as it starts.
    """
    if isinstance(docs, DataFrame):
        docs = encode(docs, learned_classes(docs, words, shared, text_col, known), text_col, keep=[])
    classes, kind = docs.classes, width(docs.classes.size)
    model = start_model(np.array([0, *classes.totals, *classes.counts]), hidden, seed)

    for k in range(rounds):
        now = model

        def descend(batches: Iterator[pa.RecordBatch], now: Model = now, k: int = k) -> Iterator[pa.RecordBatch]:
            trainer, n = Trainer(now, rate), 0
            held: list[tuple[np.ndarray, np.ndarray]] = []
            waiting = 0

            def train() -> None:
                context, target = (np.concatenate(x) for x in zip(*held, strict=True))
                order = np.random.default_rng(seed + k + n).permutation(len(target))
                for b in range(0, len(order), BATCH):
                    trainer.step(context[order[b : b + BATCH]], target[order[b : b + BATCH]])

            for batch in batches:
                ids, starts = encoded_ids(batch.column(0), kind)
                for first, end in zip(starts.tolist(), starts[1:].tolist()):
                    at = first + targets(end - first - 2 * SIDE, k, rounds)
                    if len(at):
                        held.append((contexts(ids, at), ids[at]))
                        n, waiting = n + len(at), waiting + len(at)
                    if waiting >= 64 * BATCH:
                        train()
                        held, waiting = [], 0
            if held:
                train()
            flat = np.concatenate([x.reshape(-1) for x in trainer.model]).astype(np.float64) * n
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([flat])], names=["n", "weights"])

        models = materialize(docs.rows.select("_classes").mapInArrow(descend, "n long, weights array<double>"), "models")
        taken = models.agg(F.sum("n").alias("n")).first().n
        if not taken:
            continue
        sums = models.select(F.posexplode("weights").alias("i", "w")).groupBy("i").agg(F.sum("w").alias("w")).collect()
        flat = np.zeros(len(sums))
        for r in sums:
            flat[r.i] = r.w / taken
        cuts = np.cumsum([x.size for x in model])[:-1]
        model = Model(*(p.reshape(x.shape).astype(np.float32) for p, x in zip(np.split(flat, cuts), model, strict=True)))
    return model, classes


def score(docs: DataFrame | Encoded, model: Model, classes: Classes, text_col: str = "text") -> DataFrame:
    """Every row with ``n_tokens``, ``log_prob`` (natural logarithms, summed over all words, each given its neighbours)
    and ``mean_log_prob`` added. Null and empty texts have no words, sum 0 and a null mean; any length is scored whole.
    Columns named like the added ones are replaced; an empty table gives an empty result. Rows that ``encode`` has
    written keep the columns that are there."""
    if isinstance(docs, DataFrame):
        docs = encode(docs, classes, text_col, write=classes.rest is not None)
    kind = width(classes.size)
    rows = docs.rows.select("_id", "_row", "n_tokens", "_log", "_classes")
    schema = T.StructType(rows.schema.fields[:3]).add("log_prob", "double")

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts = encoded_ids(batch.column(4), kind)
            sums = batch.column(3).to_numpy().copy()
            for a, b in blocks(starts, 1 << 16):
                at = np.ones(starts[b] - starts[a], bool)
                for d in range(SIDE):
                    at[starts[a:b] - starts[a] + d] = at[starts[a + 1 : b + 1] - starts[a] - 1 - d] = False
                at = starts[a] + np.flatnonzero(at)
                owner = np.repeat(np.arange(a, b), np.diff(starts[a : b + 1]) - 2 * SIDE)
                for k in range(0, len(at), 4 * BATCH):
                    now = at[k : k + 4 * BATCH]
                    np.add.at(sums, owner[k : k + 4 * BATCH], model.log_probs(contexts(ids, now), ids[now]).astype(float))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums)], names=schema.names)

    found, log_prob = rows.mapInArrow(tell, schema), F.col("log_prob")
    if classes.rest is not None:
        # words that are not held counted once so far
        more = docs.rows.select("_id", F.explode("_rare").alias("_word")).join(classes.rest, "_word")
        more = more.groupBy("_id").agg(F.sum(F.log("n")).alias("_more"))
        found, log_prob = found.join(more, "_id", "left"), log_prob + F.coalesce("_more", F.lit(0.0))
    found = found.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns], "n_tokens", log_prob.alias("log_prob"))
    return found.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")))
