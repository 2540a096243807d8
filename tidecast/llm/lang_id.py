"""Language identification by a byte convolutional network, trained in numpy and applied to fixed-length windows."""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from tidecast.llm.tables import blocks, boxed, text_bytes, unboxed
from tidecast.session import materialize

#: Bytes of a window; the last window of a text is filled up with PAD.
WINDOW, PAD = 128, 256
#: Neighbouring bytes that a filter sees, filters of each such width, and numbers that stand for a byte.
WIDTHS, FILTERS, DEPTH = (2, 3, 4, 5), 16, 8
#: Bounds of the training sample: documents of each language, windows of each document, languages.
DOCS, PER_DOC, LANGUAGES = 600, 8, 256
#: Windows that pass the network together.
BATCH = 512
UNKNOWN = "und"

_LETTER = np.zeros(257, np.float32)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1] = _LETTER[128:256] = 1


#: Which numbers a filter sees: those of the first ``width`` of the bytes at a place.
_SEEN = np.concatenate(
    [np.repeat((np.arange(max(WIDTHS) * DEPTH) < w * DEPTH).astype(np.float32)[:, None], FILTERS, axis=1) for w in WIDTHS], axis=1
)


@dataclass
class Network:
    """Embedding of bytes, filters of several widths, and a softmax over the strongest answer of each filter.

    All filters lie in one matrix as high as the widest of them, so that one product answers for all places of a window.
    """

    names: list[str]
    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, names: list[str], seed: int) -> Network:
        draw = np.random.default_rng(seed)
        scale = np.sqrt(2 / _SEEN.sum(axis=0))
        weights = {
            "embed": draw.normal(0, 0.5, (PAD + 1, DEPTH)),
            "filters": draw.normal(0, 1, _SEEN.shape) * scale * _SEEN,
            "bend": np.zeros(_SEEN.shape[1]),
            "out": draw.normal(0, 0.1, (_SEEN.shape[1], len(names))),
            "bias": np.zeros(len(names)),
        }
        return cls(names, {k: v.astype(np.float32) for k, v in weights.items()})

    def _patches(self, windows: np.ndarray) -> np.ndarray:
        """``(windows, places, bytes * DEPTH)``: what the widest filter sees at every place."""
        more = np.full((len(windows), max(WIDTHS) - 1), PAD, windows.dtype)
        embedded = self.weights["embed"][np.concatenate([windows, more], axis=1)]
        shape = (len(windows), windows.shape[1], len(_SEEN))
        return np.ascontiguousarray(np.lib.stride_tricks.as_strided(embedded, shape, embedded.strides))

    def _answers(self, patches: np.ndarray) -> np.ndarray:
        flat = patches.reshape(-1, patches.shape[2]) @ self.weights["filters"]
        return flat.reshape(*patches.shape[:2], -1)

    def _softmax(self, pooled: np.ndarray) -> np.ndarray:
        logits = np.maximum(pooled + self.weights["bend"], 0) @ self.weights["out"] + self.weights["bias"]
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        return self._softmax(self._answers(self._patches(windows)).max(axis=1))

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss of a batch, and its gradient: only the strongest place of every filter carries one."""
        rows, w = np.arange(len(labels)), self.weights
        patches = self._patches(windows)
        answers = self._answers(patches)
        places = answers.argmax(axis=1)
        pooled = np.take_along_axis(answers, places[:, None, :], axis=1)[:, 0]
        p = self._softmax(pooled)
        loss = float(-np.log(np.maximum(p[rows, labels], 1e-12)).mean())
        p[rows, labels] -= 1
        p /= len(labels)
        hidden = np.maximum(pooled + w["bend"], 0)
        back = (p @ w["out"].T) * (hidden > 0)
        seen = patches[rows[:, None], places]  # (windows, filters, bytes * DEPTH)
        d_seen = (back[:, :, None] * w["filters"].T).reshape(len(labels), -1, max(WIDTHS), DEPTH)
        at = places[:, :, None] + np.arange(max(WIDTHS))
        inside = at < windows.shape[1]
        d_embed = np.zeros_like(w["embed"])
        bytes_at = np.where(inside, windows[rows[:, None, None], np.minimum(at, windows.shape[1] - 1)], PAD)
        np.add.at(d_embed, bytes_at.ravel(), d_seen.reshape(-1, DEPTH))
        return loss, {
            "embed": d_embed,
            "filters": np.einsum("bfk,bf->kf", seen, back) * _SEEN,
            "bend": back.sum(axis=0),
            "out": hidden.T @ p,
            "bias": p.sum(axis=0),
        }

    def dumped(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, names=np.array(self.names), **self.weights)
        return out.getvalue()

    @classmethod
    def loaded(cls, data: bytes) -> Network:
        held = dict(np.load(io.BytesIO(data)))
        return cls([str(x) for x in held.pop("names")], held)


def trained(windows: np.ndarray, labels: np.ndarray, names: list[str], steps: int = 500, batch: int = 128, rate: float = 0.004, seed: int = 13) -> Network:
    """A network fitted by Adam on batches that hold all languages alike; the same rows in the same order give the same one."""
    net, draw = Network.fresh(names, seed), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.weights.items()}
    second = {k: np.zeros_like(v) for k, v in net.weights.items()}
    own = [np.flatnonzero(labels == i) for i in range(len(names))]
    for t in range(1, steps + 1):
        picked = draw.integers(0, len(names), batch)
        rows = np.array([own[k][draw.integers(0, len(own[k]))] for k in picked])
        _, grads = net.gradients(windows[rows], labels[rows])
        now = rate * min(1.0, 2 * (1 - t / (steps + 1)))
        for k, g in grads.items():
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.001 * (g * g - second[k])
            net.weights[k] -= now * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return net


def cut(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows that cover all bytes of texts that lie one behind another, and the text of each window."""
    sizes = np.diff(starts)
    counts = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = (starts[owner] + nth * WINDOW)[:, None] + np.arange(WINDOW)
    inside = at < starts[owner + 1][:, None]
    windows = np.where(inside, data[np.minimum(at, max(len(data) - 1, 0))].astype(np.int16) if len(data) else PAD, PAD)
    return windows.astype(np.int16), owner


def letterless(text: Column) -> Column:
    return F.coalesce(~text.rlike(r"\p{L}"), F.lit(True))


def held_out(id_col: str = "doc_id") -> Column:
    """True for the rows that training never sees: the checksum of the id, written as text, leaves 2 by 4 (null id: false)."""
    return F.coalesce(F.crc32(F.encode(F.col(f"`{id_col}`").cast("string"), "utf-8")) % 4 == 2, F.lit(False))


def _sampled(per_doc: int):
    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows at equal distances of every text, as many as ``per_doc`` at most, that hold letters."""
        for batch in batches:
            data, starts = text_bytes(batch.column(2))
            for a, b in blocks(starts, 1 << 22):
                windows, owner = cut(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a])
                counts = np.bincount(owner, minlength=b - a)
                nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
                share = np.minimum(counts, per_doc)[owner]
                # the k-th of n windows is taken where k * share / n passes a whole number
                taken = (nth * share // np.maximum(counts[owner], 1)) != ((nth - 1) * share // np.maximum(counts[owner], 1))
                taken &= _LETTER[windows].sum(axis=1) > 0
                at = np.flatnonzero(taken)
                rows = pa.array(a + owner[at])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(nth[at])]
                    + [pa.array([w.tobytes() for w in windows[at].astype("<i2")], pa.binary())],
                    names=["lang", "hash", "nth", "window"],
                )

    return take


def _fit(steps: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True))
        if rows:
            names = sorted({r[0] for r in rows})
            labels = np.searchsorted(names, [r[0] for r in rows])
            windows = np.frombuffer(b"".join(r[3] for r in rows), "<i2").reshape(-1, WINDOW).astype(np.int64)
            net = trained(windows, labels, names, steps=steps, seed=seed)
            yield pa.RecordBatch.from_arrays([pa.array([net.dumped()], pa.binary())], names=["model"])

    return run


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = DOCS, per_doc: int = PER_DOC, languages: int = LANGUAGES, steps: int = 500, seed: int = 13) -> Network | None:
    """A network learned from text and language of rows that are not held out; None without such a row.

    Bounds of the sample, whatever the input: ``per_lang`` documents of each language, those with the least hashes of
    id and text; ``per_doc`` windows of each, spread over the whole text; more than ``languages`` languages raise. The least
    hashes are sought in a slice of the hashes as wide as the language's count asks for, so no task sees a language. One task trains on these
    windows (at most ``languages * per_lang * per_doc`` of them, 128 bytes each); a lost one is trained again, the same way.
    """
    text, lang = F.col(f"`{text_col}`"), F.col(f"`{lang_col}`")
    named = docs.where(~held_out(id_col) & lang.isNotNull() & ~letterless(text)).select(
        lang.alias("lang"), F.xxhash64(F.col(f"`{id_col}`"), text, F.lit(seed)).alias("hash"), text.alias("text")
    )
    hashes = materialize(named.select("lang", "hash").distinct(), "lang-hashes")
    counts = hashes.groupBy("lang").count().limit(languages + 1).collect()
    if len(counts) > languages:
        raise ValueError(f"more than {languages} languages")
    if not counts:
        return None
    # the hashes are even, so a slice of them holds about four times the rows that are wanted, whatever the language
    shares = [(r.lang, min(1.0, 4 * (per_lang + 16) / r["count"])) for r in counts]
    slices = docs.sparkSession.createDataFrame(shares, "lang string, share double")
    cut = F.pmod("hash", F.lit(1 << 40)) < F.col("share") * F.lit(float(1 << 40))
    least = Window.partitionBy("lang").orderBy(F.pmod("hash", F.lit(1 << 40)), "hash")
    chosen = hashes.join(F.broadcast(slices), "lang").where(cut).withColumn("nr", F.row_number().over(least))
    chosen = materialize(chosen.where(F.col("nr") <= per_lang).select("lang", "hash"), "lang-sample")
    rows = named.join(F.broadcast(chosen), ["lang", "hash"], "left_semi").dropDuplicates(["lang", "hash"])
    windows = rows.select("lang", "hash", "text").mapInArrow(_sampled(per_doc), "lang string, hash long, nth long, window binary")
    models = windows.repartition(1).mapInArrow(_fit(steps, seed), "model binary").collect()  # one row of fixed size
    return Network.loaded(models[0].model) if models else None


def _predict(net: Network, field: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_bytes(batch.column(0).field(field).fill_null(""))
            sums = np.zeros((batch.num_rows, len(net.names)))
            for a, b in blocks(starts, BATCH * WINDOW):
                begin, end = int(starts[a]), int(starts[b])
                # a text of more windows than fit is cut into runs of whole windows
                for at in range(begin, max(end, begin + 1), BATCH * WINDOW) if b == a + 1 else (begin,):
                    stop = min(end, at + BATCH * WINDOW) if b == a + 1 else end
                    cuts = np.array([0, stop - at]) if b == a + 1 else starts[a : b + 1] - begin
                    windows, owner = cut(data[at:stop], cuts)
                    if len(windows):
                        letters = _LETTER[windows].sum(axis=1, dtype=np.float64)
                        np.add.at(sums, a + owner, net.probabilities(windows) * letters[:, None])
            total = sums.sum(axis=1)
            best = sums.argmax(axis=1)
            score = np.clip(sums[np.arange(len(best)), best] / np.where(total > 0, total, 1), 0, 1)
            sure = ~batch.column(1).to_numpy(zero_copy_only=False) & (total > 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(net.names, object)[best], pa.string(), mask=~sure), pa.array(np.where(sure, score, 0.0))],
                names=["_row", "lang_pred", "score"],
            )

    return run


def identify(docs: DataFrame, net: Network | None, text_col: str = "text") -> DataFrame:
    """Every row with ``lang_pred`` and ``score``, read off its whole text.

    A text is cut into windows of 128 bytes; their probabilities are averaged, each by its number of letters, and the
    likeliest language (the first by name among equals) is the prediction, its mean probability the score. Null text,
    text without any letter and a missing network give ``und`` and 0. Columns of ``docs`` named like the added ones are
    replaced. An empty table gives an empty result.
    """
    bare = docs.drop("lang_pred", "score")
    rows = bare.select(boxed(bare))
    if net is None:
        return rows.select(*unboxed(bare), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    asked = rows.select("_row", letterless(F.col(f"_row.`{text_col}`")).alias("_none"))
    schema = StructType([asked.schema["_row"], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    told = asked.mapInArrow(_predict(net, text_col), schema)
    return told.select(*unboxed(bare), F.coalesce("lang_pred", F.lit(UNKNOWN)).alias("lang_pred"), "score")
