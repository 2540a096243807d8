"""Source divergence, filter interaction and language identification against plain versions."""

import itertools
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidecast.llm import catalog, divergence, filter_audit, lang_id

SCHEMA = "doc_id long, text string, lang string, source string, value string, _row string, `rank` string, part string, lang_pred string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def mixed(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns named like those in use."""
    draw = np.random.default_rng(3)
    words = [f"{a}{b}" for a in "abcdefghijkl" for b in ("a", "É", "Zz", "日本", "o")]
    rows = []
    for i in range(260):
        n = int(draw.integers(0, 60)) if i % 40 else 5000
        text = " ".join(words[min(int(draw.exponential(9)), len(words) - 1)] for _ in range(n))
        rows.append((i, text, ("de", "en", None, "")[i % 4 if i % 3 else 0], (f"s{i % 5}", None, "")[0 if i % 7 else i % 3]))
    rows += [(400, None, "en", "silent"), (401, "", "xx", "alone"), (402, "1 2 3", "xx", None), (None, "no id " * 40, None, None)]
    rows += [(7, rows[7][1], "en", "s1"), (500, rows[7][1], "fr", "s1"), (501, rows[7][1], "fr", "s1"), (501, rows[7][1], "fr", "s1")]
    rows += [(None, rows[7][1], "fr", "s2"), (502, "TOKEN | " * 200, "fr", "s2"), (503, "x" * 30000, "fr", "s2")]
    return spark.createDataFrame([(*r, "v", "r", "k", "p", "l") for r in rows], SCHEMA).repartition(5), rows


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_divergence(rows, least, top):
    docs = [(lang or "", source or "", TERM.findall(lowered(text))) for _, text, lang, source in rows]
    held, count, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, terms in docs:
        held[lang].update(set(terms))
        count[lang, source].update(terms)
        sources[lang].add(source)
    out = set()
    for lang, own in sources.items():
        kept = [t for t, n in held[lang].items() if n >= least]
        v = len(kept)

        def shares(counter):
            total = sum(counter[t] for t in kept)
            return {t: 1 + 10**9 * (counter[t] + 2) // (total + 2 * v) for t in kept}

        p = {s: shares(count[lang, s]) for s in own}
        q = shares(sum((count[lang, s] for s in own), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in own if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                for r, (value, item) in enumerate(found if part == "pair" else found[:top], 1):
                    out.add((lang, s, part, item, value, r))
    return out


@pytest.mark.parametrize(("least", "top", "bundle", "block"), [(10, 10, 32, 1 << 24), (1, 3, 1, 300), (10**6, 5, 2, 1 << 24)])
def test_divergence_equals_plain_version(mixed, monkeypatch, least, top, bundle, block):
    docs, rows = mixed
    monkeypatch.setattr(divergence, "BUNDLE", bundle)
    monkeypatch.setattr(divergence, "BLOCK", block)
    out = divergence.divergences(docs, least, top)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == plain_divergence(rows, least, top)


def test_counting_terms_holds_one_block():
    """Texts of 16 MB in one batch: what a block takes in memory, not what the batch would."""
    draw = np.random.default_rng(5)
    words = np.array(["".join(map(chr, draw.integers(97, 123, 6))) for _ in range(30_000)])
    texts = [" ".join(words[draw.integers(0, len(words), 30_000)]) for _ in range(80)]
    batch = pa.record_batch([pa.array([c] * 80) for c in ("en", "s1")] + [pa.array(texts)], names=["lang", "source", "text"])
    tracemalloc.start()
    counted = sum(pc.sum(out.column(3)).as_py() for out in divergence._count(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert counted == 80 * 30_000
    assert peak < 100 << 20


def test_divergence_of_nothing(spark, none):
    assert divergence.divergences(none).isEmpty()
    one = spark.createDataFrame([("a b c", "en", "s")] * 12, "text string, lang string, source string")
    assert divergence.divergences(one).isEmpty()  # one source: no pair, and no term above its language


def test_shares_of_large_counts(spark):
    row = spark.sql(f"SELECT {divergence.share('c', 'n', 'v')} AS p FROM (SELECT 4000000000000000L c, 8000000000000000L n, 3L v)").first()
    assert row.p == 1 + 10**9 * (4 * 10**15 + 2) // (8 * 10**15 + 6)


FAILS = (
    lambda t: len(WORD.findall(t)) < 100,
    lambda t: 100 * len(set(WORD.findall(t))) < 80 * len(WORD.findall(t)),
    lambda t: 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
    lambda t: bool(re.search(r"[#$%&*|]", t)),
)


def plain_audit(rows, labels):
    """Rows of every part, order and step, by applying the filters one after the other."""
    first = {}
    for doc, text, *_ in rows:
        if doc is not None:
            first[text or ""] = min(first.get(text or "", doc), doc)
    parts = defaultdict(list)
    for doc, text, lang, _ in rows:
        t = text or ""
        fails = {"ABCD"[i]: f(t) for i, f in enumerate(FAILS)}
        fails["E"] = doc is not None and first[t] < doc
        good, toxic = (any(q == 1 for d, q, _ in labels if d == doc and d is not None), any(x == 1 for d, _, x in labels if d == doc and d is not None))
        parts[lang or ""].append((fails, good, toxic))
    out = []
    for part, docs in parts.items():
        made, share = [], Counter()
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[0][f]]
                left = [d for d in left if not d[0][f]]
                total = sum(d[0][f] for d in docs)
                alone = sum(d[0][f] and sum(d[0].values()) == 1 for d in docs)
                share[f] += len(gone)
                made.append((f, (part, "".join(order), step, len(left), len(gone), total - len(gone), alone, sum(d[1] for d in gone), sum(d[2] for d in gone))))
        out += [(*row, share[f]) for f, row in made]
    return sorted(out)


def test_audit_equals_plain_version(spark, mixed, none):
    docs, rows = mixed
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 600, 3)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1), (6, None, None)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = filter_audit.text_filters(docs, table)
    assert out.columns == [c.split()[0] for c in filter_audit.STEPS.split(", ")]
    assert sorted(tuple(r) for r in out.collect()) == plain_audit(rows, labels)
    assert filter_audit.text_filters(none, table).isEmpty()
    assert {r.good_lost + r.toxic_lost for r in filter_audit.text_filters(docs, table.limit(0)).collect()} == {0}


def test_a_diagram_can_have_any_number_of_filters():
    draw = np.random.default_rng(1)
    for size in (1, 2, 3, 4):
        table = draw.integers(0, 4, (1 << size, 3))
        names = "ABCD"[:size]
        rows = filter_audit.steps(table, names)
        assert sorted({r[0] for r in rows}) == ["".join(p) for p in itertools.permutations(names)]
        for order, step, kept, removed, *_ in rows:
            before = sum(1 << names.index(f) for f in order[: step - 1])
            own = 1 << names.index(order[step - 1])
            assert kept == sum(n for m, (n, *_) in enumerate(table.tolist()) if not m & (before | own))
            assert removed == sum(n for m, (n, *_) in enumerate(table.tolist()) if not m & before and m & own)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=32, max_size=32))
def test_swaps_keep_the_weights(counts):
    diagram = filter_audit.Diagram.of(np.array([(c, 0, 0) for c in counts]))
    seen = {tuple(diagram.order)}
    for level in filter_audit.adjacent_swaps(5):
        diagram.swap(level)
        seen.add(tuple(diagram.order))
        assert [int(diagram.fails(v)[0]) for v in range(5)] == [sum(c for m, c in enumerate(counts) if m >> v & 1) for v in range(5)]
    assert len(seen) == 120


def test_gradients_are_those_of_the_loss():
    draw = np.random.default_rng(5)
    net = lang_id.Network.fresh(["a", "b", "c"], 1)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    windows, labels = draw.integers(0, 257, (6, 12)), np.array([0, 1, 2, 0, 1, 2])
    _, grads = net.gradients(windows, labels)
    for name, w in net.weights.items():
        for at in zip(*(draw.integers(0, n, 5) for n in w.shape), strict=True):
            if name == "filters" and not lang_id._SEEN[at]:
                assert grads[name][at] == 0
                continue
            kept, eps = w[at], 1e-5
            w[at] = kept + eps
            up = net.gradients(windows, labels)[0]
            w[at] = kept - eps
            down = net.gradients(windows, labels)[0]
            w[at] = kept
            assert grads[name][at] == pytest.approx((up - down) / (2 * eps), abs=1e-6)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 700), max_size=6))
def test_windows_cover_every_byte_once(sizes):
    data = np.arange(sum(sizes)).astype(np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    windows, owner = lang_id.cut(data, starts)
    for i in range(len(sizes)):
        got = windows[owner == i].ravel()
        assert (got[sizes[i] :] == lang_id.PAD).all() and (got[: sizes[i]] == data[starts[i] : starts[i + 1]]).all()
        assert len(got) - sizes[i] < lang_id.WINDOW


def plain_scores(net, text):
    data = text.encode()
    total = np.zeros(len(net.names))
    for a in range(0, len(data), lang_id.WINDOW):
        piece = data[a : a + lang_id.WINDOW]
        window = np.array([[*piece, *[lang_id.PAD] * (lang_id.WINDOW - len(piece))]])
        total += net.probabilities(window)[0].astype(float) * sum(c >= 128 or chr(c).isalpha() for c in piece)
    return total


def test_language_identification(spark, small_dir, none):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text", "lang")
    net = lang_id.fit(docs)
    assert net.names == ["de", "en", "es", "fr"]
    got = lang_id.identify(docs, net).withColumn("held", lang_id.held_out()).collect()
    for r in got:
        assert r.held == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [r for r in got if r.held]
    assert len(held) > 30 and np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    # what is held out, and rows without a language, teach nothing
    other = docs.withColumn("lang", F.when(lang_id.held_out(), "xx").otherwise(F.col("lang"))).unionByName(
        docs.selectExpr("doc_id + 10000 AS doc_id", "text", "CAST(NULL AS STRING) AS lang")
    )
    again = lang_id.fit(other)
    assert all(np.array_equal(again.weights[k], net.weights[k]) for k in net.weights)
    loaded = lang_id.Network.loaded(net.dumped())
    assert loaded.names == net.names and np.array_equal(loaded.weights["out"], net.weights["out"])
    # awkward rows: whole texts, wherever batches and blocks end
    long = "der die und das " * 9000 + "the and of to " * 30000
    texts = [None, "", " \n", "12 | 34 €", "a", "der und die", long, long, "é", "1" * 500 + "the"]
    rows = [(i if i != 7 else 6, t, "zz", "v", "r") for i, t in enumerate(texts)] + [(None, "the", None, "v", "r")]
    asked = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string, _row string, _none string").coalesce(1)
    out = lang_id.identify(asked, net)
    assert out.columns == ["doc_id", "text", "_row", "_none", "lang_pred", "score"]
    for r in out.collect():
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            want = plain_scores(net, r.text)
            assert r.lang_pred == net.names[int(want.argmax())] and r.score == pytest.approx(want.max() / want.sum(), abs=1e-4)
    assert lang_id.fit(none) is None and lang_id.identify(none, None).isEmpty() and lang_id.identify(none, net).isEmpty()
    assert {r.lang_pred for r in lang_id.identify(asked, None).collect()} == {"und"}
    with pytest.raises(ValueError, match="more than 3 languages"):
        lang_id.fit(docs, languages=3)


def test_queries_of_the_audits(spark, small_dir):
    assert catalog.QUERIES["op13_language_id"](spark, small_dir).columns == ["doc_id", "held_out", "lang_pred", "score"]
