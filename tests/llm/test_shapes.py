"""Extraction, packing, sharding, chat windows, scoring and the pipeline."""

import json
import zlib
from collections import defaultdict
from pathlib import Path

import brute
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidecast.llm import catalog, chat, html, lm_score, packing, sharding

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def placed(rows, size):
    """Sequences are gapless from 0 and not too long."""
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for v in by.values():
        ends = [0] + [a + n for a, n in sorted(v)]
        assert [a for a, _ in sorted(v)] == ends[:-1] and ends[-1] <= size
    return len(by)


def test_packing_awkward_rows(awkward, nothing):
    docs, rows = awkward
    out = packing.pack(docs, VOCABULARY, 256).collect()
    tokenizer, want = Tokenizer.from_file(VOCABULARY), []
    for doc, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for p, a in enumerate(range(0, len(ids), 256)):
            x = ids[a : a + 256]
            want.append((doc, p, a, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in out)
    total = sum(r.length for r in out)
    assert placed(out, 256) <= -(-total // 256) + 1
    assert packing.pack(nothing, VOCABULARY).isEmpty()


def test_special_strings_are_sought_before_lower_casing(spark):
    texts = ["<|endoftext|>", "<|ENDOFTEXT|>", "A<|startoftext|>B <|StartOfText|> c", "x <|endoftext|>, Y", "a <| b |> C", "<|END OF TEXT|>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tokenizer = Tokenizer.from_file(VOCABULARY)
    got = {r.doc_id: r.ids_crc32 for r in packing.pack(docs, VOCABULARY).collect()}
    for i, text in enumerate(texts):
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [1]
        assert got[i] == zlib.crc32(np.array(ids, "<u4").tobytes()), text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abzABZéÉßÿªºµ×÷İıſΣσς'.,!-1½²日\u0301\u0338\u212b\u00ad", min_size=1, max_size=9))
def test_words_have_the_ids_of_the_tokenizer(word):
    known = packing._encoded(VOCABULARY)
    ids = known.tokenizer.encode(word, add_special_tokens=False).ids
    assert b"".join(map(known.__getitem__, known.words(word.encode()))) == np.array(ids, "<u4").tobytes()


def test_words_of_letters_go_to_the_model_at_once():
    class Long:
        def encode(self, word, add_special_tokens):
            asked.append(word)
            return tokenizer.encode(word, add_special_tokens=add_special_tokens)

    known, asked = packing._Encoded(VOCABULARY), []
    tokenizer, known.tokenizer = known.tokenizer, Long()
    words = "Wörter aus lateinischen Buchstaben, é. thnttiones it's 3 дом"
    got = b"".join(map(known.__getitem__, known.words(words.encode())))
    assert got == np.array(tokenizer.encode(words, add_special_tokens=False).ids, "<u4").tobytes()
    assert sorted(asked) == [",", ".", "3", "it's", "дом"]


def test_tokenizers_that_change_letters_or_split_words(tmp_path):
    changed = json.loads(Path(VOCABULARY).read_text())
    for step in ({"type": "Replace", "pattern": {"String": "ba"}, "content": "z z"}, {"type": "StripAccents"}):
        changed["normalizer"]["normalizers"] = [{"type": "NFD"}, step, {"type": "Lowercase"}]
        (path := tmp_path / "own.json").write_text(json.dumps(changed))
        known = packing._Encoded(str(path))
        for word in ("abba", "cab", "é", "aéa", "bab"):
            ids = known.tokenizer.encode(word, add_special_tokens=False).ids
            assert known[word.encode()] == np.array(ids, "<u4").tobytes(), (step, word)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), min_size=1))
def test_plan_packs_every_piece_once(counts):
    used = defaultdict(int)
    sequences = 0
    for times, items in packing.plan(counts, 64):
        assert times > 0 and sum(n * k for n, k in items.items()) <= 64
        sequences += times
        for n, k in items.items():
            used[n] += n and k * times
    assert dict(used) == counts
    assert sequences <= 2 * -(-sum(n * c for n, c in counts.items()) // 64)


def test_smallest_piece_gives_way_to_a_tighter_pair():
    # greedy takes 6 and 3 of 10; the 3 gives way to 2 and 2
    assert packing.plan({6: 1, 3: 1, 2: 2}, 10)[0] == (1, {6: 1, 2: 2})


def test_sharding(spark, awkward, nothing):
    docs, rows = awkward
    for size in (1 << 24, 2000):
        out = sharding.shuffled_shards(docs, 8, bucket_bytes=size)
        assert out.columns == [*docs.columns, "shard", "slot"]
        found = out.collect()
        by = defaultdict(list)
        for r in found:
            by[r.shard].append(r.slot)
        assert all(sorted(v) == list(range(len(v))) for v in by.values())
        counts = [len(by.get(s, ())) for s in range(8)]
        assert max(counts) - min(counts) <= 1
        assert sorted(map(repr, rows)) == sorted(repr((r.doc_id, r.text)) for r in found)
    order = lambda seed: [r.doc_id for r in sharding.shuffled_shards(docs, 8, seed).orderBy("shard", "slot").collect()]
    assert order(1) == order(1) != order(2)
    assert sharding.shuffled_shards(nothing).isEmpty()


def test_sharding_moves_rows_once(spark, awkward):
    """Also where Spark would not broadcast the places of the buckets by itself."""
    docs = awkward[0]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = sharding.shuffled_shards(docs, 8, bucket_bytes=2000)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_write_shards(awkward, tmp_path, spark):
    docs, rows = awkward
    sharding.write_shards(sharding.shuffled_shards(docs.select("doc_id", "text"), 4), str(tmp_path / "s"), 4)
    assert spark.read.parquet(str(tmp_path / "s")).groupBy("shard").count().count() == 4


TURNS = st.lists(st.tuples(st.sampled_from(["system", "user", "assistant"]), st.text(alphabet="ab\\<>/turnl\n é", max_size=60)), min_size=1, max_size=9)


@settings(max_examples=5, deadline=None)
@given(st.lists(TURNS, min_size=1, max_size=6))
def test_chat_round_trip(spark, conversations):
    rows = [(c, t, role, text) for c, turns in enumerate(conversations) for t, (role, text) in enumerate(turns)]
    made = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=32)
    back = {r.conv_id: r for r in chat.read_back(made).collect()}
    for c, turns in enumerate(conversations):
        assert [(t.role, t.text) for t in back[c].turns] == turns
        assert back[c].loss == "".join(text for role, text in turns if role == "assistant")


def test_chat_windows(spark):
    rows = [(1, 0, "system", "be brief")] + [(1, t, "user" if t % 2 else "assistant", f"turn {t}") for t in range(1, 12)]
    rows += [(2, None, None, None), (None, 1, "assistant", "x"), (3, 1, "user", "b"), (3, 1, "user", "a"), (3, 1, "user", "a")]
    found = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=48).collect()
    own = sorted((r for r in found if r.conv_id == 1), key=lambda r: r.window)
    assert len(own) > 2 and all(r.formatted.startswith("<turn>system\nbe brief</turn>\n") for r in own)
    assert [r.context_turns for r in own] == [0] + [2] * (len(own) - 1)
    assert {r.conv_id for r in found} == {1, 2, 3, None}
    three = next(r for r in found if r.conv_id == 3)
    assert three.formatted.count("<turn>user\na</turn>") == 2 and three.formatted.endswith("b</turn>\n")
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.windows(empty)).isEmpty()


def test_windows_keep_their_budget(spark):
    sizes = {1: [400] + [250] * 30, 2: [5, 90, 300, 10, 10, 2000, 7, 7, 500, 30], 3: [700, 100, 600, 100, 20], 4: [3000, 10, 10]}
    rows = [(c, t, "system" if t == 0 and c != 2 else "ua"[t % 2], "x" * (4 * n - 20)) for c, own in sizes.items() for t, n in enumerate(own)]
    rows += [(5, 0, "system", "alone")]
    rows = [(c, t, {"u": "user", "a": "assistant"}.get(r, r), x) for c, t, r, x in rows]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = chat.windows(df, budget=1024).collect()
    weight = lambda text: sum((len(p.encode()) + len(chat.CLOSE) + 3) // 4 for p in text.split(chat.CLOSE) if p)
    for r in found:
        turns = [p for p in r.formatted.split(chat.CLOSE) if p]
        new = turns[r.context_turns :]
        ordinary = [p for p in new if not p.startswith(f"{chat.OPEN}system")]
        system = weight(turns[0] + chat.CLOSE) if turns[0].startswith(f"{chat.OPEN}system") else 0
        if weight(r.formatted) > 1024:
            # one turn that is too large beside the system turn, and no history with it
            assert len(ordinary) == 1 and (system + weight(ordinary[0] + chat.CLOSE) > 1024)
            assert r.context_turns == (1 if system and r.window else 0)
    assert max(weight(r.formatted) for r in found if r.conv_id == 1) <= 1024
    back = {r.conv_id: r for r in chat.read_back(spark.createDataFrame(found)).collect()}
    for c in {r[0] for r in rows}:
        assert [(t.role, t.text) for t in back[c].turns] == [(role, text) for conv, _, role, text in rows if conv == c]


PAGE = (
    "<html><head><title>T</title><script>var a='</p>';</script></head><body><header>Site</header><div class='menu'>M</div>"
    "<p>Home</p><p>A &amp; B\n  <b>bold</b>text</p><p class=ad>Buy<p>more {n}</p><form>Mail</form><div class='comments'><p>first!</p></div>"
    "<p>Imprint</p></body></html>"
)


def test_extraction_differences_neighbours(spark, nothing):
    rows = [
        (1, "https://a.example/x/1", PAGE.replace("{n}", "one")),
        (2, "https://a.example/x/2?q=1", PAGE.replace("{n}", "two").replace("A &amp; B", "C &lt; D")),
        (3, "https://b.example/x/1", PAGE.replace("{n}", "three")),
        (4, None, "<article><h1>Head</h1><p>Body<aside>away</aside> end</article><p>outside"),
        (5, "https://c.example/1", "<main>Same</main>"),
        (6, "https://c.example/2", "<main>Same</main>"),
        (7, "https://d.example/1", None),
        (8, "https://d.example/2", "plain"),
        (9, "https://d.example/2", "plain"),
        (10, "not a url", "<p>open <nav>x"),
    ]
    pages = spark.createDataFrame([(*r, "own") for r in rows], "page_id long, url string, html string, text string")
    out = html.extract(pages)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = {r.page_id: r.text for r in out.collect()}
    # Home and Imprint are on both pages of host a
    assert got[1] == "A & B boldtext more one" and got[2] == "C < D boldtext more two"
    assert got[3] == "Home A & B boldtext more three Imprint"
    assert got[4] == "Head Body end" and got[5] == got[6] == "Same"
    assert got[7] == "" and got[8] == got[9] == "plain" and got[10] == "open"
    assert all(r.n_chars == len(r.text) for r in out.collect())
    assert html.extract(pages.where("page_id > 99")).isEmpty()


def test_extraction_differences_pages_with_articles(spark):
    wrapped = "<main><div>Terms of this site</div><p>{}</p><div>Back to top</div></main>"
    teaser = "<article>Read more</article><p>{}</p><div class=related-posts>{}</div>"
    copied = "<article><h1>Head</h1><p>A long text on both pages</article><div>seen {}</div>"
    rows = [
        ("https://a.example/1", wrapped.format("first body"), "first body"),
        ("https://a.example/2", wrapped.format("second body"), "second body"),
        ("https://b.example/1", teaser.format("body outside", "own"), "body outside own"),
        ("https://b.example/2", teaser.format("another body", "too"), "another body too"),
        ("https://c.example/1", copied.format(1), "Head A long text on both pages seen 1"),
        ("https://c.example/2", copied.format(2), "Head A long text on both pages seen 2"),
        ("https://d.example/1", "<body><nav>Menu<article><header><h1>One</h1></header><p>x</article>", "One x"),
        ("https://d.example/2", "<body><nav>Menu<article><header><h1>Two</h1></header><p>y</article>", "Two y"),
        ("https://e.example/1", "<div><aside>Menu</div><p>left<ul><li class=ad><p>ad<li>item</ul>", "left item"),
    ]
    joint = "<div>Top</div><article><h1>{0}</h1><p>A closing word that both have.</p><p>own {0}</p></article><div>Bottom</div>"
    rows += [(f"https://f.example/{x}", joint.format(x), f"{x} A closing word that both have. own {x}") for x in ("one", "two")]
    pages = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(rows)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    assert [got[i] for i in range(len(rows))] == [want for *_, want in rows]


def test_extraction_without_telling_names(spark, monkeypatch):
    """Boilerplate whose names say nothing goes because the neighbours have it, too; articles stay whole."""
    monkeypatch.setattr(html, "_AWAY_NAMES", frozenset())
    page = (
        "<div class=a1><a>Home</a><p>All topics</p></div><div class=b2><article><h1>{0}</h1><p>{0} {0}</p><p>Shared end</p></article></div>"
        "<div class=z9><p>We use small files</p><p>Read more here</p></div>"
    )
    names = ["red", "green", "blue", "white"]
    pages = spark.createDataFrame([(n, f"https://a.example/{n}", page.format(n)) for n in names], "page_id string, url string, html string")
    assert {r.page_id: r.text for r in html.extract(pages).collect()} == {n: f"{n} {n} {n} Shared end" for n in names}


def test_extraction_of_a_very_long_page(spark):
    body = "".join(f"<p>paragraph {i}</p>" for i in range(40_000))
    rows = [(1, "https://a.example/1", f"<div>Menu</div><article>{body}</article>"), (2, "https://a.example/2", "<div>Menu</div><article>short</article>")]
    got = {r.page_id: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == " ".join(f"paragraph {i}" for i in range(40_000)) and got[2].text == "short"


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=9), st.lists(st.integers(0, 4), max_size=9))
def test_shared_is_a_longest_common_subsequence(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    found = [a[i] for i in sorted(html.shared(a, b))]
    rest = iter(b)
    assert len(found) == best[-1][-1] and all(x in rest for x in found)


def test_scores_tell_text_from_noise(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text")
    model, classes = lm_score.fit(docs.where("doc_id % 5 != 0"))
    held = docs.where("doc_id % 5 = 0")
    mean = lambda df, m=model: df.agg((F.sum("log_prob") / F.sum("n_tokens")).alias("m")).first().m
    plain, _ = lm_score.fit(docs.where("doc_id % 5 != 0"), rounds=0)
    trained = mean(lm_score.score(held, model, classes))
    assert trained > mean(lm_score.score(held, plain, classes)) + 0.02
    mixed = held.withColumn("text", F.array_join(F.transform(F.split("text", " "), lambda w: F.reverse(w)), " "))
    assert trained > mean(lm_score.score(mixed, model, classes)) + 0.5


def plain_log_prob(model, classes, text):
    """Sum over the words of ``text``, each given two neighbours a side, written out with loops."""
    words = text.lower().encode().split()
    ids = [0, 0, *(classes[w] for w in words), 0, 0]
    total, size = 0.0, model.bias.shape[1]
    for t, word in enumerate(words):
        near = [ids[t], ids[t + 1], ids[t + 3], ids[t + 4]]
        hidden = [np.tanh(sum(float(model.inside[i][c][k]) for i, c in enumerate(near))) for k in range(model.inside.shape[2])]
        group, member = divmod(ids[t + 2], size)
        score = lambda row, bias: sum(h * float(x) for h, x in zip(hidden, row)) + float(bias)
        over = [score(model.groups[:, g], model.group_bias[g]) for g in range(len(model.group_bias))]
        inner = [score(model.out[group][m], model.bias[group][m]) for m in range(size)]
        total += over[group] - np.log(sum(map(np.exp, over))) + inner[member] - np.log(sum(map(np.exp, inner)))
        counts = dict(classes.known)
        if ids[t + 2] <= classes.shared:
            total += np.log(counts.get(word, 1)) - np.log(classes.totals[ids[t + 2] - 1] + 1)
    return total


def test_log_probabilities_by_hand(spark):
    texts = ["the cat sat on the mat", "a dog", "the the the cat", "", "zebra", "on a mat the dog sat quietly"]
    docs = spark.createDataFrame([(t,) for t in texts * 20], "text string")
    model, classes = lm_score.fit(docs, words=4, shared=3, hidden=5)
    for r in lm_score.score(docs, model, classes).distinct().collect():
        assert r.log_prob == pytest.approx(plain_log_prob(model, classes, r.text), abs=1e-3)
        assert r.n_tokens == len(r.text.split())


def test_a_step_needs_few_products_a_row():
    """The members of a group are scored in one product: no copy of a group's classes is made for every row."""
    import tracemalloc

    model = lm_score.start_model(np.ones(512), 16, 1)
    draw = np.random.default_rng(3)
    context, target = draw.integers(0, 512, (lm_score.BATCH, 2 * lm_score.SIDE)), draw.integers(1, 512, lm_score.BATCH)
    trainer = lm_score.Trainer(model, 0.1)
    trainer.step(context, target)
    tracemalloc.start()
    trainer.step(context, target)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < lm_score.BATCH * model.out[0].nbytes


def test_slopes_are_those_of_the_loss():
    draw = np.random.default_rng(2)
    model = lm_score.start_model(np.arange(11.0), 3, 1)
    trainer = lm_score.Trainer(lm_score.Model(*(x.astype(np.float64) for x in model)), 0.1)
    context, target = draw.integers(0, 11, (9, 2 * lm_score.SIDE)), draw.integers(1, 11, 9)
    loss = lambda: -trainer.model.log_probs(context, target).mean()
    assert np.exp(trainer.model.log_probs(np.repeat(context[:1], 11, 0), np.arange(11))).sum() == pytest.approx(1)
    full = {k: np.zeros_like(getattr(trainer.model, k)) for k in model._fields}
    for name, where, slope in trainer.gradients(context, target):
        full[name][where] += slope
    for name, slopes in full.items():
        value = getattr(trainer.model, name)
        for at in zip(*(draw.integers(0, n, 12) for n in value.shape), strict=True):
            if name in ("out", "bias") and at[0] * model.bias.shape[1] + at[1] >= 11:
                continue
            kept = value[at]
            value[at] = kept + 1e-5
            up = loss()
            value[at] = kept - 1e-5
            down = loss()
            value[at] = kept
            assert slopes[at] == pytest.approx((up - down) / 2e-5, abs=1e-6), name


def test_every_word_is_a_training_target(spark):
    for size in (0, 1, 5, 40):
        places = np.concatenate([lm_score.targets(size, k, 3) for k in range(3)]) - lm_score.SIDE
        assert sorted(places) == list(range(size))
    # the fifth word tells the sixth; both lie where every 16th word of a short text never falls
    ends = [("a c", "a d"), ("b d", "b c")]
    rows = [(f"w{i % 7} x{i % 5} y{i % 3} z{i % 11} {ends[i % 2][0]}", f"w{i % 7} x{i % 5} y{i % 3} z{i % 11} {ends[i % 2][1]}") for i in range(8000)]
    docs = spark.createDataFrame(rows, "text string, swapped string").repartition(2)
    model, classes = lm_score.fit(docs)
    mean = lambda c: lm_score.score(docs, model, classes, c).agg(F.avg("log_prob").alias("m")).first().m
    assert mean("text") > mean("swapped") + 1


def test_rare_words_are_charged_by_their_counts(spark):
    counts = {"the": 400, "often": 60, "some": 8, "few": 3, "once": 1}
    rows = [(w,) for w, n in counts.items() for _ in range(n)]
    docs, asked = spark.createDataFrame(rows, "text string"), spark.createDataFrame([(w,) for w in [*counts, "never"]], "text string")
    found = []
    # all counts held, and the last three of them joined
    for known in (100, 2):
        model, classes = lm_score.fit(docs, words=1, shared=1, known=known)
        assert (classes.rest is None) == (known == 100)
        found.append({r.text: r.log_prob for r in lm_score.score(asked, model, classes).collect()})
    for got in found:
        for w in ("often", "some", "few", "never"):
            assert got[w] - got["once"] == pytest.approx(np.log(counts.get(w, 1)))
        assert 0.9 < sum(map(np.exp, got.values())) <= 1
    assert found[0] == pytest.approx(found[1])


def test_texts_are_read_twice(spark):
    """Once for the counts and once for the classes of the words; both training rounds and the scores take the classes."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(text):
        read.add(1)
        return text

    rows = [(i, f"w{i % 7} X{i % 5} y{i * i % 11} w{i % 3} rare{i}") for i in range(120)] + [(None, None), (3, ""), (3, "w1")]
    bare = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).cache()
    bare.count()
    docs = bare.select("doc_id", told("text").alias("text"))
    classes = lm_score.learned_classes(docs, words=5, shared=4, known=9)
    texts = lm_score.encode(docs, classes, keep=["doc_id"])
    found = lm_score.score(texts, *lm_score.fit(texts)).collect()
    assert read.value == 2 * len(rows)
    plain = lm_score.score(bare, *lm_score.fit(bare, words=5, shared=4, known=9)).drop("text").collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens)
    found, plain = sorted(found, key=key), sorted(plain, key=key)
    assert [key(r) for r in found] == [key(r) for r in plain]
    assert [r.log_prob for r in found] == pytest.approx([r.log_prob for r in plain], rel=1e-4)


@pytest.mark.parametrize("hidden", [4, 5])
def test_embedding_slopes_of_few_and_of_many_classes(hidden):
    draw = np.random.default_rng(4)
    trainer = lm_score.Trainer(lm_score.start_model(np.ones(40), hidden, 1), 0.1)
    context, back = draw.integers(0, 40, (100, 2 * lm_score.SIDE)), draw.normal(size=(100, hidden)).astype(np.float32)
    plain = np.zeros(trainer.model.inside.shape)
    for i in range(2 * lm_score.SIDE):
        np.add.at(plain[i], context[:, i], back)
    for cells in (trainer.cells, None):
        trainer.cells, total = cells, np.zeros_like(plain)
        where, slope = trainer.embedding_slopes(context, back)
        total[where] += slope
        assert total == pytest.approx(plain, abs=1e-5)


def test_scores_of_awkward_rows(awkward, nothing):
    docs, rows = awkward
    out = lm_score.score(docs, *lm_score.fit(docs))
    found = out.collect()
    assert len(found) == len(rows) and sorted(r.n_tokens for r in found) == sorted(len((t or "").encode().split()) for _, t in rows)
    assert all((r.mean_log_prob is None) == (r.n_tokens == 0) and (r.log_prob < 0) == (r.n_tokens > 0) for r in found)
    assert lm_score.score(nothing, *lm_score.fit(nothing)).isEmpty()


def test_query_of_every_operator(spark, small_dir):
    numbers = sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES)
    assert numbers == list(range(1, 14))
    assert catalog.QUERIES["op1_html_extraction"](spark, small_dir).count() == 50
    assert catalog.QUERIES["op9_lm_scoring"](spark, small_dir).count() == 200
    shards = catalog.QUERIES["op6_sharding"](spark, small_dir).groupBy("shard").count().collect()
    assert [r["count"] for r in shards] == [25] * 8
    packed = catalog.QUERIES["op2_best_fit_packing"](spark, small_dir).collect()
    assert placed(packed, 4096) == -(-sum(r.length for r in packed) // 4096)


def test_pipeline_stages(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small_dir)
        if name == "quality rules":
            assert {r.doc_id for r in out.collect()} <= {d for d, *_, failed in brute.quality(rows) if not failed}
            assert out.count() > 0.8 * len(rows)
        elif name == "n-gram Jaccard join":
            assert sorted(r.doc_id for r in out.collect()) == sorted({c for _, _, c in brute.jaccard(rows, 5, 80)})
        elif name == "suffix-array dedup":
            whole, left = dict(rows), {r.doc_id: r.text for r in out.collect()}
            for doc, size, gone, spans, _ in brute.suffix_dedup(rows, corpus_pipeline.PASSAGE_BYTES):
                if not gone:
                    assert left[doc] == whole[doc]
                else:  # what a cut leaves of a character goes, too: three bytes at most on either side
                    assert size - gone - 6 * spans <= len(left[doc].encode()) <= size - gone
        elif name == "benchmark decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").collect()]
            assert sorted(r.doc_id for r in out.collect()) == sorted(x[0] for x in brute.decontaminate(rows, items) if not x[-1])
        if name != "best-fit packing":
            assert out.columns == docs.columns
            kept[name] = rows = [(r.doc_id, r.text) for r in out.collect()]
            docs = spark.createDataFrame(out.collect(), out.schema)
        else:
            assert {r.doc_id for r in out.collect()} == {d for d, _ in rows}
    assert corpus_pipeline.run(spark, small_dir).count() == out.count()


@pytest.mark.parametrize("name", ["quality rules", "n-gram Jaccard join", "suffix-array dedup", "benchmark decontamination"])
def test_stages_keep_columns(spark, awkward, nothing, small_dir, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, awkward[0], small_dir).columns == awkward[0].columns
    assert stage(spark, nothing, small_dir).isEmpty()
