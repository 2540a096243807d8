"""Deduplication, rules, decontamination and the join against plain versions, on awkward rows and whole tables."""

import brute
import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.llm import catalog, ngram_join, quality
from tidecast.llm.decontaminate import contamination
from tidecast.llm.kmer_dedup import remove_windows
from tidecast.llm.ngram_join import linked, one_of_each
from tidecast.llm.suffix_dedup import remove_repeats
from tidecast.llm.tables import sieve, sifted


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def ordered(rows):
    return sorted(rows, key=repr)


def own_columns_stay(out, replaced):
    for c in {"kept": "a", "n_words": "b", "_id": "c"}.items():
        if c[0] not in replaced:
            assert {r[0] for r in out.select(c[0]).collect()} == {c[1]}


def removed(df):
    return F.expr("aggregate(removed, 0L, (sum, x) -> sum + (x.hi - x.lo))")


@pytest.mark.parametrize(("window", "gram"), [(400, 128), (100, 40)])
def test_suffix_dedup(awkward, window, gram):
    docs, rows = awkward
    out = remove_repeats(docs, window, gram)
    assert out.columns == ["doc_id", "text", "n_words", "_id", "removed", "kept"]
    own_columns_stay(out, {"kept"})
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    got = rows_of(out.select("doc_id", size, removed(out), F.size("removed"), F.sha2("kept", 256)))
    assert got == ordered(brute.suffix_dedup(rows, window))


@pytest.mark.parametrize(("window", "gram"), [(50, 16), (24, 10)])
def test_kmer_dedup(awkward, window, gram):
    docs, rows = awkward
    out = remove_windows(docs, window, gram)
    assert out.columns == ["doc_id", "text", "n_words", "_id", "words", "removed", "kept"]
    own_columns_stay(out, {"kept"})
    got = rows_of(out.select("doc_id", "words", removed(out), F.sha2(F.encode("kept", "utf-8"), 256)))
    assert got == ordered(brute.kmer_dedup(rows, window))


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_jaccard_join(awkward, size, percent):
    docs, rows = awkward
    got = rows_of(linked(docs, size, percent).select("_id", "n_shingles", "component_id"))
    assert got == ordered(brute.jaccard(rows, size, percent))


@pytest.mark.parametrize("percent", [50, 67, 80, 90])
@pytest.mark.parametrize("spread", [False, True])
def test_linked_sets_have_a_key_in_common(percent, spread):
    rng = np.random.default_rng(percent)
    classes = rng.choice(np.array([85, 102, 153, 255], np.uint8), 1 << (ngram_join.SLOT_BITS - 2))  # no class is 0
    for _ in range(300):
        shared = int(rng.integers(1, 120))
        most = shared * (100 - percent) // percent
        apart = int(rng.integers(0, most + 1)) if not spread else most
        every = np.sort(rng.integers(0, 1 << 64, shared + apart, np.uint64, endpoint=False))
        ranked = every[np.lexsort((every, ngram_join.class_of(every, classes)))]
        # spread: of the first ones, every other is in one set only, so that shared ones meet as late as they can
        odd = np.arange(apart) * 2 + 1 if spread else rng.choice(len(every), apart, replace=False)
        mine = rng.random(apart) < rng.random()
        a, b = (np.sort(np.delete(ranked, odd[x])) for x in (mine, ~mine))
        if not (percent >= 67 and np.array_equal(a, b)):
            assert len(np.intersect1d(ngram_join.keys(a, classes, percent), ngram_join.keys(b, classes, percent)))


def test_a_rare_shingle_by_chance_joins_no_cluster(spark, monkeypatch):
    """Every two of 41 texts have one word in common, which no third one has; two more texts are like another."""
    seen, find = [], ngram_join.components
    monkeypatch.setattr(ngram_join, "components", lambda edges: seen.append(edges.count()) or find(edges))
    rows = [(i, " ".join(f"w{min(i, j)}x{max(i, j)}" for j in range(41) if j != i)) for i in range(41)]
    rows += [(50, rows[7][1] + " more"), (51, rows[7][1] + " words")]
    got = rows_of(linked(spark.createDataFrame(rows, "doc_id long, text string"), 1).select("_id", "n_shingles", "component_id"))
    assert got == ordered(brute.jaccard(rows, 1))
    assert 2 <= seen[0] <= 3  # among the three that are alike


def test_stage_clusters_only_copies_when_the_table_of_rarity_is_full(spark, monkeypatch):
    """Every two of 41 texts share a run of five words; all shingles look as frequent as in a corpus of any size."""
    seen, find = [], ngram_join.components
    monkeypatch.setattr(ngram_join, "components", lambda edges: seen.append(edges.count()) or find(edges))
    monkeypatch.setattr(ngram_join, "rarity", lambda texts, size: np.full(1 << 25, 255, np.uint8))
    run = lambda i, j: " ".join(f"{c}{min(i, j)}x{max(i, j)}" for c in "abcde")
    rows = [(i, " ".join(run(i, j) for j in range(41) if j != i)) for i in range(41)]
    rows += [(50, rows[7][1] + " more"), (51, rows[9][1] + " words")]
    kept = corpus_pipeline.ngram_jaccard_join(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(kept.collect()) == sorted(rows[:41])
    assert seen[0] == 2


def test_one_of_each_keeps_one_row_of_a_component(awkward):
    docs, rows = awkward
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    own_columns_stay(kept, set())
    ids = [r.doc_id for r in kept.collect()]
    # 1 stands for its copies and near copies; rows without words all stay; of id 10 one text is a copy of 1
    assert sorted(x for x in ids if x is not None) == [1, 4, 5, 6, 7, 9, 10, 11, 12, 13, 14, 15]
    assert ids.count(None) == 1


def test_decontamination(spark, awkward):
    docs, rows = awkward
    items = [(1, rows[0][1][:200]), (10, "One two"), (2, "w7 nowhere at all"), (None, "lone"), (3, None), (4, "!!"), (1, rows[0][1][100:260])]
    out = contamination(docs, spark.createDataFrame(items, "item_id long, text string"))
    own_columns_stay(out, {"n_words"})
    digest = F.sha2(F.encode(F.array_join("items", ","), "utf-8"), 256)
    got = rows_of(out.select("doc_id", "n_words", F.size("hit"), F.size("items"), digest, F.size("hit") > 0))
    assert got == ordered(brute.decontaminate(rows, items))
    empty = contamination(docs, spark.createDataFrame([], "item_id long, text string"))
    assert empty.where("size(hit) > 0").isEmpty() and empty.count() == len(rows)


def test_a_large_benchmark_takes_several_passes(spark, awkward, monkeypatch):
    docs, rows = awkward
    items = [(i, " ".join(rows[0][1].split()[i : i + 14])) for i in range(0, 200, 20)] + [(99, "one two")]
    table = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr("tidecast.llm.decontaminate.PASS_BYTES", 200)
    out = contamination(docs, table)
    digest = F.sha2(F.encode(F.array_join("items", ","), "utf-8"), 256)
    got = rows_of(out.select("doc_id", "n_words", F.size("hit"), F.size("items"), digest, F.size("hit") > 0))
    assert got == ordered(brute.decontaminate(rows, items))


def test_quality_rules(awkward):
    docs, rows = awkward
    out = quality.judge(docs)
    got = rows_of(out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
    assert got == ordered(brute.quality(rows))
    assert out.where("kept AND base_failed").isEmpty()
    assert out.columns[:3] == ["doc_id", "text", "_id"]


def test_empty_tables(nothing, spark):
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    for out in (remove_repeats(nothing), remove_windows(nothing), linked(nothing), one_of_each(nothing), contamination(nothing, items), quality.judge(nothing)):
        assert out.isEmpty()


def test_sieve_lets_every_key_through(spark):
    keys = spark.range(0, 3000, 3).withColumnRenamed("id", "k")
    rows = spark.range(3000).withColumnRenamed("id", "k")
    bitmap = sieve(keys, "k", 12)
    assert bitmap.count() <= 1 << 6
    passed = {r.k for r in sifted(rows, "k", bitmap, 12).where("_maybe").collect()}
    assert passed >= set(range(0, 3000, 3)) and len(passed) < 3000


def table(spark, path, name):
    return [tuple(r) for r in spark.read.parquet(f"{path}/{name}.parquet").collect()]


@pytest.mark.parametrize("name", ["op3_suffix_dedup", "op5_ngram_jaccard_join", "op8_benchmark_decontamination", "op10_substring_dedup"])
def test_queries_over_whole_tables(spark, small_dir, name):
    docs = [x[:2] for x in table(spark, small_dir, "documents")]
    want = {
        "op3_suffix_dedup": lambda: brute.suffix_dedup(docs, 400),
        "op5_ngram_jaccard_join": lambda: brute.jaccard(docs),
        "op8_benchmark_decontamination": lambda: brute.decontaminate(docs, table(spark, small_dir, "benchmark")),
        "op10_substring_dedup": lambda: brute.kmer_dedup(docs, 50),
    }[name]()
    out = catalog.QUERIES[name](spark, small_dir)
    assert rows_of(out.select(*out.columns[: len(want[0])])) == ordered(want)
    if name == "op3_suffix_dedup":  # one more column: what is left as text
        assert all(brute.sha(r.text) == r.kept_sha256 for r in out.where("n_removed = 0").collect())
        cut = out.where("n_removed > 0").collect()
        assert cut and all(len(r.text.encode()) <= r.n_bytes - r.n_removed for r in cut)
