import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.functions import scalars as S
from tidecast.operators import encode, rank, split


def test_narrowing_uses_open_bounds(spark):
    df = spark.createDataFrame([(126, 127, 40000, 1.5), (-127, 0, 0, 2.5)], "a bigint, b bigint, c bigint, f double")
    types = dict(encode.narrow_numeric_types(df).dtypes)
    assert types == {"a": "tinyint", "b": "smallint", "c": "int", "f": "double"}
    assert dict(encode.narrow_numeric_types(df, floats=True).dtypes)["f"] == "float"


def test_category_codes_shift_when_nulls_exist(spark):
    df = spark.createDataFrame([("b", "y"), (None, "x"), ("a", "x")], "v string, w string")
    out = {(r.v, r.w): (r.v_code, r.w_code) for r in encode.category_codes(df, ["v", "w"]).collect()}
    assert out == {("b", "y"): (2, 1), (None, "x"): (0, 0), ("a", "x"): (1, 0)}


def test_label_encoding_learns_on_train_only(spark):
    train = spark.createDataFrame([("b",), ("a",), ("b",)], "v string")
    codes = encode.fit_codes(train, ["v"])
    seen = encode.apply_codes(spark.createDataFrame([("b",), ("a",)], "v string"), codes)
    assert {r.v: r.v_code for r in seen.collect()} == {"a": 0, "b": 1}
    other = spark.createDataFrame([("c",)], "v string")
    with pytest.raises(Exception, match="unseen label in v: c"):
        encode.apply_codes(other, codes).collect()
    assert encode.apply_codes(other, codes, on_unseen="null").first().v_code is None


def test_codes_of_many_labels(spark):
    df = spark.range(100_000).select(F.sha1(F.col("id").cast("string")).alias("v")).repartition(4)
    codes = encode.dictionary(df.union(df.limit(500)), "v", "code")
    rows = codes.collect()
    assert len(rows) == 100_000
    assert [r.v for r in sorted(rows, key=lambda r: r.code)] == sorted(r.v for r in rows)
    assert sorted(r.code for r in rows) == list(range(100_000))
    coded = encode.category_codes(df, ["v"])
    assert coded.where("v_code IS NULL").count() == 0 and coded.agg(F.max("v_code")).first()[0] == 99_999
    plan = codes._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan or "_rows" in plan


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_places_within_groups(spark, partitions):
    rows = [(g, i * 7 % 50, f"t{i % 5}") for g in ("a", None, "c") for i in range(50)]
    df = spark.createDataFrame(rows, "g string, n int, t string").repartition(partitions)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = rank.numbered(df, ["n", "t"], "at", ["g"], ["n"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    for g in ("a", None, "c"):
        own = sorted((r for r in got if r.g == g), key=lambda r: r["at"])
        assert [r["at"] for r in own] == list(range(50)) and [r.n for r in own] == list(range(49, -1, -1))
    assert rank.numbered(df.limit(0), ["n"], "at").isEmpty()


def test_item_means_leave_the_own_fold_out(spark):
    rows = [(i, "abc"[i % 3] if i % 11 else None, float(i % 7) if i % 13 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, item string, y double").withColumn("fold", encode.fold_of(["k"], 4))
    means = encode.fit_target_means(df, "item", "y", ["k"], folds=4, prior=3.0)
    data = df.collect()

    def mean(item, without):
        left = [r for r in data if r.fold != without and r.y is not None]
        own = [r.y for r in left if r["item"] == item]
        m = sum(r.y for r in left) / len(left)
        return (sum(own) + 3.0 * m) / (len(own) + 3.0)

    half = means.encode(df, "code", trained=F.col("k") % 2 == 0).collect()
    assert len(half) == 400
    for r in half:
        assert r.code == pytest.approx(mean(r["item"], r.fold if r.k % 2 == 0 else None))
    new = means.encode(spark.createDataFrame([(900, "zz")], "k int, item string"), "code").first()
    assert new.code == pytest.approx(np.mean([r.y for r in data if r.y is not None]))


def test_blocked_split_is_complete_and_disjoint(spark):
    df = spark.range(1, 41).select(F.col("id").cast("int").alias("day"))
    train, valid = split.blocked_split(df, "day", [(31, 35), (11, 15)])
    got = {r.day: r.valid_window for r in valid.collect()}
    assert got == {**{d: 1 for d in range(31, 36)}, **{d: 2 for d in range(11, 16)}}
    assert sorted([r.day for r in train.collect()] + list(got)) == list(range(1, 41))


def test_origin_split(spark):
    df = spark.createDataFrame([(o, o + s) for o in range(1, 21) for s in range(3)], "origin int, day int")
    train, valid, scored = split.origin_split(df, "origin", "day", 10, [(8, 10)])
    assert all(r.origin <= 10 and not 8 <= r.day <= 10 for r in train.collect())
    assert {r.day for r in valid.collect()} == {8, 9, 10}
    assert sorted((r.origin, r.day) for r in scored.collect()) == [(8, 8), (8, 9), (8, 10)]


@pytest.mark.parametrize("n", [0, 1, 137, 1000, 2000])
def test_holdout_has_exactly_n_rows_and_ignores_partitioning(spark, n):
    df = spark.range(1000).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").cast("int").alias("day"))
    train, held = split.sample_holdout(df, ["k", "day"], n)
    kept = {r.day for r in held.collect()}
    assert len(kept) == min(n, 1000)
    assert kept | {r.day for r in train.collect()} == set(range(1000)) and train.count() == 1000 - len(kept)
    again = split.sample_holdout(df.repartition(7, "day"), ["k", "day"], n)[1]
    assert {r.day for r in again.collect()} == kept


def test_holdout_is_the_smallest_digests(spark):
    df = spark.range(300).select(F.col("id").alias("k"))
    ranked = [r.k for r in df.orderBy(split.key_digest(["k"], 64)).collect()]
    held = split.sample_holdout(df, ["k"], 40)[1]
    assert {r.k for r in held.collect()} == set(ranked[:40])
    assert {r.k for r in split.without(df, held, ["k"]).collect()} == set(ranked[40:])


def test_scalar_expressions(spark):
    df = spark.createDataFrame(
        [("FOODS_3_090_CA_3_validation", "d_17", "CA_3", 1, 0)], "id string, d string, store string, snap_CA int, snap_TX int"
    )
    parts = S.series_id_parts(F.col("id"))
    row = df.select(
        *[c.alias(n) for n, c in parts.items()],
        S.day_ordinal(F.col("d")).alias("n"),
        S.snap_flag(F.col("store"), {"CA": F.col("snap_CA"), "TX": F.col("snap_TX")}).alias("snap"),
        S.snap_flag(F.lit("WI_1"), {"CA": F.col("snap_CA")}).alias("none"),
        S.valid_window_number(F.lit(12), [(11, 14), (12, 20)]).alias("w"),
        S.step_label(F.lit(3)).alias("F"),
        S.ratio(F.lit(1.0), F.lit(0.0)).alias("r"),
    ).first()
    assert (row.item_id, row.dept_id, row.store_id, row.state_id) == ("FOODS_3_090", "FOODS_3", "CA_3", "CA")
    assert (row.n, row.snap, row.none, row.w, row["F"], row.r) == (17, 1, 0, 1, "F3", None)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 6])
def test_selection_looks_behind_equal_prefixes(spark, n):
    digests = ["aaaa0000" + "0" * 24, "aaaa0001" + "0" * 24, "aaaa0001" + "0" * 23 + "1", "aaaa0001" + "f" * 24, "b" * 32]
    df = spark.createDataFrame([(d,) for d in digests], "_digest string")
    cut = split.nth_digest(df, n)
    if n > 5:
        assert cut is None
    else:
        assert [d for d in digests if d[: len(cut)] <= cut] == digests[:n]


def test_holdout_ranks_nothing(spark):
    df = spark.range(3000).select(F.col("id").alias("k"))
    plan = split.sample_flag(df, ["k"], 700)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan and "Exchange" not in plan
