"""Cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from corpusmix.functions import taxonomy, text
from corpusmix.functions.rng import uniform
from corpusmix.operators import normalize, search, select, valset
from corpusmix.schema import PREFIX_DOMAIN


def one(df, c):
    return [r[c] for r in df.collect()]


def scores(spark, values):
    return spark.createDataFrame([(i, 0, float(v)) for i, v in enumerate(values)], "row_id long, criterion int, x double")


@pytest.mark.parametrize(
    "name,values,want",
    [
        ("rank", [10, 20, 20, 30], [0, 0.375, 0.375, 0.75]),
        ("zscore", [5, 5, 5], [0, 0, 0]),
        ("minmax", [5, 5, 5], [0, 0, 0]),
        ("minmax", [1, 3, 2], [0, 1, 0.5]),
        ("quantile", [3, 1, 2], [1, 0, 0.5]),
        ("ordinal", [3, 1, 2], [2 / 3, 0, 1 / 3]),
        ("sigmoid_iqr", [4, 4, 4], [0.5, 0.5, 0.5]),
        ("threshold_rank", [1, 2, 3, 4], [0, 0.25, 0.5, 0.75]),
        ("robust_z", [7, 7], [0, 0]),
        ("log1p_z", [2, 2], [0, 0]),
    ],
)
def test_normalizers(spark, name, values, want):
    got = normalize.normalizer(name)(scores(spark, values)).orderBy("row_id")
    assert one(got, "sigma") == pytest.approx(want)


def test_threshold_rank_splits_a_heavy_tail(spark):
    got = one(normalize.threshold_rank(scores(spark, [0] * 100 + list(range(1, 13)) + [1000])).orderBy("row_id"), "sigma")
    assert got[:100] == [0] * 100
    assert got[100:] == pytest.approx([i / 13 for i in range(13)])


def test_unknown_normalizer():
    with pytest.raises(ValueError):
        normalize.normalizer("none")


def merged(spark, scores, tokens):
    return spark.createDataFrame([(i, 0, float(s), t) for i, (s, t) in enumerate(zip(scores, tokens))], "row_id long, domain long, merged double, tokens long")


def test_ranks(spark):
    assert one(select.rank_rows(merged(spark, [0.9, 0.5, 0.1], [1, 2, 1])).orderBy("row_id"), "rank") == [0.25, 0.75, 1.0]
    assert one(select.rank_rows(merged(spark, [0.9, 0.5], [0, 0])).orderBy("row_id"), "rank") == [0.5, 0.5]
    assert one(select.rank_range(merged(spark, [0.5, 0.5], [1, 1])).orderBy("row_id"), "rank") == [1.0, 1.0]
    assert one(select.rank_rows(merged(spark, [0.5, 0.5], [1, 1])).orderBy("row_id"), "rank") == [0.5, 1.0]
    assert one(select.rank_subset(merged(spark, [0.9, 0.5, 0.1], [1, 2, 1]), 3).orderBy("row_id"), "rank") == [0.25, 0.75, 1.0]


def test_sampling_value(spark):
    df = spark.createDataFrame([(r, 300.0, 0.1, 0.6, 0.001) for r in (0.0, 0.1, 0.100001, 1.0)], "rank double, lambda double, omega double, eta double, epsilon double")
    got = one(df.orderBy("rank").withColumn("v", select.sampling_value()), "v")
    assert got[0] == pytest.approx(2**0.6 + 0.001)
    assert got[1:] == pytest.approx([1.001, 0.001, 0.001])


def test_copies(spark):
    df = spark.createDataFrame([(i, float(i % 3)) for i in range(30)], "row_id long, value double")
    assert all(r["c"] == int(r["value"]) for r in df.withColumn("c", select.copies("value", 1, "row_id")).collect())
    n = spark.range(20000).withColumnRenamed("id", "row_id").withColumn("value", F.lit(1.3)).withColumn("c", select.copies("value", 1, "row_id"))
    assert n.agg(F.avg("c")).first()[0] == pytest.approx(1.3, abs=0.02)


def test_repeat(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 3)], "row_id long, copies int")
    assert sorted((r["row_id"], r["copy"]) for r in select.repeat(df).collect()) == [(2, 0), (3, 0), (3, 1), (3, 2)]


def test_budget(spark):
    df = spark.createDataFrame([(i, 5) for i in range(3)], "row_id long, tokens long")
    assert select.prefix(df, ["row_id"], 8).count() == 2
    assert select.prefix(df, ["row_id"], 8, closed=True).count() == 1


def test_domains(spark):
    codes = ["746.92", "510", "640", "45", "7", None, "99"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "i int, c string")
    assert one(df.orderBy("i").select(taxonomy.domain_of_code(F.col("c")).alias("d")), "d") == [16, 9, 21, -1, -1, -1, 19]
    assert len(PREFIX_DOMAIN) == 93


def test_taxonomy_forms(spark):
    good = '{"free_decimal_correspondence": {"primary": {"code": "512"}}}'
    forms = [good, good[:-5], "[]", "5", "", None, '{"free_decimal_correspondence": 3}', good.replace('"512"', "512"), good.replace('"512"', "null")]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(forms)], "i int, eai_taxonomy string")
    assert one(df.orderBy("i").select(taxonomy.domain().alias("d")), "d") == [9] + [-1] * 8


def test_repetition_and_hygiene(spark):
    texts = ["a" * 999, "a" * 1000, "", None, "ab" * 600, " a" * 1000, "abcd" * 400, "x" * 1_000_001]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").orderBy("i")
    assert one(df.select(text.repetitive().alias("r")), "r") == [False, True, False, False, True, True, False, True]
    assert one(df.select(text.hygiene().alias("r")), "r") == ["kept", "repetition", "empty", "empty", "repetition", "repetition", "kept", "too_long"]


def test_tokens(spark):
    df = spark.createDataFrame([("one two  three",), ("",), (None,)], "text string")
    assert one(df.select(text.tokens_by_words().alias("n")), "n") == [3, 1, 1]


def test_uniform_is_partition_free(spark):
    a = spark.range(100).repartition(7).select("id", uniform(1, "id").alias("u"))
    b = spark.range(100).coalesce(1).select("id", uniform(1, "id").alias("u"))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_allocate():
    assert valset.allocate({"a": 2, "b": 20}, 10) == {"a": 2, "b": 8}
    assert valset.allocate({}, 10) == {}
    assert valset.allocate({"a": 1, "b": 1}, 10) == {"a": 1, "b": 1}


def test_quality(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, 3.0), (3, 3.0, 2.0)], "experiment_id long, actual double, pred double")
    q = search.quality(df, k=2).first()
    assert q["recall"] == 0.5
    assert q["spearman"] == pytest.approx(0.5)


def test_masks(spark):
    df = spark.createDataFrame([([1, 2], [3], False), ([1, 2], [3, 4, 5], True), ([1, 2, 3, 4, 5], [6], False)], "c array<int>, a array<int>, f boolean")
    ids, mask = valset.masked(F.col("c"), F.col("a"), F.col("f"), 4)
    got = [(r["i"], r["m"]) for r in df.select(ids.alias("i"), mask.alias("m")).collect()]
    assert got == [([1, 2, 3, 0], [False, False, True, False]), ([1, 2, 3, 4], [True] * 4), ([1, 2, 3, 4], [False] * 4)]


def test_converters(spark):
    e = spark.createDataFrame([("ctx", ["x", "y"], "1"), ("ctx", ["x"], "3"), (None, None, None)], "c string, o array<string>, l string")
    assert one(valset.endings(e, "c", "o", "l"), "continuation") == ["y"]
    w = spark.createDataFrame([("The _ fell.", ["cup", "plate"], "0")], "s string, o array<string>, l string")
    assert tuple(valset.blank(w, "s", "o", "l").first()) == ("The cup", " fell.")
    q = spark.createDataFrame([("I slept.", ["I was tired.", "I ran."], "0", "cause")], "p string, o array<string>, l string, k string")
    assert tuple(valset.cause(q, "p", "o", "l", "k").first()) == ("I slept because ", "I was tired.")
    d = spark.createDataFrame([(1, "Story.", ["Who?", "Why?"], ["Ann", "Fun"])], "id long, s string, q array<string>, a array<string>")
    assert [r["context"] for r in valset.dialogues(d, "id", "s", "q", "a").orderBy("turn").collect()] == ["Story.\nQ: Who?\nA:", "Story.\nQ: Who?\nA: Ann\nQ: Why?\nA:"]
    o = spark.createDataFrame([("Which?\nA. red\nB. blue", "B")], "q string, l string")
    assert o.select(valset.lettered_choice("q", "l").alias("c")).first()[0] == "blue"
    p = valset.passages(spark.createDataFrame([("P.", "Q?", True)], "p string, q string, a boolean"), "p", "q", F.when(F.col("a"), "yes").otherwise("no"))
    assert tuple(p.first()) == ("P.\nQuestion: Q?\nAnswer:", " yes")
