"""Ranks among a domain's reference rows."""

import random

import pytest
from pyspark.sql import functions as F

from corpusmix.functions.rng import uniform
from corpusmix.operators import params, select
from corpusmix.plans import catalog, selection


def test_reference_ranks_rest_on_all_rows(spark, monkeypatch):
    rows = spark.createDataFrame([(i, 0, i / 300, 1) for i in range(300)], "row_id long, domain long, merged double, tokens long")
    monkeypatch.setattr(selection, "merged", lambda spark, d: rows)
    got = {r["row_id"]: r["rank"] for r in catalog.QUERIES["quality_rank_reference"](spark, "").collect()}
    assert got == {i: round((300 - i) / 300, 6) for i in range(300)}


def test_reference_rows_are_those_of_lowest_hash(spark):
    rows = spark.createDataFrame([(i, i % 3 // 2) for i in range(5000)], "row_id long, domain long").withColumn("u", uniform(1729, "row_id"))
    every = rows.collect()
    for size in (1, 7, 400, 9000):
        got = {(r["domain"], r["row_id"]) for r in select.reference_rows(rows, size).collect()}
        want = {(d, r["row_id"]) for d in (0, 1) for r in sorted((r for r in every if r["domain"] == d), key=lambda r: (r["u"], r["row_id"]))[:size]}
        assert got == want
    assert select.reference_rows(rows.where("false"), 5).count() == 0


@pytest.mark.parametrize("size", [5, 10_000])
def test_many_sets_agree_with_one_after_another(spark, size):
    """The narrow pass draws what ranking each set of parameters by itself draws; nulls are never drawn."""
    r = random.Random(3)
    data = [(i, r.randrange(3), r.randrange(1, 9), *[round(r.random(), 1) for _ in range(5)]) for i in range(400)]
    scored = spark.createDataFrame([*data, (900, None, 1, *[0.5] * 5), (901, 1, 1, None, *[0.5] * 4)], "row_id long, domain long, tokens long, s0 double, s1 double, s2 double, s3 double, s4 double")
    theta = params.draw(spark, 6, 1, [0, 1, 2, 7]).withColumn("epsilon", F.lit(0.3))
    got = {(x["experiment_id"], x["row_id"]): (x["copies"], round(x["rank"], 9), round(x["value"], 9)) for x in select.select_many(scored, theta, size).collect()}
    want = {}
    for e in range(6):
        m = select.merge(scored.where("s0 is not null"), theta.where(F.col("experiment_id") == e))
        for x in select.select(select.rank_subset(m, size), 42, ("experiment_id", "row_id")).collect():
            want[e, x["row_id"]] = (x["copies"], round(x["rank"], 9), round(x["value"], 9))
    assert got == want and len({e for e, _ in got}) == 6
    assert select.select_many(scored.where("false"), theta).count() == 0
    assert select.select_many(scored, theta.where("false")).count() == 0
