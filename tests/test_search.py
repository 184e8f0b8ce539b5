"""The search for parameters looks at sets that nobody tested."""

import pytest
from pyspark.sql import functions as F

from corpusmix.functions.rng import uniform
from corpusmix.operators import params, search
from corpusmix.plans import experiments


def test_search_draws_new_sets(spark, sf_dir):
    scores, domains = experiments._search(spark, sf_dir, 300)
    rows = sorted((r["pred"], r["experiment_id"]) for r in scores.collect())
    assert len(rows) == 300
    assert len({p for p, _ in rows}) > 250
    drawn = params.draw(spark, 300, experiments.SEARCH_SEED, domains)
    want = params.melt(drawn).where(F.col("experiment_id").isin([i for _, i in rows[:5]])).groupBy("domain", "name").agg(F.avg("value").alias("v"))
    got = {(r["domain"], r["name"]): r["value"] for r in experiments.learn_and_search(spark, sf_dir, 300, 5).collect()}
    assert {(r["domain"], r["name"]): pytest.approx(r["v"]) for r in want.collect()} == got
    assert {d for d, _ in got} == {r["domain"] for r in experiments.theta(spark, sf_dir).select("domain").collect()}


def test_search_finds_a_lower_loss_than_any_tested(spark):
    """The loss is the first domain's lambda, which no tested set has below 500; the second has another domain each time."""
    t = params.draw(spark, 60, 1, [3, 5, 8]).withColumn("lambda", F.when(F.col("domain") == 3, 500 + F.col("lambda") / 2).otherwise(F.col("lambda")))
    t = t.where((F.col("domain") == 3) | ((F.col("experiment_id") % 2 == 0) == (F.col("domain") == 5)))
    losses = t.where("domain = 3").select("experiment_id", F.lit("x").alias("task"), F.col("lambda").alias("loss"))
    weights = spark.createDataFrame([("x", 1.0)], "task string, weight double")
    new = params.draw(spark, 400, 9999, [3, 5, 8])
    scores = search.search(losses, params.flatten(params.filled(t)), weights, params.flatten(new))
    best = {(r["domain"], r["name"]): r["value"] for r in search.best_theta(scores, new).collect()}
    assert best[3, "lambda"] < 100


def test_task_models_keep_experiments_of_other_domains(spark, monkeypatch):
    """The loss is the lambda of domain 3; beside it half of the experiments have domain 5, half 1, and one has both."""
    i = F.col("experiment_id")
    t = params.draw(spark, 80, 1, [1, 3, 5]).where((F.col("domain") == 3) | ((i % 2 == 0) == (F.col("domain") == 5)) | (i == 0))
    loss = t.where("domain = 3").select("experiment_id", F.lit("x").alias("task"), F.col("lambda").alias("loss"))
    monkeypatch.setattr(experiments, "theta", lambda spark, d: t)
    monkeypatch.setattr(experiments, "losses", lambda spark, d: loss)
    monkeypatch.setattr(experiments, "experiments", lambda spark, d: t.select("experiment_id").distinct())
    assert [r["r2"] > 0.9 for r in experiments.task_models(spark, "").collect()] == [True]


def test_reliability_is_out_of_bag(spark):
    """Losses that have nothing to do with the parameters can't be predicted out of the bag; those that have, can."""
    flat = params.flatten(params.draw(spark, 60, 1, [1, 3]))
    noise = flat.select("experiment_id", uniform(7, "experiment_id").alias("loss"))
    known = flat.select("experiment_id", F.col("theta")[10].alias("loss"))
    a, b = search.reliability(noise, flat).first(), search.reliability(known, flat).first()
    assert a["draws"] == b["draws"] == 200
    assert a["mean"] < 0.1 and a["low"] < a["mean"] < a["high"]
    assert b["low"] > 0.9
    assert search.reliability(noise.where("experiment_id < 9"), flat).count() == 0
    assert [search.bootstrap_rounds(n) for n in (9, 10, 49, 50, 199, 200, 499, 500)] == [0, 100, 100, 200, 200, 300, 300, 500]
