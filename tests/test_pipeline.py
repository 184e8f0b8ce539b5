"""Whole pipelines, learners and plug-ins."""

import json

import pytest
from pyspark.sql import functions as F

from corpusmix.functions import plugins
from corpusmix.operators import params, regress
from corpusmix.plans import pipeline
from corpusmix.plans.selection import theta
from corpusmix.sources import experiments


def test_resample(spark, sf_dir, tmp_path):
    raw = spark.read.parquet(f"{sf_dir}/raw_shard.parquet")
    s = pipeline.resample(spark, raw, theta(spark), f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == s["selected"] == sum(d["selected"] for d in s["domains"])
    assert out.columns == ["text", "doc_id", "domain", "quality_rank", "sampling_weight", "sampling_value"]
    few = pipeline.resample(spark, raw, theta(spark), f"{tmp_path}/few", target_tokens=10)
    assert few["selected"] <= s["selected"]


def test_theta_json(spark):
    t = theta(spark)
    back = experiments.theta_of_json(spark, experiments.theta_json(t))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, t.collect()))


def test_drawn_weights_add_up(spark):
    p = params.draw(spark, 5, seed=1)
    assert all(abs(sum(r[f"a{i}"] for i in range(5)) - 1) < 1e-9 for r in p.collect())
    assert p.where("omega > 0.1 or lambda > 1000 or eta > 1 or epsilon > 0.001").count() == 0


def test_read_meta(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"exp_{i}").mkdir()
        if i:
            (tmp_path / f"exp_{i}" / "meta.json").write_text(json.dumps({"experiment_id": i, "val_loss": i + 0.5, "per_task_losses": {"t": 1.0}, "sampling_params": {"0": {"lambda": 1.0}}}))
    got = experiments.read_meta(spark, str(tmp_path)).collect()
    assert sorted((r["run"], r["experiment_id"], r["val_loss"]) for r in got) == [("exp_1", 1, 1.5), ("exp_2", 2, 2.5)]


def test_read_items(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"query": "q", "choices": ["a"], "gold": 0}\n{"context_options": ["c"], "continuation": "d", "gold": 0}\n')
    assert [r["gold"] for r in experiments.read_items(spark, str(tmp_path)).collect()] == [0, 0]


def test_learners(spark):
    rows = [(i, [float(i % 7), float(i % 3)], 2.0 * (i % 7) - (i % 3)) for i in range(60)]
    flat = spark.createDataFrame([(a, b) for a, b, _ in rows], "experiment_id long, theta array<double>")
    v = regress.vectors(flat, spark.createDataFrame([(a, c) for a, _, c in rows], "experiment_id long, loss double"))
    s = {(r["kind"], r["part"]): r["r2"] for r in regress.scores(v, spark.createDataFrame([(i,) for i in range(12)], "experiment_id long")).collect()}
    assert all(x > 0.7 for x in s.values())
    assert regress.least_squares(v).first()["r2"] == pytest.approx(1.0)
    assert regress.importances(v, ["a", "b"]).agg(F.sum("importance")).first()[0] == pytest.approx(1.0)
    c = regress.components(spark.createDataFrame([(float(i), 2.0 * i) for i in range(9)], "x double, y double"), ["x", "y"], 1)
    assert c.first()["share"] == pytest.approx(1.0)
    with pytest.raises(ValueError):
        regress.learner("none", 1, 1)


def test_plugins(spark):
    df = spark.createDataFrame([("abc",), (None,)], "text string")
    lengths = lambda: lambda texts: [float(len(t)) for t in texts]
    domain = lambda: lambda texts: [len(t) % 2 for t in texts]
    got = [(r["q0"], r["domain"]) for r in plugins.extract(df, [lengths], domain, 1).collect()]
    assert got == [(3.0, 1), (0.0, 0)]
    with pytest.raises(ValueError):
        plugins.extract(df, [lengths], domain, 2)
