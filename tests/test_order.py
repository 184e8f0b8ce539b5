"""Ranks and running sums over an order."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmix.operators.order import number_rows, quantiles


def rows(spark, n=400, hot=True, partitions=3):
    data = [(None if i % 19 == 0 else ("a" if hot and i % 3 else f"g{i % 5}"), (i * 37) % 101, i, i % 7) for i in range(n)]
    return spark.createDataFrame(data, "g string, x int, id int, w int").repartition(partitions), data


@pytest.mark.parametrize("partitions", [1, 5])
def test_number_rows(spark, partitions):
    df, data = rows(spark, partitions=partitions)
    got = {r["id"]: (r["rank"], r["running"]) for r in number_rows(df, ["g"], ["x", "id"], "w").collect()}
    want = {}
    for g in {d[0] for d in data}:
        total = 0
        for k, d in enumerate(sorted((d for d in data if d[0] == g), key=lambda d: (d[1], d[2]))):
            want[d[2]] = (k, total)
            total += d[3]
    assert got == want


def test_no_groups_and_nulls(spark):
    df = spark.createDataFrame([(3, None), (1, 5), (2, 2)], "x int, w long")
    got = sorted((r["x"], r["rank"], r["running"]) for r in number_rows(df, [], [F.desc("x")], "w").collect())
    assert got == [(1, 2, 2), (2, 1, 0), (3, 0, 0)]


def test_empty(spark):
    df = spark.createDataFrame([], "g string, x int")
    assert number_rows(df, ["g"], ["x"]).collect() == []


def test_quantiles(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 9, 101).astype(float), rng.normal(size=50)
    df = spark.createDataFrame([("a", float(v)) for v in a] + [("b", float(v)) for v in b] + [("b", None), ("c", None)], "g string, x double")
    got = {r["g"]: (r["lo"], r["mid"]) for r in quantiles(df, "g", "x", lo=0.05, mid=0.5).collect()}
    assert set(got) == {"a", "b"}
    for g, v in (("a", a), ("b", b)):
        assert got[g] == pytest.approx((np.percentile(v, 5), np.percentile(v, 50)))
