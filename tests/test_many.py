"""Selections of many sets of parameters: hashes of all pairs, curves of any shape, drawn once for each query."""

from hashlib import md5

import pytest
from pyspark.sql import functions as F

from corpusmix.functions.rng import first_words, tail_words
from corpusmix.operators import params, select
from corpusmix.plans import catalog, experiments


@pytest.fixture
def drawn(spark, monkeypatch):
    """How often a query has made the selections of six sets."""
    scored = spark.createDataFrame([(i, i % 3, 1 + i % 7, *[(i * k % 101) / 100 for k in (3, 5, 7, 2, 9)]) for i in range(600)], "row_id long, domain long, tokens long, s0 double, s1 double, s2 double, s3 double, s4 double")
    theta = params.draw(spark, 6, 1, 3).withColumn("epsilon", F.lit(0.3))
    every = select.select_many(scored, theta).count()
    monkeypatch.setattr(experiments, "scored", lambda spark, d: scored)
    monkeypatch.setattr(experiments, "theta", lambda spark, d: theta)
    rows, many = spark.sparkContext.accumulator(0), select.select_many

    def counted(*a, **k):
        def run(batches):
            for b in batches:
                rows.add(b.num_rows)
                yield b

        out = many(*a, **k)
        return out.mapInArrow(run, out.schema)

    monkeypatch.setattr(select, "select_many", counted)
    return lambda: rows.value / every


def test_first_words_are_those_of_md5():
    for h in (1, 2, 3, 4, 5, 8, 11, 27):
        for t in (1, 2, 3, 4, 7, 21, 28):
            heads, tails = [b"%0*d" % (h, i) for i in range(3)], [b"%0*d" % (t, i) for i in range(5)]
            got = first_words(heads, tail_words(tails, h)).tolist()
            assert got == [[int(md5(a + b).hexdigest()[:8], 16) for b in tails] for a in heads]
    with pytest.raises(ValueError):
        tail_words([bytes(40)], 16)


def test_any_curve_and_any_keys(spark):
    """Against each set by itself: curves over all ranks or none, epsilon of 0 and over 1, keys of several lengths, negative ones."""
    data = [(i * 37 - 300, i % 2, 1 + i % 7, *[(i * k % 11) / 10 for k in (3, 5, 7, 2, 9)]) for i in range(300)]
    scored = spark.createDataFrame(data, "row_id long, domain long, tokens long, s0 double, s1 double, s2 double, s3 double, s4 double")
    shapes = [(1.0, 0.2), (-1.0, 0.2), (0.0, 0.4), (0.3, 0.0), (0.3, 1.3), (0.05, 0.001), (0.5, 2.0)]
    theta = params.draw(spark, len(shapes), 1, 2)
    for c, k in (("omega", 0), ("epsilon", 1)):
        theta = theta.withColumn(c, F.element_at(F.array(*[F.lit(s[k]) for s in shapes]), (F.col("experiment_id") + 1).cast("int")))
    theta = theta.withColumn("experiment_id", F.pow(F.lit(-12), F.col("experiment_id")).cast("long"))
    got = {(x["experiment_id"], x["row_id"]): (x["copies"], round(x["rank"], 9), round(x["value"], 9)) for x in select.select_many(scored, theta).collect()}
    want = {}
    for i in range(len(shapes)):
        m = select.merge(scored, theta.where(F.col("experiment_id") == (-12) ** i))
        for x in select.select(select.rank_subset(m, select.REFERENCE), 42, ("experiment_id", "row_id")).collect():
            want[(-12) ** i, x["row_id"]] = (x["copies"], round(x["rank"], 9), round(x["value"], 9))
    assert got == want and len({e for e, _ in got}) >= len(shapes) - 1
    assert select.select_many(scored, theta, columns=("row_id", "copies")).columns == ["row_id", "copies"]


def test_fallback_draws_once(spark, sf_dir, drawn):
    assert len(catalog.QUERIES["selection_with_fallback"](spark, sf_dir).collect()) > 600
    assert drawn() == 1


def test_fallback_of_experiments_without_a_record(spark, sf_dir, monkeypatch):
    many = select.select_many
    monkeypatch.setattr(select, "select_many", lambda *a, **k: many(*a, **k).where("experiment_id > 0"))
    rows = catalog.QUERIES["selection_with_fallback"](spark, sf_dir).where("experiment_id = 0").collect()
    assert len(rows) == 100 and {r["copies"] for r in rows} == {1}


def test_budget_draws_once(spark, sf_dir, drawn):
    assert len(catalog.QUERIES["experiment_budget"](spark, sf_dir).collect()) > 600
    assert drawn() == 1


@pytest.mark.parametrize("guess", [True, False])
def test_copies_kept_are_those_of_lowest_hash(spark, monkeypatch, guess):
    """Groups within the budget, of many and of few tokens a row; also where no row is below the hash that was to do."""
    data = [(e, i * e % 9973, 1 + i % t, 1 + i % 3) for e, n, t in ((1, 50, 3), (2, 3000, 1), (3, 3000, 90), (4, 120, 400)) for i in range(n)]
    rows = spark.createDataFrame(data, "experiment_id long, row_id long, tokens long, copies int")
    if not guess:
        monkeypatch.setattr(select, "TWO_32", 1.0)
    got = {(r[0], r[1]): r[2] for r in select.subsample_copies(rows, 1000).collect()}
    each = select.subsample(select.repeat(rows.withColumn("_e", F.col("experiment_id"))), 1000, 0, ("experiment_id",))
    want = {(r[0], r[1]): r[2] for r in each.groupBy("experiment_id", "row_id").count().collect()}
    assert {e: sum(c for (x, _), c in got.items() if x == e) for e in range(1, 5)} == {1: 99, 2: 1200, 3: 100, 4: 100}
    assert {k for k in got if k[0] != 4} and got == want


def test_components_draw_once(spark, sf_dir, drawn):
    assert len(catalog.QUERIES["mix_components"](spark, sf_dir).collect()) == 66
    assert drawn() == 1
