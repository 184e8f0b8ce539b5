"""Sets of parameters: drawing them, reading them from experiments, flat and long forms."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmix.functions.rng import uniform
from corpusmix.operators.select import WEIGHTS
from corpusmix.schema import CRITERIA, DOMAINS

CURVE = ("lambda", "omega", "eta", "epsilon")
SCALES = {"lambda": 1000.0, "omega": 0.1, "eta": 1.0, "epsilon": 0.001}


def latest(meta: DataFrame) -> DataFrame:
    """One row per experiment: the last to finish; rows without an id are left out."""
    w = Window.partitionBy("experiment_id").orderBy(F.desc_nulls_last("finished_at"), "val_loss", "train_loss")
    return meta.where("experiment_id is not null").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def of_experiments(experiments: DataFrame) -> DataFrame:
    """experiment_id, domain, a0..a4, lambda, omega, eta, epsilon; a missing weight is 0, a missing curve no row."""
    e = experiments.select("experiment_id", "quality_weights", "sampling_params", F.explode(F.map_keys("sampling_params")).alias("_k"))
    weight = lambda c: F.coalesce(F.try_element_at(F.try_element_at("quality_weights", F.col("_k")), F.lit(c)), F.lit(0.0))
    curve = lambda c: F.try_element_at(F.try_element_at("sampling_params", F.col("_k")), F.lit(c))
    p = e.select("experiment_id", F.expr("try_cast(_k as bigint)").alias("domain"), *[weight(c).alias(a) for c, a in zip(CRITERIA, WEIGHTS)], *[curve(c).alias(c) for c in CURVE])
    return p.dropna(subset=["domain", *CURVE])


def draw(spark: SparkSession, n: int, seed: int = 0, domains: int | Iterable[int] = DOMAINS) -> DataFrame:
    """n random sets: weights of the criteria, shared by all domains, times weights of the domain's own,
    each set adding up to 1; curves uniform within their scales. The same for the same seed and number."""
    return drawn(spark.range(n).withColumnRenamed("id", "experiment_id"), seed, domains)


def drawn(ids: DataFrame, seed: int = 0, domains: int | Iterable[int] = DOMAINS) -> DataFrame:
    """The sets that draw gives to these numbers (experiment_id), without drawing the others."""
    each = F.array(*[F.lit(i).cast("long") for i in (range(domains) if isinstance(domains, int) else domains)]).cast("array<bigint>")
    shared = [uniform(seed, F.lit("a"), "experiment_id", F.lit(i)).alias(f"_s{i}") for i in range(len(CRITERIA))]
    d = ids.select("experiment_id", *shared).withColumn("domain", F.explode(each))
    raw = [F.col(f"_s{i}") * uniform(seed, F.lit("b"), "experiment_id", "domain", F.lit(i)) for i in range(len(CRITERIA))]
    d = d.select("experiment_id", "domain", *[r.alias(f"_r{i}") for i, r in enumerate(raw)])
    total: Column = sum((F.col(f"_r{i}") for i in range(1, len(CRITERIA))), F.col("_r0"))
    return d.select("experiment_id", "domain", *[(F.col(f"_r{i}") / total).alias(a) for i, a in enumerate(WEIGHTS)], *[(uniform(seed, F.lit(c), "experiment_id", "domain") * SCALES[c]).alias(c) for c in CURVE])


def filled(theta: DataFrame) -> DataFrame:
    """A row for each set and each domain that any of them has, 0 where the set lacks it, so that all flat vectors are
    as long and a place in them means the same domain."""
    grid = theta.select("experiment_id").distinct().crossJoin(F.broadcast(theta.select("domain").distinct()))  # a row for each domain
    return grid.join(theta, ["experiment_id", "domain"], "left").select("experiment_id", "domain", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in (*WEIGHTS, *CURVE)])


def melt(theta: DataFrame) -> DataFrame:
    """experiment_id, domain, name, value."""
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in (*WEIGHTS, *CURVE)]))
    return theta.select("experiment_id", "domain", rows.alias("r")).select("experiment_id", "domain", "r.*")


def flatten(theta: DataFrame) -> DataFrame:
    """experiment_id, theta: all weights by domain, then the four values of each domain's curve."""
    own = F.struct("domain", F.array(*WEIGHTS).alias("a"), F.array(*CURVE).alias("b"))
    g = theta.groupBy("experiment_id").agg(F.array_sort(F.collect_list(own)).alias("_d"))  # a row for each domain
    return g.select("experiment_id", F.concat(F.flatten(F.transform("_d", lambda x: x["a"])), F.flatten(F.transform("_d", lambda x: x["b"]))).alias("theta"), F.transform("_d", lambda x: x["domain"]).alias("domains"))


def unflatten(flat: DataFrame) -> DataFrame:
    """The long form again: experiment_id, domain, name, value."""
    n, k, c = F.size("domains"), len(WEIGHTS), len(CURVE)
    p = flat.select("experiment_id", "domains", n.alias("_n"), F.posexplode("theta").alias("_pos", "value"))
    own = F.col("_pos") < F.col("_n") * k
    place = F.when(own, F.floor(F.col("_pos") / k)).otherwise(F.floor((F.col("_pos") - F.col("_n") * k) / c)).cast("int")
    which = F.when(own, F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("_pos") % k + 1).cast("int"))).otherwise(F.element_at(F.array(*map(F.lit, CURVE)), ((F.col("_pos") - F.col("_n") * k) % c + 1).cast("int")))
    return p.select("experiment_id", F.try_element_at("domains", place + 1).alias("domain"), which.alias("name"), "value")
