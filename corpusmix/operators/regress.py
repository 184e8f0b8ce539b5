"""Regressions of losses on parameters with Spark's own learners."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmix.shared import materialize


def learner(kind: str, rows: int, features: int, seed: int = 42):
    """gbt, forest or ridge; trees are the smaller and fewer, the fewer rows there are for each feature."""
    few, some = rows < 3 * features, rows < 8 * features
    depth = 2 if few else 3 if some else 5
    common = {"featuresCol": "features", "labelCol": "loss", "predictionCol": "pred"}
    if kind == "gbt":
        return GBTRegressor(maxDepth=depth, maxIter=20 if few else 40, stepSize=0.1, subsamplingRate=0.8, seed=seed, **common)
    if kind == "forest":
        return RandomForestRegressor(maxDepth=depth + 2, numTrees=40, seed=seed, **common)
    if kind == "ridge":
        return LinearRegression(regParam=1.0 if few else 0.1, elasticNetParam=0.0, **common)
    raise ValueError("kind is gbt, forest or ridge")


def vectors(flat: DataFrame, losses: DataFrame) -> DataFrame:
    """experiment_id, loss, features of all experiments. flat: vectors over the same domains (params.filled); ValueError
    for vectors of several lengths, none of which may be left out."""
    j = flat.join(losses, "experiment_id")
    least, most = j.agg(F.min(F.size("theta")), F.max(F.size("theta"))).first()
    if least != most:
        raise ValueError(f"vectors of {least} to {most} parameters: fill them first")
    return j.select("experiment_id", F.col("loss").cast("double"), array_to_vector("theta").alias("features"))


def r2(predicted: DataFrame) -> DataFrame:
    """One row: n, r2 and mae."""
    m = predicted.agg(F.avg("loss").alias("_m"))
    p = predicted.crossJoin(m)  # a row
    return p.agg(F.count(F.lit(1)).alias("n"), (1 - F.sum((F.col("loss") - F.col("pred")) ** 2) / F.greatest(F.sum((F.col("loss") - F.col("_m")) ** 2), F.lit(1e-12))).alias("r2"), F.avg(F.abs(F.col("loss") - F.col("pred"))).alias("mae"))


def scores(data: DataFrame, held: DataFrame, kinds: tuple[str, ...] = ("gbt", "forest", "ridge")) -> DataFrame:
    """kind, part (train or val), n, r2, mae. held: experiment_id of those kept out of training."""
    data = materialize(data, "vectors")
    val, train = data.join(held, "experiment_id", "left_semi"), data.join(held, "experiment_id", "left_anti")
    n, width = train.count(), len(train.first()["features"])
    out = None
    for k in kinds:
        model = learner(k, n, width).fit(train)
        for part, d in (("train", train), ("val", val)):
            r = r2(model.transform(d)).select(F.lit(k).alias("kind"), F.lit(part).alias("part"), "n", "r2", "mae")
            out = r if out is None else out.unionByName(r)
    return out


def importances(data: DataFrame, names: list[str], kind: str = "forest") -> DataFrame:
    """name and importance, by trees, of each place of the parameters."""
    n, width = data.count(), len(data.first()["features"])
    found = learner(kind, n, width).fit(data).featureImportances.toArray().tolist()
    return data.sparkSession.createDataFrame([(names[i] if i < len(names) else str(i), float(x)) for i, x in enumerate(found)], "name string, importance double")


def least_squares(data: DataFrame) -> DataFrame:
    """One row: n, features, r2 and adjusted r2 of ordinary least squares."""
    m = LinearRegression(featuresCol="features", labelCol="loss", predictionCol="pred", regParam=1e-9, solver="normal").fit(data)
    n, p = data.count(), len(data.first()["features"])
    r = m.summary.r2
    return data.sparkSession.createDataFrame([(n, p, float(r), float(1 - (1 - r) * (n - 1) / (n - p - 1)) if n > p + 1 else None)], "n long, features int, r2 double, adjusted double")


def components(rows: DataFrame, columns: list[str], k: int = 3) -> DataFrame:
    """component, share of the variance, and a loading for each column; nothing for fewer than two rows."""
    spark = rows.sparkSession
    if len(rows.take(2)) < 2:
        return spark.createDataFrame([], "component int, share double, name string, loading double")
    v = rows.select(array_to_vector(F.array(*[F.col(c).cast("double") for c in columns])).alias("features"))
    m = PCA(k=k, inputCol="features", outputCol="_p").fit(v)
    load, share = m.pc.toArray(), m.explainedVariance.toArray()
    return spark.createDataFrame([(i, float(share[i]), c, float(load[j][i])) for i in range(k) for j, c in enumerate(columns)], "component int, share double, name string, loading double")


