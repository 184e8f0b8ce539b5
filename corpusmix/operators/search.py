"""Losses of experiments: statistics, weights of tasks, quality of predictions, and the search for parameters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmix.functions.rng import uniform
from corpusmix.operators import params
from corpusmix.operators.order import quantiles

#: (selections, parameters) -> experiment_id, task, loss. How losses come about is the caller's.
LossProvider = Callable[[DataFrame, DataFrame], DataFrame]


def finite(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def task_losses(experiments: DataFrame) -> DataFrame:
    """experiment_id, task, loss of the finite losses of experiments whose val_loss is finite."""
    e = experiments.where(finite("val_loss")).select("experiment_id", F.explode("per_task_losses").alias("task", "loss"))
    return e.where(finite("loss"))


def loss_stats(losses: DataFrame) -> DataFrame:
    return losses.groupBy("task").agg(F.count("loss").alias("n"), F.avg("loss").alias("mean"), F.stddev_pop("loss").alias("std"), F.min("loss").alias("min"), F.max("loss").alias("max"))


def masked_means(rows: DataFrame) -> DataFrame:
    """task and the mean over its rows of each row's mean loss where its mask is set; rows without any count as 0.

    rows: task, losses array<double>, mask array<boolean>.
    """
    on = F.transform(F.arrays_zip("losses", "mask"), lambda z: F.when(z["mask"], z["losses"]).otherwise(0.0))
    total = F.aggregate(on, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    count = F.size(F.filter("mask", lambda m: m))
    return rows.select("task", (total / F.greatest(count, F.lit(1))).alias("_m")).groupBy("task").agg(F.avg("_m").alias("loss"), F.count(F.lit(1)).alias("rows"))


def line_fits(losses: DataFrame, by: DataFrame) -> DataFrame:
    """experiment_id, task, loss, pred: each task's losses and a straight line through them over `by` (experiment_id, x)."""
    j = losses.join(by.where(finite("x")), "experiment_id")
    f = j.groupBy("task").agg(F.regr_slope("loss", "x").alias("_b"), F.regr_intercept("loss", "x").alias("_a"))
    return j.join(F.broadcast(f), "task").select("experiment_id", "task", "loss", (F.col("_a") + F.col("_b") * F.col("x")).alias("pred"))


def task_weights(predicted: DataFrame, mode: str = "r2") -> DataFrame:
    """task, r2, sigma, weight. Tasks of a variance up to 1e-8 are left out; weights are max(r2, 0), times
    sigma in mode r2_sigma, over their sum, and equal where that is 0 or mode is equal."""
    d = predicted.groupBy("task").agg(F.avg("loss").alias("_m"), F.var_pop("loss").alias("_v")).where("_v > 1e-8")
    r = predicted.join(F.broadcast(d), "task").groupBy("task").agg((1 - F.sum(F.pow(F.col("loss") - F.col("pred"), 2)) / F.greatest(F.sum(F.pow(F.col("loss") - F.col("_m"), 2)), F.lit(1e-12))).alias("r2"), F.sqrt(F.max("_v")).alias("sigma"))
    raw = F.greatest("r2", F.lit(0.0)) * (F.col("sigma") if mode == "r2_sigma" else F.lit(1.0)) if mode != "equal" else F.lit(1.0)
    r = r.withColumn("_raw", raw)
    w = Window.partitionBy()  # over one row for each task
    total = F.sum("_raw").over(w)
    return r.select("task", "r2", "sigma", F.when(total < 1e-12, 1.0 / F.count(F.lit(1)).over(w)).otherwise(F.col("_raw") / total).alias("weight"))


def combined(predicted: DataFrame, weights: DataFrame) -> DataFrame:
    """experiment_id, actual, pred: weighted sums over tasks of losses as z-scores of the task."""
    s = predicted.groupBy("task").agg(F.avg("loss").alias("_m"), F.stddev_pop("loss").alias("_s")).where("_s > 1e-12")
    j = predicted.join(F.broadcast(s.join(weights, "task")), "task")
    z = lambda c: F.sum(F.col("weight") * (F.col(c) - F.col("_m")) / F.col("_s"))
    return j.groupBy("experiment_id").agg(z("loss").alias("actual"), z("pred").alias("pred"))


def quality(c: DataFrame, k: int = 10) -> DataFrame:
    """One row: r2, mae, spearman, recall of the k lowest, and how far their mean lies below the mean, in deviations.

    c has a row for each experiment.
    """
    every = Window.partitionBy()
    mid = lambda x: F.rank().over(Window.orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(x)) - 1) / 2
    r = c.select(
        "*", F.avg("actual").over(every).alias("_m"), mid("actual").alias("_ra"), mid("pred").alias("_rp"),
        F.row_number().over(Window.orderBy("actual", "experiment_id")).alias("_na"), F.row_number().over(Window.orderBy("pred", "experiment_id")).alias("_np"), F.least(F.lit(k), F.count(F.lit(1)).over(every)).alias("_k"),
    )
    top = F.col("_np") <= F.col("_k")
    return r.agg(
        (1 - F.sum(F.pow(F.col("actual") - F.col("pred"), 2)) / F.greatest(F.sum(F.pow(F.col("actual") - F.col("_m"), 2)), F.lit(1e-12))).alias("r2"),
        F.avg(F.abs(F.col("actual") - F.col("pred"))).alias("mae"), F.corr("_ra", "_rp").alias("spearman"),
        (F.count(F.when(top & (F.col("_na") <= F.col("_k")), 1)) / F.max("_k")).alias("recall"),
        ((F.avg("actual") - F.avg(F.when(top, F.col("actual")))) / F.greatest(F.stddev_pop("actual"), F.lit(1e-12))).alias("lift"),
    )


def best(c: DataFrame, k: int = 10) -> DataFrame:
    """experiment_id of the k of lowest pred, ties by id."""
    return c.orderBy("pred", "experiment_id").limit(k).select("experiment_id")


def mean_theta(theta: DataFrame) -> DataFrame:
    """domain, name, value: the mean parameters of all sets."""
    return params.melt(theta).groupBy("domain", "name").agg(F.avg("value").alias("value"))


def best_theta(c: DataFrame, theta: DataFrame, k: int = 10) -> DataFrame:
    """domain, name, value: the mean parameters of the k experiments of lowest pred, ties by id."""
    return mean_theta(theta.join(F.broadcast(best(c, k)), "experiment_id"))


def variances(losses: DataFrame) -> DataFrame:
    """One row: the mean variance of tasks, the mean covariance of two of them, the variance of experiments'
    mean losses, and the latter over the first. Experiments that lack a task are left out.

    The covariances come from the variance of the sum, so no task is joined with another.
    """
    tasks = losses.select("task").distinct().count()
    whole = losses.groupBy("experiment_id").agg(F.sum("loss").alias("_s"), F.count("loss").alias("_n")).where(F.col("_n") == tasks)
    inside = losses.join(whole.select("experiment_id"), "experiment_id", "left_semi")
    v = inside.groupBy("task").agg(F.var_samp("loss").alias("_v")).agg(F.avg("_v").alias("mean_variance"), F.sum("_v").alias("_sum"))
    t = whole.agg(F.var_samp("_s").alias("_vs"))
    cov = (F.col("_vs") - F.col("_sum")) / (tasks * (tasks - 1)) if tasks > 1 else F.lit(None).cast("double")
    return v.crossJoin(t).select("mean_variance", cov.alias("mean_covariance"), (F.col("_vs") / tasks**2).alias("variance_of_mean"), (F.col("_vs") / tasks**2 / F.col("mean_variance")).alias("compression"))


def resampled(experiments: DataFrame, rounds: int, seed: int = 42) -> DataFrame:
    """draw and experiment_id: as many draws as experiments, with replacement, for each round. experiments: one row each."""
    w = Window.orderBy("experiment_id")  # over one row for each experiment
    e = experiments.select("experiment_id", (F.row_number().over(w) - 1).alias("_i"), F.count(F.lit(1)).over(Window.partitionBy()).alias("_n"))
    draws = e.select("_i", "_n", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("draw"))
    draws = draws.select("draw", F.floor(uniform(seed, "draw", F.col("_i")) * F.col("_n")).cast("int").alias("_i"))
    return draws.join(e.select("_i", "experiment_id"), "_i").select("draw", "experiment_id")


def folds(experiments: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """experiment_id and fold, 0 to k - 1, of nearly equal sizes, at random by hash."""
    w = Window.orderBy(uniform(seed, "experiment_id"), "experiment_id")  # over one row for each experiment
    return experiments.select("experiment_id", (F.ntile(k).over(w) - 1).alias("fold"))


def interval(r2: DataFrame) -> DataFrame:
    """One row: mean, deviation and the central 95 % of r2 over draws."""
    one = r2.where(finite("r2")).withColumn("_g", F.lit(0))
    q = quantiles(one, "_g", "r2", low=0.025, high=0.975)
    return one.groupBy("_g").agg(F.count(F.lit(1)).alias("draws"), F.avg("r2").alias("mean"), F.stddev_pop("r2").alias("std")).join(q, "_g").drop("_g")


def ridge(x: np.ndarray, y: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Weights, means and deviations of the columns, and the mean of y."""
    m, s = x.mean(0), x.std(0)
    s[s < 1e-12] = 1.0
    z = (x - m) / s
    w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean()))
    return w, m, s, float(y.mean())


def bootstrap_rounds(n: int) -> int:
    """Draws for n experiments; none for fewer than 10."""
    return 0 if n < 10 else 100 if n < 50 else 200 if n < 200 else 300 if n < 500 else 500


def out_of_bag(losses: DataFrame, flat: DataFrame, rounds: int, alpha: float = 1.0, seed: int = 42) -> DataFrame:
    """draw, r2: ridge regression of the loss (experiment_id, loss) on the flat parameters, fitted on the experiments drawn
    and judged by those that weren't. A draw of fewer than 10 experiments or half as many as there are parameters, or
    that leaves fewer than 5, has none. The vectors, one for each experiment, are broadcast."""
    j = losses.join(flat.select("experiment_id", "theta"), "experiment_id")
    rows = sorted(tuple(r) for r in j.select("experiment_id", "loss", "theta").collect())
    place = {r[0]: k for k, r in enumerate(rows)}
    shared = j.sparkSession.sparkContext.broadcast((place, np.array([r[2] for r in rows]), np.array([r[1] for r in rows])))

    def judge(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, x, y = shared.value
        for p in it:
            out = []
            for draw, ids in zip(p["draw"], p["ids"]):
                bag = np.array(sorted(place[i] for i in ids))
                rest = np.setdiff1d(np.arange(len(y)), bag)
                if len(y) - len(rest) >= max(10, x.shape[1] // 2) and len(rest) >= 5:
                    w, m, s, b = ridge(x[bag], y[bag], alpha)
                    off = y[rest] - ((x[rest] - m) / s @ w + b)
                    out.append((draw, 1 - float(off @ off) / max(float(((y[rest] - y[rest].mean()) ** 2).sum()), 1e-12)))
            yield pd.DataFrame(out, columns=["draw", "r2"]).astype({"draw": "int32", "r2": "float64"})

    bags = resampled(j, rounds, seed).groupBy("draw").agg(F.collect_list("experiment_id").alias("ids"))  # a number for each experiment
    return bags.mapInPandas(judge, "draw int, r2 double")


def reliability(losses: DataFrame, flat: DataFrame) -> DataFrame:
    """One row: mean, deviation and the central 95 % of r2 out of the bag, the latter two from 50 draws up; no row below 10."""
    rounds = bootstrap_rounds(losses.count())
    r = interval(out_of_bag(losses, flat, rounds) if rounds else losses.select(F.lit(None).cast("double").alias("r2")))
    many = lambda c: F.when(F.col("draws") >= 50, F.col(c)).alias(c)
    return r.where("draws >= 10").select("draws", "mean", many("std"), many("low"), many("high"))


def fit_tasks(losses: DataFrame, flat: DataFrame, fold: DataFrame, alpha: float = 1.0) -> DataFrame:
    """task, experiment_id, loss, pred: ridge regression of each task on the flat parameters, each experiment
    predicted by the fit on the other folds. A task has a row for each experiment, which is what one fit needs.
    flat: vectors over the same domains (params.filled)."""
    j = losses.join(flat.select("experiment_id", "theta"), "experiment_id").join(fold, "experiment_id")

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        x, y = np.array(g["theta"].tolist()), g["loss"].to_numpy()
        pred = np.full(len(g), y.mean())
        for f in g["fold"].unique():
            out = (g["fold"] == f).to_numpy()
            if (~out).sum() >= 2:
                w, m, s, b = ridge(x[~out], y[~out], alpha)
                pred[out] = (x[out] - m) / s @ w + b
        return pd.DataFrame({"task": g["task"], "experiment_id": g["experiment_id"], "loss": y, "pred": pred})

    return j.select("task", "experiment_id", "loss", "theta", "fold").groupBy("task").applyInPandas(fit, "task string, experiment_id bigint, loss double, pred double")


def search(losses: DataFrame, flat: DataFrame, weights: DataFrame, candidates: DataFrame, alpha: float = 1.0) -> DataFrame:
    """experiment_id, pred of candidates (experiment_id, theta): the weighted mean of the tasks' z-scores, as
    ridge fits on all experiments predict it. The fits, a vector for each task, are broadcast. flat and
    candidates: vectors over the same domains (params.filled)."""
    rows = losses.join(weights.where("weight > 0"), "task").join(flat.select("experiment_id", "theta"), "experiment_id")

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        y = g["loss"].to_numpy()
        w, m, s, _ = ridge(np.array(g["theta"].tolist()), (y - y.mean()) / max(y.std(), 1e-12), alpha)
        return pd.DataFrame({"weight": [g["weight"].iloc[0]], "w": [(w / s).tolist()], "b": [float(-(m / s) @ w)]})

    models = [(r["weight"], np.array(r["w"]), r["b"]) for r in rows.groupBy("task").applyInPandas(fit, "weight double, w array<double>, b double").collect()]

    def predict(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            x = np.array(p["theta"].tolist())
            y = sum((k * (x @ w + b) for k, w, b in models if len(p)), np.zeros(len(p)))
            yield pd.DataFrame({"experiment_id": p["experiment_id"], "pred": y})

    return candidates.select("experiment_id", "theta").mapInPandas(predict, "experiment_id bigint, pred double")
