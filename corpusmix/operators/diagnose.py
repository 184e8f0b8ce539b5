"""Distributions, shares, shapes and correlations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmix.operators.order import quantiles
from corpusmix.schema import DOMAIN_NAMES


def domains(spark) -> DataFrame:
    return spark.createDataFrame(list(enumerate(DOMAIN_NAMES)), "domain long, name string")


def domain_histogram(df: DataFrame) -> DataFrame:
    """domain, name, records of all domains, 0 where there are none; other domains aren't counted."""
    n = df.groupBy("domain").agg(F.count(F.lit(1)).alias("records"))
    return domains(df.sparkSession).join(n, "domain", "left").select("domain", "name", F.coalesce("records", F.lit(0)).alias("records"))


def domain_stats(df: DataFrame) -> DataFrame:
    """Records, chars, tokens, tokens for each record and percent of the records, by domain."""
    a = df.groupBy("domain").agg(F.count(F.lit(1)).alias("records"), F.sum("chars").alias("chars"), F.sum("tokens").alias("tokens"))
    every = Window.partitionBy()  # over one row for each domain
    return a.select("*", F.round(F.col("tokens") / F.col("records"), 9).alias("tokens_each"), F.round(100 * F.col("records") / F.sum("records").over(every), 9).alias("percent"))


def concentration(df: DataFrame) -> DataFrame:
    """Percents of the largest and smallest domains, domains above 0.1 %, max/min, Herfindahl index (percent² / 100)."""
    a = df.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()
    r = a.select("n", F.row_number().over(Window.orderBy(F.desc("n"), "domain")).alias("down"), F.row_number().over(Window.orderBy("n", "domain")).alias("up"), (100.0 * F.col("n") / F.sum("n").over(every)).alias("p"))
    share = lambda c: F.round(F.sum(F.when(c, F.col("p"))), 6)
    return r.agg(
        share(F.col("down") <= 3).alias("top3"), share(F.col("down") <= 5).alias("top5"), share(F.col("down") <= 10).alias("top10"), share(F.col("up") <= 5).alias("bottom5"),
        F.count(F.when(F.col("p") > 0.1, 1)).alias("above_tenth"), F.round(F.max("n") / F.min("n"), 6).alias("max_min"), F.round(F.sum(F.col("p") * F.col("p")) / 100, 6).alias("hhi"),
    )


def length_thresholds(df: DataFrame, length: str, thresholds: list[int]) -> DataFrame:
    """What each limit on length keeps, and the tokens of what it drops. One pass whatever the number of limits."""
    n = F.col(length)
    parts = [x for t in thresholds for x in (F.count(F.when(n <= t, 1)).alias(f"_k{t}"), F.sum(F.when(n > t, F.floor(n / 4)).otherwise(0)).cast("long").alias(f"_l{t}"))]
    a = df.agg(F.count(F.lit(1)).alias("_n"), *parts)
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"_k{t}").alias("kept"), F.round(F.col(f"_k{t}") / F.col("_n"), 9).alias("kept_share"), F.col(f"_l{t}").alias("tokens_lost")) for t in thresholds]))
    return a.where("_n > 0").select(rows.alias("r")).select("r.*")


def basic(df: DataFrame, by: str = "criterion", x: str = "x") -> DataFrame:
    """n, min, max, mean, population deviation, median and interquartile range."""
    a = df.groupBy(by).agg(F.count(x).alias("n"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"))
    a = a.join(quantiles(df, by, x, _lo=0.25, median=0.5, _hi=0.75), by)
    return a.select(by, "n", "min", "max", "mean", "std", "median", (F.col("_hi") - F.col("_lo")).alias("iqr"))


def percentiles(df: DataFrame, by: str = "criterion", x: str = "x", at: tuple[int, ...] = (5, 25, 50, 75, 95)) -> DataFrame:
    """Exact, with linear interpolation."""
    return quantiles(df, by, x, **{f"p{p}": p / 100 for p in at})


def shape(df: DataFrame, by: str = "criterion", x: str = "x") -> DataFrame:
    """Population skewness, excess kurtosis, shares of zeros and of values near 0, and a label."""
    c = F.col(x)
    a = df.groupBy(by).agg(F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurtosis"), F.avg((c == 0).cast("int")).alias("zero"), F.avg((F.abs(c) < 0.01).cast("int")).alias("near_zero"))
    label = F.when(F.abs("skew") < 0.5, "symmetric").when(F.col("skew") >= 2, "heavy right").when(F.col("skew") > 0, "right").when(F.col("skew") <= -2, "heavy left").otherwise("left")
    return a.withColumn("label", label)


def buckets(df: DataFrame, by: str = "criterion", x: str = "x") -> DataFrame:
    """Shares of values below 0.01, 0.1, 0.5, up to 1 and above."""
    c = F.col(x)
    return df.groupBy(by).agg(*[F.avg(p.cast("int")).alias(n) for n, p in (("under_001", c < 0.01), ("under_01", (c >= 0.01) & (c < 0.1)), ("under_05", (c >= 0.1) & (c < 0.5)), ("up_to_1", (c >= 0.5) & (c <= 1)), ("above_1", c > 1))])


def discrimination(df: DataFrame, by: str = "criterion", x: str = "x") -> DataFrame:
    """Means of the top and bottom tenth, their ratio and spread, and a verdict."""
    p = quantiles(df, by, x, _lo=0.1, _hi=0.9)
    a = df.join(F.broadcast(p), by).groupBy(by).agg(F.avg(F.when(F.col(x) >= F.col("_hi"), F.col(x))).alias("top"), F.avg(F.when(F.col(x) <= F.col("_lo"), F.col(x))).alias("bottom"))
    ratio = F.when(F.abs("bottom") > 1e-10, F.col("top") / F.col("bottom"))
    a = a.withColumn("ratio", ratio).withColumn("spread", F.col("top") - F.col("bottom"))
    return a.withColumn("verdict", F.when(F.col("ratio").isNull() | (F.col("ratio") > 10), "strong").when(F.col("ratio") > 3, "medium").otherwise("weak"))


def outliers(df: DataFrame, by: str = "criterion", x: str = "x") -> DataFrame:
    """Values off the mean by more than three population deviations, and zeros."""
    s = df.groupBy(by).agg(F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s"))
    far = F.abs(F.col(x) - F.col("_m")) > 3 * F.col("_s")
    return df.join(F.broadcast(s), by).groupBy(by).agg(F.count(F.when(far, 1)).alias("outliers"), F.count(F.when(F.col(x) == 0, 1)).alias("zeros"))


def correlations(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Pearson's correlation of every two columns, in one pass. a, b, r; null where a column is constant."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.nanvl(F.col(f"`{a}|{b}`"), F.lit(None).cast("double")).alias("r")) for a, b in pairs]))
    return one.select(rows.alias("p")).select("p.*")


def histogram(df: DataFrame, by: list[str], x: str = "x", bins: int = 50) -> DataFrame:
    """Counts over [0, 1] in bins of equal width, the last one closed; values outside aren't counted."""
    inside = df.where((F.col(x) >= 0) & (F.col(x) <= 1))
    return inside.groupBy(*by, F.least(F.floor(F.col(x) * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def histogram_means(h: DataFrame, by: list[str], bins: int = 50) -> DataFrame:
    """Means from a histogram, with the middle of each bin for its values."""
    return h.groupBy(*by).agg((F.sum((F.col("bin") + 0.5) / bins * F.col("n")) / F.sum("n")).alias("mean"))
