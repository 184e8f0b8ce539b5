"""Normalisers of scores, over a long table of (criterion, x).

Each takes a DataFrame and adds sigma. Statistics of a criterion are a row each and are joined back;
ranks are found among the distinct values, which are counted, range-sorted and numbered, so no
criterion is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmix.operators.order import number_rows, quantiles

TINY = 1e-10


def _with(df: DataFrame, by: str, **stats: Column) -> DataFrame:
    """df with statistics of its group; one row for each criterion is broadcast."""
    return df.join(F.broadcast(df.groupBy(by).agg(*[c.alias(n) for n, c in stats.items()])), by)


def _ranks(df: DataFrame, by: str, x: str) -> DataFrame:
    """by, x, _n (rows of that value), _below (rows of lower values) and _all, for the distinct values."""
    counts = df.groupBy(by, x).agg(F.count(F.lit(1)).alias("_n"))
    ranked = number_rows(counts, [by], [x], "_n", "_rank", "_below")
    total = df.groupBy(by).agg(F.count(F.lit(1)).alias("_all"))
    return ranked.join(F.broadcast(total), by).drop("_rank")


def _rejoin(df: DataFrame, found: DataFrame, by: str, x: str) -> DataFrame:
    """df with found's sigma (by, x, _n, _all, sigma: a row for each distinct value).

    A value that more than a thousandth of its group's rows have is one of a thousand at most: those
    are broadcast, and their rows are dealt out, so no task gets all rows of one value.
    """
    hot = F.col("_n") * 1000 > F.col("_all")
    few = found.where(hot).select(by, x, F.col("sigma").alias("_hot"))
    rest = found.where(~hot).select(by, x, F.lit(0).alias("_deal"), F.col("sigma").alias("_rest"))
    j = df.join(F.broadcast(few), [by, x], "left")
    dealt = F.when(F.col("_hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*df.columns), F.lit(64)))
    j = j.withColumn("_deal", dealt.cast("int")).join(rest, [by, x, "_deal"], "left")
    return j.select(*df.columns, F.coalesce("_hot", "_rest").alias("sigma")).where(F.col(by).isNotNull() & F.col(x).isNotNull())


def rank(df: DataFrame, by: str = "criterion", x: str = "x") -> DataFrame:
    """(average rank - 1) / N, ranks from 1, ties share their average."""
    r = _ranks(df, by, x).withColumn("sigma", (F.col("_below") + (F.col("_n") - 1) / 2) / F.col("_all"))
    return _rejoin(df, r, by, x)


def zscore(df: DataFrame, by: str = "criterion", x: str = "x") -> DataFrame:
    """(x - mean) / population deviation; 0 for a deviation of about 0."""
    s = _with(df, by, _m=F.avg(x), _s=F.stddev_pop(x))
    return s.withColumn("sigma", F.when(F.col("_s") < TINY, 0.0).otherwise(F.try_divide(F.col(x) - F.col("_m"), F.col("_s")))).drop("_m", "_s")


def minmax(df: DataFrame, by: str = "criterion", x: str = "x") -> DataFrame:
    """(x - min) / (max - min); 0 for a range of about 0."""
    s = _with(df, by, _a=F.min(x), _b=F.max(x))
    return s.withColumn("sigma", F.when(F.col("_b") - F.col("_a") < TINY, 0.0).otherwise(F.try_divide(F.col(x) - F.col("_a"), F.col("_b") - F.col("_a")))).drop("_a", "_b")


def log1p_z(df: DataFrame, by: str = "criterion", x: str = "x") -> DataFrame:
    """zscore of log(1 + x - min)."""
    s = _with(df, by, _a=F.min(x)).withColumn("_y", F.log1p(F.col(x) - F.col("_a"))).drop("_a")
    return zscore(s, by, "_y").drop("_y")


def threshold_rank(df: DataFrame, by: str = "criterion", x: str = "x") -> DataFrame:
    """Where the skewness is above 4: 0 up to the third quartile, the rank among the rest above it.

    The plain rank where the skewness is 4 or less, or where fewer than 10 or a tenth of all rows
    (rounded down) lie above.
    """
    stats = df.groupBy(by).agg(F.skewness(x).alias("_skew"), F.count(F.lit(1)).alias("_all")).join(quantiles(df, by, x, _q=0.75), by)
    above = df.join(F.broadcast(stats), by).groupBy(by).agg(F.count(F.when(F.col(x) > F.col("_q"), 1)).alias("_signal"))
    s = stats.join(F.broadcast(above), by)
    split = (F.col("_skew") > 4) & (F.col("_signal") >= F.greatest(F.lit(10), F.floor(F.col("_all") / 10)))
    s = s.select(by, "_q", "_signal", split.alias("_split"))
    r = _ranks(df, by, x).join(F.broadcast(s), by)
    mid = F.col("_below") + (F.col("_n") - 1) / 2
    among = F.when(F.col(x) > F.col("_q"), (mid - (F.col("_all") - F.col("_signal"))) / F.col("_signal")).otherwise(0.0)
    return _rejoin(df, r.withColumn("sigma", F.when(F.col("_split"), among).otherwise(mid / F.col("_all"))), by, x)


def robust_z(df: DataFrame, by: str = "criterion", x: str = "x") -> DataFrame:
    """(x - median) / (1.4826 median absolute deviation); 0 for a deviation of about 0."""
    s = df.join(F.broadcast(quantiles(df, by, x, _m=0.5)), by).withColumn("_d", F.abs(F.col(x) - F.col("_m")))
    s = s.join(F.broadcast(quantiles(s, by, "_d", _mad=0.5)), by)
    return s.withColumn("sigma", F.when(F.col("_mad") < TINY, 0.0).otherwise((F.col(x) - F.col("_m")) / (F.col("_mad") * 1.4826))).drop("_m", "_d", "_mad")


def quantile(df: DataFrame, by: str = "criterion", x: str = "x", key: str = "row_id") -> DataFrame:
    """Place / (N - 1), ties in the order of key; 0 for a single row."""
    n = df.groupBy(by).agg(F.count(F.lit(1)).alias("_all"))
    r = number_rows(df, [by], [x, key], rank="_r").join(F.broadcast(n), by)
    return r.withColumn("sigma", F.when(F.col("_all") > 1, F.col("_r") / (F.col("_all") - 1)).otherwise(0.0)).drop("_r", "_all")


def ordinal(df: DataFrame, by: str = "criterion", x: str = "x", key: str = "row_id") -> DataFrame:
    """Place / N, ties in the order of key."""
    n = df.groupBy(by).agg(F.count(F.lit(1)).alias("_all"))
    r = number_rows(df, [by], [x, key], rank="_r").join(F.broadcast(n), by)
    return r.withColumn("sigma", F.col("_r") / F.col("_all")).drop("_r", "_all")


def clip_z(df: DataFrame, by: str = "criterion", x: str = "x") -> DataFrame:
    """zscore, within -3 and 3."""
    return zscore(df, by, x).withColumn("sigma", F.greatest(F.lit(-3.0), F.least(F.lit(3.0), F.col("sigma"))))


def sigmoid_iqr(df: DataFrame, by: str = "criterion", x: str = "x") -> DataFrame:
    """1 / (1 + e^-t), t = (x - median) / interquartile range within -10 and 10; 0.5 for a range of about 0."""
    s = df.join(F.broadcast(quantiles(df, by, x, _lo=0.25, _mid=0.5, _hi=0.75)), by)
    iqr = F.col("_hi") - F.col("_lo")
    t = F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.try_divide(F.col(x) - F.col("_mid"), iqr)))
    return s.withColumn("sigma", F.when(iqr < TINY, 0.5).otherwise(1 / (1 + F.exp(-t)))).drop("_lo", "_mid", "_hi")


def hybrid(df: DataFrame, by: str = "criterion", x: str = "x", skew: float = 1.5) -> DataFrame:
    """zscore where the absolute skewness is above skew, else rank."""
    s = df.groupBy(by).agg(F.skewness(x).alias("_skew"), F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s"))
    r = _ranks(df, by, x).join(F.broadcast(s), by)
    z = F.when(F.col("_s") < TINY, 0.0).otherwise(F.try_divide(F.col(x) - F.col("_m"), F.col("_s")))
    return _rejoin(df, r.withColumn("sigma", F.when(F.abs("_skew") > skew, z).otherwise((F.col("_below") + (F.col("_n") - 1) / 2) / F.col("_all"))), by, x)


NORMALIZERS: dict[str, Callable[..., DataFrame]] = {
    "rank": rank, "zscore": zscore, "minmax": minmax, "log1p_z": log1p_z, "threshold_rank": threshold_rank, "robust_z": robust_z,
    "quantile": quantile, "ordinal": ordinal, "clip_z": clip_z, "sigmoid_iqr": sigmoid_iqr, "hybrid": hybrid,
}


def normalizer(name: str) -> Callable[..., DataFrame]:
    if name not in NORMALIZERS:
        raise ValueError(f"no normaliser {name}; known: {', '.join(NORMALIZERS)}")
    return NORMALIZERS[name]
