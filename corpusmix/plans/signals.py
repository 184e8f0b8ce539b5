"""Queries on the quality signals and their normalisers."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmix.operators import diagnose, normalize
from corpusmix.plans.base import LONG, POOL, Q, long, pool

QUERIES: dict = {}
SQL: dict[str, str] = {}
HEAD = f"WITH {POOL}, {LONG}"
STATS = "st AS (SELECT criterion, avg(x) AS m, stddev_pop(x) AS s, min(x) AS a, max(x) AS b, count(*) AS n, quantile_cont(x, 0.25) AS q1, median(x) AS q2, quantile_cont(x, 0.75) AS q3 FROM long GROUP BY 1), sk AS (SELECT criterion, CASE WHEN any_value(s) > 0 THEN avg(pow((x - m) / s, 3)) ELSE 0 END AS skew, CASE WHEN any_value(s) > 0 THEN avg(pow((x - m) / s, 4)) - 3 END AS kurt FROM long JOIN st USING (criterion) GROUP BY 1)"
RANKED = "rk AS (SELECT row_id, criterion, x, (rank() OVER (PARTITION BY criterion ORDER BY x) - 1 + (count(*) OVER (PARTITION BY criterion, x) - 1) / 2.0::double) AS mid, row_number() OVER (PARTITION BY criterion ORDER BY x, row_id) - 1 AS nth FROM long)"


def add(name, f, sql=None):
    f.__name__ = name
    QUERIES[name] = f
    if sql:
        SQL[name] = sql


def rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def of_long(f, *keep):
    return lambda spark, d: rounded(f(long(pool(spark, d, ), *keep)))


add("signal_stats", of_long(diagnose.basic), f"{HEAD}, {STATS} SELECT criterion, n, round(a, 6) AS min, round(b, 6) AS max, round(m, 6) AS mean, round(s, 6) AS std, round(q2, 6) AS median, round(q3 - q1, 6) AS iqr FROM st")
add("signal_percentiles", of_long(diagnose.percentiles), f"{HEAD} SELECT criterion, " + ", ".join(f"round(quantile_cont(x, {p / 100}), 6) AS p{p}" for p in (5, 25, 50, 75, 95)) + " FROM long GROUP BY 1")
add("signal_shape", of_long(diagnose.shape), f"""{HEAD}, {STATS}, z AS (SELECT criterion, round(skew, 6) AS skew, round(kurt, 6) AS kurtosis, round(avg((x = 0)::int), 6) AS zero, round(avg((abs(x) < 0.01)::int), 6) AS near_zero FROM long JOIN sk USING (criterion) GROUP BY criterion, skew, kurt)
 SELECT *, CASE WHEN abs(skew) < 0.5 THEN 'symmetric' WHEN skew >= 2 THEN 'heavy right' WHEN skew > 0 THEN 'right' WHEN skew <= -2 THEN 'heavy left' ELSE 'left' END AS label FROM z""")
add("signal_buckets", of_long(diagnose.buckets), f"{HEAD} SELECT criterion, round(avg((x < 0.01)::int), 6) AS under_001, round(avg((x >= 0.01 AND x < 0.1)::int), 6) AS under_01, round(avg((x >= 0.1 AND x < 0.5)::int), 6) AS under_05, round(avg((x >= 0.5 AND x <= 1)::int), 6) AS up_to_1, round(avg((x > 1)::int), 6) AS above_1 FROM long GROUP BY 1")
add("signal_discrimination", of_long(diagnose.discrimination), f"""{HEAD}, p AS (SELECT criterion, quantile_cont(x, 0.1) AS lo, quantile_cont(x, 0.9) AS hi FROM long GROUP BY 1), t AS (SELECT criterion, avg(x) FILTER (x >= hi) AS top, avg(x) FILTER (x <= lo) AS bottom FROM long JOIN p USING (criterion) GROUP BY 1),
 r AS (SELECT *, CASE WHEN abs(bottom) > 1e-10 THEN top / bottom END AS ratio FROM t) SELECT criterion, round(top, 6) AS top, round(bottom, 6) AS bottom, round(ratio, 6) AS ratio, round(top - bottom, 6) AS spread, CASE WHEN ratio IS NULL OR ratio > 10 THEN 'strong' WHEN ratio > 3 THEN 'medium' ELSE 'weak' END AS verdict FROM r""")
add("signal_outliers", of_long(diagnose.outliers), f"{HEAD}, {STATS} SELECT criterion, count(*) FILTER (abs(x - m) > 3 * s) AS outliers, count(*) FILTER (x = 0) AS zeros FROM long JOIN st USING (criterion) GROUP BY 1")
add("signal_correlations", lambda spark, d: rounded(diagnose.correlations(pool(spark, d), Q)), f"WITH {POOL} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM pool" for i, a in enumerate(Q) for b in Q[i + 1 :]))
_BIN = "SELECT {by}, least(floor(x * 50), 49)::int AS bin, count(*) AS n FROM long WHERE x >= 0 AND x <= 1 GROUP BY ALL"
add("signal_histogram", of_long(lambda l: diagnose.histogram(l, ["criterion"])), f"{HEAD} " + _BIN.format(by="criterion"))
add("signal_histogram_by_domain", of_long(lambda l: diagnose.histogram(l, ["domain", "criterion"]), "domain"), f"{HEAD} " + _BIN.format(by="domain, criterion"))
add("signal_means_by_domain", of_long(lambda l: diagnose.histogram_means(diagnose.histogram(l, ["domain", "criterion"]), ["domain", "criterion"]), "domain"), f"{HEAD}, h AS ({_BIN.format(by='domain, criterion')}) SELECT domain, criterion, round(sum((bin + 0.5) / 50 * n) / sum(n), 6) AS mean FROM h GROUP BY ALL")

_Z = "CASE WHEN s < 1e-10 THEN 0 ELSE (x - m) / s END"
_FORMS = {
    "rank": f"{RANKED} SELECT row_id, rk.criterion, mid / n AS sigma FROM rk JOIN st USING (criterion)",
    "zscore": f"z AS (SELECT 1) SELECT row_id, criterion, {_Z} AS sigma FROM long JOIN st USING (criterion)",
    "minmax": "z AS (SELECT 1) SELECT row_id, criterion, CASE WHEN b - a < 1e-10 THEN 0 ELSE (x - a) / (b - a) END AS sigma FROM long JOIN st USING (criterion)",
    "log1p_z": "y AS (SELECT row_id, criterion, ln(1 + x - a) AS y FROM long JOIN st USING (criterion)), w AS (SELECT criterion, avg(y) AS ym, stddev_pop(y) AS ys FROM y GROUP BY 1) SELECT row_id, criterion, CASE WHEN ys < 1e-10 THEN 0 ELSE (y - ym) / ys END AS sigma FROM y JOIN w USING (criterion)",
    "threshold_rank": f"{RANKED}, sg AS (SELECT criterion, count(*) FILTER (x > q3) AS k FROM long JOIN st USING (criterion) GROUP BY 1) SELECT row_id, criterion, CASE WHEN skew > 4 AND k >= greatest(10, n // 10) THEN CASE WHEN x > q3 THEN (mid - (n - k)) / k ELSE 0 END ELSE mid / n END AS sigma FROM rk JOIN st USING (criterion) JOIN sk USING (criterion) JOIN sg USING (criterion)",
    "robust_z": "dv AS (SELECT criterion, median(abs(x - q2)) AS mad FROM long JOIN st USING (criterion) GROUP BY 1) SELECT row_id, criterion, CASE WHEN mad < 1e-10 THEN 0 ELSE (x - q2) / (mad * 1.4826) END AS sigma FROM long JOIN st USING (criterion) JOIN dv USING (criterion)",
    "quantile": f"{RANKED} SELECT row_id, criterion, CASE WHEN n > 1 THEN nth / (n - 1)::double ELSE 0 END AS sigma FROM rk JOIN st USING (criterion)",
    "ordinal": f"{RANKED} SELECT row_id, criterion, nth / n::double AS sigma FROM rk JOIN st USING (criterion)",
    "clip_z": f"z AS (SELECT 1) SELECT row_id, criterion, greatest(-3, least(3, {_Z})) AS sigma FROM long JOIN st USING (criterion)",
    "sigmoid_iqr": "z AS (SELECT 1) SELECT row_id, criterion, CASE WHEN q3 - q1 < 1e-10 THEN 0.5 ELSE 1 / (1 + exp(-greatest(-10, least(10, (x - q2) / (q3 - q1))))) END AS sigma FROM long JOIN st USING (criterion)",
    "hybrid": f"{RANKED} SELECT row_id, criterion, CASE WHEN abs(skew) > 1.5 THEN {_Z} ELSE mid / n END AS sigma FROM rk JOIN st USING (criterion) JOIN sk USING (criterion)",
}


def _normalized(name):
    return lambda spark, d: rounded(normalize.normalizer(name)(long(pool(spark, d), "row_id")).select("row_id", "criterion", "sigma"))


for _n, _sql in _FORMS.items():
    _head, _, _body = _sql.rpartition(" SELECT row_id")
    add(f"norm_{_n}", _normalized(_n), f"{HEAD}, {STATS}, {_head}, o AS (SELECT row_id{_body}) SELECT row_id, criterion, round(sigma, 6) AS sigma FROM o")


def _balance(spark, d):
    """How evenly the normalised criteria vary: each variance as a share of all five."""
    v = normalize.rank(long(pool(spark, d), "row_id")).groupBy("criterion").agg(F.var_pop("sigma").alias("variance"))
    return rounded(v.join(v.agg(F.sum("variance").alias("_all"))).select("criterion", "variance", (F.col("variance") / F.col("_all")).alias("share")))


add("norm_variance_balance", _balance, f"{HEAD}, {STATS}, {RANKED}, v AS (SELECT criterion, var_pop(mid / n) AS variance FROM rk JOIN st USING (criterion) GROUP BY 1) SELECT criterion, round(variance, 6) AS variance, round(variance / sum(variance) OVER (), 6) AS share FROM v")


def _gap(spark, d):
    """The mean rank sigma of the best twentieth less that of the lower half, by criterion."""
    n = normalize.rank(long(pool(spark, d), "row_id"))
    return rounded(n.groupBy("criterion").agg((F.avg(F.when(F.col("sigma") >= 0.95, F.col("x"))) - F.avg(F.when(F.col("sigma") < 0.5, F.col("x")))).alias("gap")))


add("norm_top_gap", _gap, f"{HEAD}, {STATS}, {RANKED} SELECT criterion, round(avg(x) FILTER (mid / n >= 0.95) - avg(x) FILTER (mid / n < 0.5), 6) AS gap FROM rk JOIN st USING (criterion) GROUP BY 1")
