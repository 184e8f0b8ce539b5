"""Queries on merged scores, ranks, sampling and budgets, for one set of parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmix.functions.rng import uniform, uniform_sql
from corpusmix.operators import select
from corpusmix.plans.base import LONG, POOL, Q, long, pool, table
from corpusmix.plans.signals import RANKED, STATS, rounded
from corpusmix.sources.writers import shards

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def theta(spark: SparkSession) -> DataFrame:
    """A fixed set of parameters: weights that grow a little with the domain, one curve for all."""
    d = spark.range(22).withColumnRenamed("id", "domain")
    a = [(F.lit(x) + F.lit(0.001) * F.col("domain")).alias(f"a{i}") for i, x in enumerate((0.3, 0.25, 0.2, 0.15, 0.1))]
    return d.select("domain", *a, F.lit(300.0).alias("lambda"), F.lit(0.1).alias("omega"), F.lit(0.6).alias("eta"), F.lit(0.05).alias("epsilon"))


def scored(spark: SparkSession, d: str, normalizer: str = "rank") -> DataFrame:
    p = pool(spark, d)
    return select.normalized(p, long(p, "row_id"), normalizer)


def merged(spark: SparkSession, d: str) -> DataFrame:
    return select.merge(scored(spark, d), theta(spark))


def chosen(spark: SparkSession, d: str) -> DataFrame:
    return select.select(select.rank_range(merged(spark, d)))


SCORED = f"WITH {POOL}, {LONG}, {STATS}, {RANKED}, sg AS (SELECT row_id, criterion, mid / n AS sigma FROM rk JOIN st USING (criterion)), scored AS (SELECT p.row_id, p.domain, p.tokens, " + ", ".join(
    f"max(sigma) FILTER (criterion = {i}) AS s{i}" for i in range(5)
) + " FROM pool p JOIN sg USING (row_id) GROUP BY ALL)"
_THETA = "theta AS (SELECT domain::bigint AS domain, " + ", ".join(f"{x}::double + 0.001::double * domain AS a{i}" for i, x in enumerate((0.3, 0.25, 0.2, 0.15, 0.1))) + ", 300.0::double AS lam, 0.1::double AS omega, 0.6::double AS eta, 0.05::double AS epsilon FROM range(22) t(domain))"
MERGE = "round(" + " + ".join(f"s{i} * a{i}" for i in range(5)) + ", 12) AS merged"
MERGED = f"{SCORED}, {_THETA}, merged AS (SELECT row_id, domain, tokens, lam, omega, eta, epsilon, {MERGE} FROM scored JOIN theta USING (domain))"
RANGE = "ranked AS (SELECT *, round(sum(tokens) OVER (PARTITION BY domain ORDER BY merged DESC RANGE UNBOUNDED PRECEDING) / sum(tokens) OVER (PARTITION BY domain)::double, 12) AS rank FROM merged)"
VALUE = "round(CASE WHEN rank <= omega THEN pow(2.0 / (1.0 + exp(greatest(-100, least(100, -lam * (omega - rank))))), eta) + epsilon ELSE epsilon END, 12) AS value"
CHOSEN = f"{MERGED}, {RANGE}, valued AS (SELECT *, {VALUE} FROM ranked), chosen AS (SELECT *, (floor(value) + ({uniform_sql(42, 'row_id')} < value - floor(value))::int)::int AS copies FROM valued), kept AS (SELECT * FROM chosen WHERE copies > 0)"
COPIES = "each AS (SELECT *, unnest(range(copies))::int AS copy FROM kept)"


@query(f"{MERGED} SELECT row_id, domain, round(merged, 6) AS merged FROM merged")
def merged_score(spark, d):
    return rounded(merged(spark, d).select("row_id", "domain", "merged"))


@query(f"{MERGED} SELECT row_id, round(sum(tokens) OVER (PARTITION BY domain ORDER BY merged DESC, row_id ROWS UNBOUNDED PRECEDING) / sum(tokens) OVER (PARTITION BY domain)::double, 6) AS rank FROM merged")
def quality_rank_rows(spark, d):
    return rounded(select.rank_rows(merged(spark, d)).select("row_id", "rank"))


@query(f"{MERGED}, {RANGE} SELECT row_id, round(rank, 6) AS rank FROM ranked")
def quality_rank_range(spark, d):
    return rounded(select.rank_range(merged(spark, d)).select("row_id", "rank"))


#: Rows of a domain that quality_rank_subset's coarse ranks rest on.
FEW = 50


def _subset_sql(size):
    return f"{MERGED}, rf AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY domain ORDER BY {uniform_sql(1729, 'row_id')}, row_id) <= {size} THEN tokens ELSE 0 END AS w FROM merged) SELECT row_id, round(round(sum(w) OVER (PARTITION BY domain ORDER BY merged DESC RANGE UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY domain)::double, 12), 6) AS rank FROM rf"


def _subset(spark, d, size):
    return rounded(select.rank_subset(merged(spark, d), size).select("row_id", "rank"))


@query(_subset_sql(select.REFERENCE))
def quality_rank_reference(spark, d):
    """Ranks among as many rows as the reference takes."""
    return _subset(spark, d, select.REFERENCE)


@query(_subset_sql(FEW))
def quality_rank_subset(spark, d):
    """Coarse ranks, among 50 rows of each domain; quality_rank_reference takes 10,000."""
    return _subset(spark, d, FEW)


@query(f"{MERGED}, {RANGE} SELECT row_id, {VALUE.replace(', 12) AS', ', 6) AS')} FROM ranked")
def sampling_values(spark, d):
    return rounded(select.rank_range(merged(spark, d)).select("row_id", select.sampling_value().alias("value")))


@query(f"{CHOSEN} SELECT row_id, copies, round(1 / greatest(value, 1e-10), 6) AS weight FROM kept")
def sampled_copies(spark, d):
    return rounded(chosen(spark, d).select("row_id", "copies", "weight"))


@query(f"{CHOSEN}, {COPIES} SELECT row_id, copy, md5(u.text) AS text_md5, e.domain, round(rank, 6) AS quality_rank, round(1 / greatest(value, 1e-10), 6) AS sampling_weight, round(value, 6) AS sampling_value FROM each e JOIN unified_data u USING (row_id)")
def sampled_dataset(spark, d):
    """Texts are joined only to what was selected."""
    rows = select.repeat(chosen(spark, d)).select("row_id", "copy", "domain", F.col("rank").alias("quality_rank"), F.col("weight").alias("sampling_weight"), F.col("value").alias("sampling_value"))
    texts = table(spark, d, "unified_data").select("row_id", F.md5("text").alias("text_md5"))
    return rounded(rows.join(texts, "row_id"))


@query(f"{CHOSEN}, s AS (SELECT domain, sum(copies)::bigint AS selected FROM kept GROUP BY 1) SELECT domain, count(*) AS original, coalesce(any_value(selected), 0)::bigint AS selected, round(coalesce(any_value(selected), 0) / count(*)::double, 4) AS ratio FROM pool LEFT JOIN s USING (domain) GROUP BY 1")
def domain_change(spark, d):
    return select.domain_change(pool(spark, d), chosen(spark, d))


TARGET = 20000


@query(f"{CHOSEN}, {COPIES}, t AS (SELECT sum(tokens) AS total FROM each) SELECT row_id, copy FROM each, t WHERE total <= {TARGET} OR {uniform_sql(42, 'row_id', 'copy')} < {TARGET}::double / total")
def target_thinning(spark, d):
    return select.thin(select.repeat(chosen(spark, d)), TARGET).select("row_id", "copy")


@query(
    f"WITH {POOL}, {_THETA}, o AS (SELECT min(omega) AS omega_min, max(omega) AS omega_max, avg(omega) AS omega_avg FROM theta), t AS (SELECT sum(tokens)::bigint AS total_tokens FROM pool), e AS (SELECT *, floor(total_tokens * omega_avg)::bigint AS estimated FROM o, t) SELECT round(omega_min, 6) AS omega_min, round(omega_max, 6) AS omega_max, round(omega_avg, 6) AS omega_avg, total_tokens, estimated, CASE WHEN estimated < {TARGET} * 0.8 THEN 'below target' WHEN estimated > {TARGET} * 1.2 THEN 'above target' ELSE 'near target' END AS note FROM e"
)
def predicted_size(spark, d):
    return rounded(select.predicted_size(theta(spark), pool(spark, d), TARGET))


@query(
    f"WITH {POOL}, t AS (SELECT sum(tokens) AS al, count(*) AS n FROM pool), k AS (SELECT row_id, row_number() OVER (ORDER BY {uniform_sql(0, 'row_id')}, row_id) - 1 AS k FROM pool) SELECT row_id FROM k, t WHERE al <= {TARGET} OR k < greatest(100, floor({TARGET}::double / (al / n) * 1.2))"
)
def budget_subsample(spark, d):
    return select.subsample(pool(spark, d), TARGET).select("row_id")


@query(f"WITH {POOL}, k AS (SELECT row_id, round(ln({uniform_sql(42, 'row_id')} + 1e-300) / q2, 9) AS key FROM pool WHERE q2 > 0) SELECT row_id FROM k QUALIFY row_number() OVER (ORDER BY key DESC, row_id) <= 200")
def weighted_sample(spark, d):
    return select.weighted_sample(pool(spark, d), "q2", 200).select("row_id")


_RUN = "SELECT row_id, tokens, {order} AS o, sum(tokens) OVER (ORDER BY {order}, row_id ROWS UNBOUNDED PRECEDING) - tokens AS before FROM pool"
_RANDOM = _RUN.format(order=uniform_sql(7, "row_id"))


def _random(spark, d):
    return select.prefix(pool(spark, d).withColumn("_u", uniform(7, "row_id")), ["_u", "row_id"], 1.1 * TARGET).drop("_u")


@query(f"WITH {POOL}, r AS ({_RANDOM}) SELECT row_id FROM r WHERE before < 1.1 * {TARGET}")
def random_budget(spark, d):
    return _random(spark, d).select("row_id")


@query(f"WITH {POOL}, r AS ({_RUN.format(order='-q0')}) SELECT row_id FROM r WHERE before < 1.1 * {TARGET}")
def topk_budget(spark, d):
    return select.prefix(pool(spark, d), [F.desc("q0"), "row_id"], 1.1 * TARGET).select("row_id")


@query(f"WITH {POOL}, r AS ({_RANDOM}), k AS (SELECT row_id, tokens, before FROM r WHERE before < 1.1 * {TARGET}) SELECT row_id FROM k WHERE before + tokens <= {TARGET}")
def budget_trim(spark, d):
    return select.prefix(_random(spark, d).withColumn("_u", uniform(7, "row_id")), ["_u", "row_id"], TARGET, closed=True).select("row_id")


_METHODS = ("random", "dclm", "fineweb_edu_approx", "english")


@query(
    f"WITH {POOL}, m AS ("
    + " UNION ALL ".join(f"SELECT '{m}' AS method, row_id FROM ({_RUN.format(order=uniform_sql(7, 'row_id') if m == 'random' else f'-q{i - 1}')}) WHERE before < 1.1 * {TARGET}" for i, m in enumerate(_METHODS))
    + "), c AS (SELECT method, domain, count(*) AS n FROM m JOIN pool USING (row_id) GROUP BY ALL), p AS (SELECT *, 100.0::double * n / sum(n) OVER (PARTITION BY method) AS p FROM c) SELECT domain, "
    + ", ".join(f"coalesce(max(n) FILTER (method = '{m}'), 0) AS n_{m}, round(coalesce(max(p) FILTER (method = '{m}'), 0), 6) AS p_{m}" for m in _METHODS)
    + " FROM p GROUP BY 1"
)
def method_domains(spark, d):
    """Records and percents by domain of each way to fill one budget; the counts of all ways are pivoted at once."""
    p = pool(spark, d)
    parts = [_random(spark, d).select(F.lit("random").alias("method"), "domain")]
    parts += [select.prefix(p, [F.desc(Q[i]), "row_id"], 1.1 * TARGET).select(F.lit(m).alias("method"), "domain") for i, m in enumerate(_METHODS[1:])]
    u = parts[0]
    for x in parts[1:]:
        u = u.unionByName(x)
    n = u.groupBy("method", "domain").agg(F.count(F.lit(1)).alias("n"))
    n = n.join(F.broadcast(n.groupBy("method").agg(F.sum("n").alias("_all"))), "method").withColumn("p", 100.0 * F.col("n") / F.col("_all"))
    of = lambda m, c: F.coalesce(F.max(F.when(F.col("method") == m, F.col(c))), F.lit(0))
    return rounded(n.groupBy("domain").agg(*[x for m in _METHODS for x in (of(m, "n").alias(f"n_{m}"), of(m, "p").alias(f"p_{m}"))]))


@query(f"WITH {POOL}, k AS (SELECT row_id, row_number() OVER (ORDER BY {uniform_sql(42, 'row_id')}, row_id) AS k FROM pool) SELECT row_id, CASE WHEN k <= 100 THEN 'val' ELSE 'train' END AS part FROM k")
def train_val_split(spark, d):
    """The 100 records of lowest hash are for validation, whatever is done with the others."""
    from corpusmix.operators.order import number_rows

    n = number_rows(pool(spark, d).select("row_id", uniform(42, "row_id").alias("_u")), [], ["_u", "row_id"], rank="_k")
    return n.select("row_id", F.when(F.col("_k") < 100, "val").otherwise("train").alias("part"))


@query(f"WITH {POOL} SELECT row_id, (row_number() OVER (ORDER BY row_id) - 1) // 300 AS shard FROM pool")
def shard_assignment(spark, d):
    return shards(pool(spark, d).select("row_id"), "row_id", 300)


@query(f"WITH {POOL}, g AS (SELECT row_id, (row_number() OVER (ORDER BY row_id) - 1) // 64 AS row_group FROM pool) SELECT row_id, row_group % 8 AS rank, row_group // 8 AS step FROM g")
def strided_groups(spark, d):
    """Row groups of 64 records dealt to 8 readers in turn."""
    s = shards(pool(spark, d).select("row_id"), "row_id", 64)
    return s.select("row_id", (F.col("shard") % 8).alias("rank"), F.expr("shard div 8").alias("step"))


_NORMS = ("rank", "zscore", "minmax", "log1p_z")


@query()
def selection_overlap(spark, d):
    """Records that the best fifth by two normalisers have in common, over the size of one; one pass for all pairs."""
    from corpusmix.operators.order import number_rows

    flags = None
    for n in _NORMS:
        m = select.merge(scored(spark, d, n), theta(spark))
        size = m.count() // 5
        f = number_rows(m.select("row_id", "merged"), [], [F.desc("merged"), "row_id"], rank="_k").select("row_id", (F.col("_k") < size).cast("int").alias(n))
        flags = f if flags is None else flags.join(f, "row_id")
    pairs = [(a, b) for i, a in enumerate(_NORMS) for b in _NORMS[i + 1 :]]
    one = flags.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}|{b}") for a, b in pairs], F.sum("rank").alias("_n"))
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("common"), F.round(F.col(f"`{a}|{b}`") / F.col("_n"), 6).alias("overlap")) for a, b in pairs]))
    return one.select(rows.alias("r")).select("r.*")


_FORMS = {"rank": "mid / n", "zscore": "CASE WHEN s < 1e-10 THEN 0 ELSE (x - m) / s END", "minmax": "CASE WHEN b - a < 1e-10 THEN 0 ELSE (x - a) / (b - a) END", "log1p_z": "CASE WHEN ys < 1e-10 THEN 0 ELSE (ln(1 + x - a) - ym) / ys END"}
SQL["selection_overlap"] = (
    f"WITH {POOL}, {LONG}, {STATS}, {RANKED}, {_THETA}, lg AS (SELECT criterion, avg(ln(1 + x - a)) AS ym, stddev_pop(ln(1 + x - a)) AS ys FROM long JOIN st USING (criterion) GROUP BY 1), sg AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS norm, row_id, criterion, {f} AS sigma FROM rk JOIN st USING (criterion) JOIN lg USING (criterion)" for n, f in _FORMS.items())
    + "), w AS (SELECT norm, p.row_id, p.domain, "
    + ", ".join(f"max(sigma) FILTER (criterion = {i}) AS s{i}" for i in range(5))
    + f" FROM pool p JOIN sg USING (row_id) GROUP BY ALL), mm AS (SELECT norm, row_id, {MERGE} FROM w JOIN theta USING (domain)), top AS (SELECT norm, row_id FROM mm QUALIFY row_number() OVER (PARTITION BY norm ORDER BY merged DESC, row_id) <= (SELECT count(*) // 5 FROM pool)), nn(k, norm) AS (VALUES "
    + ", ".join(f"({i}, '{n}')" for i, n in enumerate(_NORMS))
    + ") SELECT x.norm AS a, y.norm AS b, (SELECT count(*) FROM top t JOIN top u USING (row_id) WHERE t.norm = x.norm AND u.norm = y.norm) AS common, round((SELECT count(*) FROM top t JOIN top u USING (row_id) WHERE t.norm = x.norm AND u.norm = y.norm) / (SELECT count(*) FROM top WHERE norm = 'rank')::double, 6) AS overlap FROM nn x JOIN nn y ON x.k < y.k"
)
