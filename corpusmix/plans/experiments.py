"""Queries on many sets of parameters, their selections and their losses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmix.functions.rng import uniform, uniform_sql
from corpusmix.operators import params, regress, search, select
from corpusmix.operators.order import number_rows
from corpusmix.plans.base import pool, table
from corpusmix.plans.selection import COPIES, MERGE, SCORED, VALUE, scored
from corpusmix.plans.signals import rounded
from corpusmix.schema import CRITERIA
from corpusmix.shared import materialize

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def experiments(spark: SparkSession, d: str) -> DataFrame:
    return params.latest(table(spark, d, "experiment_meta"))


def theta(spark: SparkSession, d: str) -> DataFrame:
    return params.of_experiments(experiments(spark, d))


def selection(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """All experiments' selections: one row for each experiment and record drawn; ranks are among reference records.

    Each use draws them anew: what needs them twice writes them, or their sums, first.
    """
    return select.select_many(scored(spark, d), theta(spark, d), columns=columns)


EX = "ex AS (SELECT * FROM experiment_meta WHERE experiment_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY experiment_id ORDER BY finished_at DESC NULLS LAST, val_loss NULLS FIRST, train_loss NULLS FIRST) = 1)"
_KEYED = "kd AS (SELECT experiment_id, quality_weights AS qw, sampling_params AS sp, unnest(map_keys(sampling_params)) AS k FROM ex)"
THETA = f"{EX}, {_KEYED}, theta AS (SELECT experiment_id, k::bigint AS domain, " + ", ".join(f"coalesce(qw[k]['{c}'], 0) AS a{i}" for i, c in enumerate(CRITERIA)) + ", sp[k]['lambda'] AS lam, sp[k]['omega'] AS omega, sp[k]['eta'] AS eta, sp[k]['epsilon'] AS epsilon FROM kd)"
_MELT = "melted AS (" + " UNION ALL ".join(f"SELECT experiment_id, domain, '{n}' AS name, {c} AS value FROM theta" for n, c in [*((f"a{i}", f"a{i}") for i in range(5)), ("lambda", "lam"), ("omega", "omega"), ("eta", "eta"), ("epsilon", "epsilon")]) + ")"
KEPT = f"{SCORED}, {THETA}, rf AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY domain ORDER BY {uniform_sql(1729, 'row_id')}, row_id) <= {select.REFERENCE} THEN tokens ELSE 0 END AS w FROM scored), merged AS (SELECT experiment_id, row_id, s.domain, tokens, w, lam, omega, eta, epsilon, {MERGE} FROM rf s JOIN theta USING (domain)), ranked AS (SELECT *, round(sum(w) OVER (PARTITION BY experiment_id, domain ORDER BY merged DESC RANGE UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY experiment_id, domain)::double, 12) AS rank FROM merged), valued AS (SELECT *, {VALUE} FROM ranked), kept AS (SELECT *, (floor(value) + ({uniform_sql(42, 'experiment_id', 'row_id')} < value - floor(value))::int)::int AS copies FROM valued WHERE (floor(value) + ({uniform_sql(42, 'experiment_id', 'row_id')} < value - floor(value))::int)::int > 0)"
_MIX = "mn AS (SELECT experiment_id, domain, sum(copies)::bigint AS n FROM kept GROUP BY ALL), mix AS (SELECT experiment_id, domain, n, n / sum(n) OVER (PARTITION BY experiment_id)::double AS share FROM mn)"


@query(f"WITH {THETA} SELECT experiment_id, domain, " + ", ".join(f"round(a{i}, 6) AS a{i}" for i in range(5)) + ", round(lam, 6) AS lambda, round(omega, 6) AS omega, round(eta, 6) AS eta, round(epsilon, 9) AS epsilon FROM theta")
def experiment_theta(spark, d):
    t = theta(spark, d)
    return rounded(t.drop("epsilon")).join(t.select("experiment_id", "domain", F.round("epsilon", 9).alias("epsilon")), ["experiment_id", "domain"])


@query(
    "WITH g AS (SELECT e.range AS experiment_id, d.range AS domain FROM range(40) e, range(22) d), r AS (SELECT *, "
    + ", ".join(f"{uniform_sql(3, chr(39) + 'a' + chr(39), 'experiment_id', str(i))} * {uniform_sql(3, chr(39) + 'b' + chr(39), 'experiment_id', 'domain', str(i))} AS r{i}" for i in range(5))
    + " FROM g) SELECT experiment_id, domain, "
    + ", ".join(f"round(r{i} / (r0 + r1 + r2 + r3 + r4), 6) AS a{i}" for i in range(5))
    + ", "
    + ", ".join(f"round({uniform_sql(3, chr(39) + c + chr(39), 'experiment_id', 'domain')} * {s}, 6) AS {q}" for c, s, q in (("lambda", 1000.0, '"lambda"'), ("omega", 0.1, "omega"), ("eta", 1.0, "eta"), ("epsilon", 0.001, "epsilon")))
    + " FROM r"
)
def theta_sample(spark, d):
    return rounded(params.draw(spark, 40, seed=3))


@query(
    f"WITH {THETA}, o AS (SELECT *, row_number() OVER (PARTITION BY experiment_id ORDER BY domain) - 1 AS i, count(*) OVER (PARTITION BY experiment_id) AS n FROM theta) "
    + " UNION ALL ".join([*(f"SELECT experiment_id, (i * 5 + {j})::int AS pos, round(a{j}, 9) AS value FROM o" for j in range(5)), *(f"SELECT experiment_id, (n * 5 + i * 4 + {j})::int, round({c}, 9) FROM o" for j, c in enumerate(("lam", "omega", "eta", "epsilon")))])
)
def theta_flatten(spark, d):
    return rounded(params.flatten(theta(spark, d)).select("experiment_id", F.posexplode("theta").alias("pos", "value")), 9)


@query(f"WITH {THETA}, {_MELT} SELECT experiment_id, domain, name, round(value, 9) AS value FROM melted")
def theta_unflatten(spark, d):
    return rounded(params.unflatten(params.flatten(theta(spark, d))), 9)


@query(f"{KEPT} SELECT experiment_id, row_id, copies FROM kept")
def multi_theta_selection(spark, d):
    return selection(spark, d, "experiment_id", "row_id", "copies")


def _mix(spark, d):
    n = selection(spark, d, "experiment_id", "domain", "copies").groupBy("experiment_id", "domain").agg(F.sum("copies").alias("n"))
    n = materialize(n, "mix")  # a row for each experiment and domain, read again for totals and by what fits on them
    total = n.groupBy("experiment_id").agg(F.sum("n").alias("_all"))
    return n.join(total, "experiment_id").select("experiment_id", "domain", "n", (F.col("n") / F.col("_all")).alias("share"))


@query(f"{KEPT}, {_MIX} SELECT experiment_id, domain, n, round(share, 6) AS share FROM mix")
def experiment_domain_mix(spark, d):
    return rounded(_mix(spark, d))


@query(f"{KEPT}, {_MIX} SELECT experiment_id, " + ", ".join(f"coalesce(sum(n) FILTER (domain = {i}), 0)::bigint AS d{i}" for i in range(22)) + " FROM mix GROUP BY 1")
def experiment_domain_matrix(spark, d):
    return _mix(spark, d).groupBy("experiment_id").agg(*[F.coalesce(F.sum(F.when(F.col("domain") == i, F.col("n"))), F.lit(0)).cast("long").alias(f"d{i}") for i in range(22)])


@query(f"{KEPT}, {_MIX} SELECT domain, count(*) AS experiments, round(avg(share), 6) AS mean, round(stddev_pop(share), 6) AS std, round(min(share), 6) AS min, round(max(share), 6) AS max, round(stddev_pop(share) / avg(share), 6) AS cv FROM mix GROUP BY 1")
def mix_variance(spark, d):
    m = _mix(spark, d).groupBy("domain").agg(F.count(F.lit(1)).alias("experiments"), F.avg("share").alias("mean"), F.stddev_pop("share").alias("std"), F.min("share").alias("min"), F.max("share").alias("max"))
    return rounded(m.withColumn("cv", F.col("std") / F.col("mean")))


@query(f"{KEPT} SELECT count(DISTINCT row_id) AS selected, (SELECT count(*) FROM pool) AS records, round(100.0::double * count(DISTINCT row_id) / (SELECT count(*) FROM pool), 6) AS percent FROM kept")
def selection_union_coverage(spark, d):
    s = selection(spark, d).select("row_id").distinct().agg(F.count(F.lit(1)).alias("selected"))
    n = pool(spark, d).agg(F.count(F.lit(1)).alias("records"))
    return s.crossJoin(n).withColumn("percent", F.round(100.0 * F.col("selected") / F.col("records"), 6))  # a row each


@query(f"{KEPT}, {_MIX} SELECT experiment_id, domain, round(share, 6) AS share, row_number() OVER (PARTITION BY experiment_id ORDER BY share DESC, domain) AS place FROM mix QUALIFY place <= 5")
def top_domains(spark, d):
    w = Window.partitionBy("experiment_id").orderBy(F.desc("share"), "domain")
    return rounded(_mix(spark, d).select("experiment_id", "domain", "share", F.row_number().over(w).cast("long").alias("place")).where("place <= 5"))


@query(
    f"{KEPT}, {_MIX}, t AS (SELECT experiment_id, domain, share, n, row_number() OVER (PARTITION BY experiment_id ORDER BY share DESC, domain) AS place FROM mix), a AS (SELECT experiment_id, sum(n)::bigint AS selected, string_agg(domain::varchar, ',' ORDER BY place) FILTER (place <= 5 AND share > 0.01) AS top FROM t GROUP BY 1) SELECT experiment_id, round(val_loss, 6) AS val_loss, coalesce(selected, 0)::bigint AS selected, top FROM ex LEFT JOIN a USING (experiment_id) WHERE NOT isnan(val_loss) AND NOT isinf(val_loss)"
)
def experiment_table(spark, d):
    w = Window.partitionBy("experiment_id").orderBy(F.desc("share"), "domain")
    t = _mix(spark, d).withColumn("place", F.row_number().over(w))
    top = F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("place") <= 5) & (F.col("share") > 0.01), F.struct("place", "domain")))), lambda x: x["domain"].cast("string")), ",")
    a = t.groupBy("experiment_id").agg(F.sum("n").alias("selected"), top.alias("top"))
    e = experiments(spark, d).where(search.finite("val_loss")).select("experiment_id", F.round("val_loss", 6).alias("val_loss"))
    return e.join(a, "experiment_id", "left").select("experiment_id", "val_loss", F.coalesce("selected", F.lit(0)).alias("selected"), "top")


BUDGET = 4000


@query(
    f"{KEPT}, {COPIES}, t AS (SELECT experiment_id, sum(tokens) AS al, count(*) AS n FROM each GROUP BY 1), k AS (SELECT experiment_id, row_id, copy, row_number() OVER (PARTITION BY experiment_id ORDER BY {uniform_sql(0, 'experiment_id', 'row_id')}, row_id, copy) - 1 AS k FROM each) SELECT experiment_id, row_id, count(*) AS copies FROM k JOIN t USING (experiment_id) WHERE al <= {BUDGET} OR k < greatest(100, floor({BUDGET}::double / (al / n) * 1.2)) GROUP BY ALL"
)
def experiment_budget(spark, d):
    s = materialize(selection(spark, d, "experiment_id", "row_id", "tokens", "copies"), "selected")
    return select.subsample_copies(s, BUDGET)


@query(f"WITH {EX} SELECT experiment_id, round(val_loss, 6) AS val_loss FROM ex WHERE val_loss IS NOT NULL AND NOT isnan(val_loss) AND NOT isinf(val_loss)")
def finite_losses(spark, d):
    return experiments(spark, d).where(search.finite("val_loss")).select("experiment_id", F.round("val_loss", 6).alias("val_loss"))


LOSSES = f"{EX}, fin AS (SELECT * FROM ex WHERE val_loss IS NOT NULL AND NOT isnan(val_loss) AND NOT isinf(val_loss)), tl AS (SELECT experiment_id, val_loss AS x, e.key AS task, e.value AS loss FROM (SELECT experiment_id, val_loss, unnest(map_entries(per_task_losses)) AS e FROM fin)), losses AS (SELECT * FROM tl WHERE loss IS NOT NULL AND NOT isnan(loss) AND NOT isinf(loss))"
_FIT = "fit AS (SELECT task, regr_slope(loss, x) AS b, regr_intercept(loss, x) AS a FROM losses GROUP BY 1), pr AS (SELECT experiment_id, task, loss, a + b * x AS pred FROM losses JOIN fit USING (task))"
_W = "tv AS (SELECT task, avg(loss) AS m, var_pop(loss) AS v FROM pr GROUP BY 1 HAVING var_pop(loss) > 1e-8), tr AS (SELECT task, 1 - sum(pow(loss - pred, 2)) / greatest(sum(pow(loss - m, 2)), 1e-12) AS r2, sqrt(max(v)) AS sigma FROM pr JOIN tv USING (task) GROUP BY 1), tw AS (SELECT task, r2, sigma, greatest(r2, 0) / sum(greatest(r2, 0)) OVER () AS weight, greatest(r2, 0) * sigma / sum(greatest(r2, 0) * sigma) OVER () AS weight_sigma FROM tr)"
_C = "cb AS (SELECT experiment_id, sum(weight * (loss - m) / sqrt(v)) AS actual, sum(weight * (pred - m) / sqrt(v)) AS pred FROM pr JOIN tv USING (task) JOIN tw USING (task) GROUP BY 1)"


def losses(spark, d):
    return search.task_losses(experiments(spark, d))


def predicted(spark, d):
    return search.line_fits(losses(spark, d), experiments(spark, d).select("experiment_id", F.col("val_loss").alias("x")))


@query(f"WITH {LOSSES} SELECT experiment_id, task, round(loss, 6) AS loss FROM losses")
def task_losses(spark, d):
    return rounded(losses(spark, d))


@query(f"WITH {LOSSES} SELECT task, count(*) AS n, round(avg(loss), 6) AS mean, round(stddev_pop(loss), 6) AS std, round(min(loss), 6) AS min, round(max(loss), 6) AS max FROM losses GROUP BY 1")
def loss_stats(spark, d):
    return rounded(search.loss_stats(losses(spark, d)))


@query(f"WITH {LOSSES}, {_FIT}, {_W} SELECT task, round(r2, 6) AS r2, round(sigma, 6) AS sigma, round(weight, 6) AS weight FROM tw")
def task_weights(spark, d):
    return rounded(search.task_weights(predicted(spark, d)))


@query(f"WITH {LOSSES}, {_FIT}, {_W} SELECT task, round(r2, 6) AS r2, round(sigma, 6) AS sigma, round(weight_sigma, 6) AS weight FROM tw")
def task_weights_sigma(spark, d):
    return rounded(search.task_weights(predicted(spark, d), "r2_sigma"))


def _combined(spark, d):
    p = predicted(spark, d)
    return search.combined(p, search.task_weights(p))


@query(
    f"WITH {LOSSES}, {_FIT}, {_W}, {_C}, r AS (SELECT *, avg(actual) OVER () AS mm, rank() OVER (ORDER BY actual) + (count(*) OVER (PARTITION BY actual) - 1) / 2.0::double AS ra, rank() OVER (ORDER BY pred) + (count(*) OVER (PARTITION BY pred) - 1) / 2.0::double AS rp, row_number() OVER (ORDER BY actual, experiment_id) AS na, row_number() OVER (ORDER BY pred, experiment_id) AS np, least(10, count(*) OVER ()) AS k FROM cb) SELECT round(1 - sum(pow(actual - pred, 2)) / greatest(sum(pow(actual - mm, 2)), 1e-12), 6) AS r2, round(avg(abs(actual - pred)), 6) AS mae, round(corr(ra, rp), 6) AS spearman, round(count(*) FILTER (np <= k AND na <= k) / max(k)::double, 6) AS recall, round((avg(actual) - avg(actual) FILTER (np <= k)) / greatest(stddev_pop(actual), 1e-12), 6) AS lift FROM r"
)
def ensemble_quality(spark, d):
    return rounded(search.quality(_combined(spark, d)))


@query(f"WITH {LOSSES}, {_FIT}, {_W}, {_C}, {THETA[len(EX) + 2:]}, {_MELT}, top AS (SELECT experiment_id FROM cb ORDER BY pred, experiment_id LIMIT 10) SELECT domain, name, round(avg(value), 6) AS value FROM melted JOIN top USING (experiment_id) GROUP BY ALL")
def best_theta(spark, d):
    return rounded(search.best_theta(_combined(spark, d), theta(spark, d)))


@query(f"WITH {EX}, j AS (SELECT experiment_id, train_loss AS old, val_loss AS new FROM ex WHERE NOT isnan(train_loss) AND NOT isinf(train_loss) AND NOT isnan(val_loss) AND NOT isinf(val_loss)) SELECT count(*) AS n, round(avg(new - old), 6) AS mean_delta, round(min(new - old), 6) AS min_delta, round(max(new - old), 6) AS max_delta, round(corr(old, new), 6) AS pearson FROM j")
def loss_delta(spark, d):
    e = experiments(spark, d).where(search.finite("train_loss") & search.finite("val_loss"))
    dl = F.col("val_loss") - F.col("train_loss")
    return rounded(e.agg(F.count(F.lit(1)).alias("n"), F.avg(dl).alias("mean_delta"), F.min(dl).alias("min_delta"), F.max(dl).alias("max_delta"), F.corr("train_loss", "val_loss").alias("pearson")))


@query(
    f"WITH {LOSSES}, k AS (SELECT count(DISTINCT task) AS k FROM losses), w AS (SELECT experiment_id, sum(loss) AS s FROM losses GROUP BY 1 HAVING count(*) = (SELECT k FROM k)), v AS (SELECT avg(v) AS mv, sum(v) AS sv FROM (SELECT task, var_samp(loss) AS v FROM losses WHERE experiment_id IN (SELECT experiment_id FROM w) GROUP BY 1)), t AS (SELECT var_samp(s) AS vs FROM w) SELECT round(mv, 6) AS mean_variance, round((vs - sv) / (k * (k - 1)), 6) AS mean_covariance, round(vs / (k * k), 6) AS variance_of_mean, round(vs / (k * k) / mv, 6) AS compression FROM v, t, k"
)
def variance_decomposition(spark, d):
    return rounded(search.variances(losses(spark, d)))


@query(f"WITH {LOSSES}, st AS (SELECT task, stddev_pop(loss) AS s, row_number() OVER (ORDER BY stddev_pop(loss) DESC, task) AS down, row_number() OVER (ORDER BY stddev_pop(loss), task) AS up FROM losses GROUP BY 1) SELECT experiment_id, round(avg(loss), 6) AS equal, round(sum(loss * s) / sum(s), 6) AS by_sigma, round(avg(loss) FILTER (down <= 5), 6) AS top5, round(avg(loss) FILTER (up <= 5), 6) AS bottom5 FROM losses JOIN st USING (task) GROUP BY 1")
def loss_schemes(spark, d):
    l = losses(spark, d)  # noqa: E741
    s = l.groupBy("task").agg(F.stddev_pop("loss").alias("s"))
    s = s.select("task", "s", F.row_number().over(Window.orderBy(F.desc("s"), "task")).alias("down"), F.row_number().over(Window.orderBy("s", "task")).alias("up"))  # a row for each task
    j = l.join(F.broadcast(s), "task")
    only = lambda c: F.avg(F.when(F.col(c) <= 5, F.col("loss")))
    return rounded(j.groupBy("experiment_id").agg(F.avg("loss").alias("equal"), (F.sum(F.col("loss") * F.col("s")) / F.sum("s")).alias("by_sigma"), only("down").alias("top5"), only("up").alias("bottom5")))


@query(
    f"WITH {LOSSES}, {THETA[len(EX) + 2:]}, {_MELT}, j AS (SELECT name, value, val_loss FROM melted JOIN fin USING (experiment_id)) SELECT name, count(*) AS n, round(stddev_pop(value), 6) AS std, round(max(value) - min(value), 6) AS spread, round(stddev_pop(value) / avg(value), 6) AS cv, round(corr(value, val_loss), 6) AS loss_correlation FROM j GROUP BY 1"
)
def theta_coverage(spark, d):
    e = experiments(spark, d).where(search.finite("val_loss")).select("experiment_id", "val_loss")
    j = params.melt(theta(spark, d)).join(e, "experiment_id")
    return rounded(j.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("value").alias("std"), (F.max("value") - F.min("value")).alias("spread"), (F.stddev_pop("value") / F.avg("value")).alias("cv"), F.corr("value", "val_loss").alias("loss_correlation")))


_DRAWS = f"{EX}, fin AS (SELECT * FROM ex WHERE val_loss IS NOT NULL AND NOT isnan(val_loss) AND NOT isinf(val_loss)), e AS (SELECT experiment_id, val_loss, train_loss, row_number() OVER (ORDER BY experiment_id) - 1 AS i, count(*) OVER () AS n FROM fin), dr AS (SELECT draw, floor({uniform_sql(42, 'draw', 'i')} * n)::int AS i FROM e, (SELECT unnest(range(30)) AS draw)), bag AS (SELECT draw::int AS draw, e.experiment_id FROM dr JOIN e USING (i))"


def _finite_experiments(spark, d):
    return experiments(spark, d).where(search.finite("val_loss"))


@query(f"WITH {_DRAWS} SELECT draw, count(DISTINCT experiment_id) AS in_bag, (SELECT count(*) FROM fin) - count(DISTINCT experiment_id) AS out_of_bag FROM bag GROUP BY 1")
def bootstrap_bags(spark, d):
    """Only the resampling, 30 times; bootstrap_reliability has the draws that the number of experiments asks for."""
    e = _finite_experiments(spark, d)
    n = e.agg(F.count(F.lit(1)).alias("_n"))
    b = search.resampled(e.select("experiment_id"), 30).groupBy("draw").agg(F.countDistinct("experiment_id").alias("in_bag"))
    return b.crossJoin(n).select("draw", "in_bag", (F.col("_n") - F.col("in_bag")).alias("out_of_bag"))  # n is a row


@query(f"WITH {_DRAWS}, r AS (SELECT draw, regr_r2(val_loss, train_loss) AS r2 FROM bag JOIN fin USING (experiment_id) WHERE NOT isnan(train_loss) AND NOT isinf(train_loss) GROUP BY 1), f AS (SELECT r2 FROM r WHERE r2 IS NOT NULL AND NOT isnan(r2)) SELECT count(*) AS draws, round(avg(r2), 6) AS mean, round(stddev_pop(r2), 6) AS std, round(quantile_cont(r2, 0.025), 6) AS low, round(quantile_cont(r2, 0.975), 6) AS high FROM f")
def bootstrap_interval(spark, d):
    """Only the resampling, with a line through each bag; bootstrap_reliability judges fits out of the bag."""
    e = _finite_experiments(spark, d)
    b = search.resampled(e.select("experiment_id"), 30).join(e.where(search.finite("train_loss")), "experiment_id")
    return rounded(search.interval(b.groupBy("draw").agg(F.regr_r2("val_loss", "train_loss").alias("r2"))))


@query()
def bootstrap_reliability(spark, d):
    """How well fits on the parameters predict losses of experiments out of the bag; draws by their number."""
    e = _finite_experiments(spark, d).select("experiment_id", F.col("val_loss").alias("loss"))
    return search.reliability(e, params.flatten(params.filled(theta(spark, d))))


@query(f"WITH {EX} SELECT experiment_id, (ntile(5) OVER (ORDER BY {uniform_sql(42, 'experiment_id')}, experiment_id) - 1)::int AS fold FROM ex")
def k_folds(spark, d):
    return search.folds(experiments(spark, d).select("experiment_id"), 5)


_IW = "list_filter(regexp_split_to_array(coalesce({c}, ''), '[\\t-\\r ]+'), lambda w: w <> '')"


@query(
    f"WITH i AS (SELECT task, list_transform({_IW.format(c='context')}, lambda w: length(w)::double) AS c, list_transform({_IW.format(c='answer')}, lambda w: length(w)::double) AS a FROM eval_items) SELECT task, round(avg(coalesce(list_sum(a), 0) / greatest(len(a), 1)), 6) AS loss, count(*) AS rows FROM i GROUP BY 1"
)
def masked_task_loss(spark, d):
    """Word lengths stand for losses; those of the answer count, those of the context are masked."""
    from corpusmix.functions.text import words

    of = lambda c: F.transform(words(F.coalesce(F.col(c), F.lit(""))), lambda w: F.length(w).cast("double"))
    e = table(spark, d, "eval_items").select("task", of("context").alias("c"), of("answer").alias("a"))
    mask = F.concat(F.transform("c", lambda x: F.lit(False)), F.transform("a", lambda x: F.lit(True)))
    return rounded(search.masked_means(e.select("task", F.concat("c", "a").alias("losses"), mask.alias("mask"))))


@query()
def task_models(spark, d):
    """Cross-validated ridge fits of every task: r2 and weight of each."""
    e = experiments(spark, d)
    p = search.fit_tasks(losses(spark, d), params.flatten(params.filled(theta(spark, d))), search.folds(e.select("experiment_id"), 5))
    return search.task_weights(p)


SEARCH_SEED = 9999


def _search(spark, d, points: int):
    """Scores of new sets on the experiments' domains, and the domains."""
    t = theta(spark, d)
    domains = sorted(r["domain"] for r in t.select("domain").distinct().collect())
    flat = params.flatten(params.filled(t))
    candidates = params.flatten(params.draw(spark, points, SEARCH_SEED, domains))
    return search.search(losses(spark, d), flat, search.task_weights(predicted(spark, d)), candidates), domains


@query()
def learn_and_search(spark, d, points: int = 100_000, k: int = 10):
    """New sets of parameters, drawn and scored by fits on the tested ones; the k best, averaged."""
    scores, domains = _search(spark, d, points)
    return search.mean_theta(params.drawn(search.best(scores, k), SEARCH_SEED, domains))


def _vectors(spark, d):
    e = experiments(spark, d).where(search.finite("val_loss")).select("experiment_id", F.col("val_loss").alias("loss"))
    return regress.vectors(params.flatten(params.filled(theta(spark, d))), e)


@query()
def regressor_scores(spark, d):
    """Trees, forests and ridge on the parameters, with a fifth of the experiments held out."""
    v = _vectors(spark, d)
    held = search.folds(v.select("experiment_id"), 5).where("fold = 0").select("experiment_id")
    return regress.scores(v, held)


@query()
def parameter_importance(spark, d):
    return regress.importances(_vectors(spark, d), [])


@query()
def least_squares(spark, d):
    return regress.least_squares(_vectors(spark, d))


@query()
def mix_components(spark, d):
    """Principal components of the domain shares of all experiments."""
    return regress.components(experiment_domain_matrix(spark, d), [f"d{i}" for i in range(22)])


@query(
    f"{KEPT}, em AS (SELECT experiment_id FROM ex WHERE experiment_id NOT IN (SELECT experiment_id FROM kept)), fb AS (SELECT row_id FROM pool QUALIFY row_number() OVER (ORDER BY {uniform_sql(42, 'row_id')}, row_id) <= 100) SELECT experiment_id, row_id, copies FROM kept UNION ALL SELECT experiment_id, row_id, 1 FROM em, fb"
)
def selection_with_fallback(spark, d):
    """Experiments that select nothing get the 100 records of lowest hash."""
    s = materialize(selection(spark, d, "experiment_id", "row_id", "copies"), "selected")
    none = experiments(spark, d).select("experiment_id").join(s.select("experiment_id").distinct(), "experiment_id", "left_anti")
    few = number_rows(pool(spark, d).select("row_id", uniform(42, "row_id").alias("_u")), [], ["_u", "row_id"], rank="_k").where("_k < 100")
    return s.unionByName(none.crossJoin(F.broadcast(few.select("row_id"))).withColumn("copies", F.lit(1)))  # 100 rows


@query(f"{KEPT}, s AS (SELECT DISTINCT row_id FROM kept), c AS (SELECT row_id FROM pool WHERE row_id % 3 = 0) SELECT count(*) FILTER (row_id IN (FROM c)) AS hits, count(*) FILTER (row_id NOT IN (FROM c)) AS misses FROM s")
def cache_hits(spark, d):
    """Selected records that a cache of every third one holds, and those it lacks."""
    s = selection(spark, d).select("row_id").distinct()
    cache = pool(spark, d).where("row_id % 3 = 0").select("row_id")
    hits, misses = s.join(cache, "row_id", "left_semi"), s.join(cache, "row_id", "left_anti")
    return hits.agg(F.count(F.lit(1)).alias("hits")).crossJoin(misses.agg(F.count(F.lit(1)).alias("misses")))  # a row each
