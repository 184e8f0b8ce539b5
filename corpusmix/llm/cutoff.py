"""Problem 1: cutoffs that keep a target fraction of each domain's records.

Equal scores of a domain are counted together first, so a score that a third of the rows share is
one row. The distinct scores are range-sorted by (criterion, domain, score), counted per partition
and domain, and prefix sums give the partition and the place of each target; only the rows at that
place and just before it are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmix.llm.common import table
from corpusmix.operators.order import number_rows

#: A share within this of the target meets it; the addend takes up rounding of the division.
TOLERANCE, ROUNDING = 0.05, 1e-9


def cutoffs(records: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each distinct row of targets.

    records: domain, quality_scores. targets: score_pos, criterion, domain, target_fraction.
    Usable records have the target's domain and a score at score_pos that is neither null, NaN nor
    infinite. cutoff: keeps the share of usable records nearest to the target by score >= cutoff,
    the lower share on a tie; +infinity where it is best to keep none; null without usable records,
    as are kept, share and gap then. gap: |share - target_fraction|. All records of an equal score
    are kept or none. Rows with a null in targets give a row with null results. Other columns of
    either table are ignored; empty tables give, as targets are, no rows or null results.
    """
    targets = targets.select("score_pos", "criterion", "domain", "target_fraction").distinct()
    # The targets are a table of criteria and domains; the criteria are its distinct places, a fixed handful.
    places = sorted(r[0] for r in targets.select("score_pos").where("score_pos >= 0").distinct().collect())
    scores = records.select(
        F.col("domain").alias("_domain"),
        F.explode(
            F.array(*[F.struct(F.lit(p).alias("_pos"), F.try_element_at("quality_scores", F.lit(p + 1)).alias("_score")) for p in places] or [F.expr("named_struct('_pos', cast(null as int), '_score', cast(null as double))")])
        ).alias("_x"),
    ).select("_domain", "_x._pos", (F.col("_x._score") + F.lit(0.0)).alias("_score"))
    domains = targets.select(F.col("domain").alias("_domain")).distinct()
    usable = scores.join(domains, "_domain", "left_semi").where("_domain is not null and _score is not null and not isnan(_score) and abs(_score) < double('infinity')")
    counts = usable.groupBy("_pos", "_domain", "_score").agg(F.count(F.lit(1)).alias("_records"))
    ordered = number_rows(counts, ["_pos", "_domain"], [F.col("_score").desc()], "_records", "_rank", "_above")
    # ordered: per distinct score, how many usable records lie above it.
    totals = ordered.groupBy("_pos", "_domain").agg(F.sum("_records").alias("usable"))
    wanted = targets.join(totals, (totals._pos == targets.score_pos) & (totals._domain == targets.domain), "left").drop("_pos", "_domain")
    place = wanted.withColumn("_want", F.col("target_fraction") * F.col("usable"))
    # The target lies in the score whose records take the running count from _above to _above + _records.
    at = (
        ordered.join(place.where("usable is not null and target_fraction is not null"), (F.col("_pos") == F.col("score_pos")) & (F.col("_domain") == F.col("domain")))
        .where("(_above < _want and _want <= _above + _records) or (_above = 0 and _want <= 0) or (_above + _records = usable and _want > usable) or (_above + _records < _want + 1e-6 and _above + _records > _want - 1e-6)")
        .select("score_pos", "criterion", "domain", "target_fraction", "_rank", "_score", "_above", "_records", "usable")
    )
    # The score just above that place; it may lie in the partition before.
    prior = ordered.select(F.col("_pos").alias("_p"), F.col("_domain").alias("_d"), (F.col("_rank") + 1).alias("_r"), F.col("_score").alias("_prior"))
    both = at.join(prior, (F.col("_p") == F.col("score_pos")) & (F.col("_d") == F.col("domain")) & (F.col("_r") == F.col("_rank")), "left")
    inf = F.lit(float("inf"))
    options = both.select(
        "score_pos", "criterion", "domain", "target_fraction",
        F.explode(
            F.array(
                F.struct(F.col("_score").alias("cutoff"), (F.col("_above") + F.col("_records")).alias("kept")),
                F.struct(F.coalesce("_prior", inf).alias("cutoff"), F.col("_above").alias("kept")),
            )
        ).alias("o"),
        "usable",
    ).select("score_pos", "criterion", "domain", "target_fraction", "o.cutoff", "o.kept", (F.col("o.kept") / F.col("usable")).alias("share"))
    options = options.withColumn("gap", F.abs(F.col("share") - F.col("target_fraction")))
    keys = ["score_pos", "criterion", "domain", "target_fraction"]
    best = options.groupBy(*keys).agg(F.min_by(F.struct("cutoff", "kept", "share", "gap"), F.struct(F.round("gap", 12), "kept")).alias("b"))
    best = best.select(*[F.col(k).alias(f"_{k}") for k in keys], "b")
    on = [F.col(k) == F.col(f"_{k}") for k in keys]
    return wanted.join(best, on, "left").select(*keys, "usable", "b.cutoff", "b.kept", "b.share", "b.gap")


def missed(report: DataFrame) -> DataFrame:
    """The criteria and domains whose target no cutoff meets; those without usable records are no case."""
    return report.where(F.col("gap") > TOLERANCE + ROUNDING).select("criterion", "domain").distinct()


def p1_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = cutoffs(table(spark, sf_dir, "unified_data"), table(spark, sf_dir, "keep_targets"))
    return r.withColumns({c: F.round(c, 9) for c in ("share", "gap")})


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missed(cutoffs(table(spark, sf_dir, "unified_data"), table(spark, sf_dir, "keep_targets")))


_SQL = """WITH s AS (
 SELECT t.score_pos, t.criterion, t.domain, t.target_fraction, u.quality_scores[t.score_pos + 1] AS x
 FROM (SELECT DISTINCT * FROM keep_targets) t LEFT JOIN unified_data u ON u.domain = t.domain
), v AS (SELECT * FROM s WHERE x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x)),
n AS (SELECT score_pos, criterion, domain, target_fraction, count(*) AS usable FROM v GROUP BY ALL),
k AS (SELECT score_pos, criterion, domain, target_fraction, x AS cutoff,
 sum(n) OVER (PARTITION BY score_pos, criterion, domain, target_fraction ORDER BY x DESC) AS kept
 FROM (SELECT score_pos, criterion, domain, target_fraction, x, count(*) AS n FROM v GROUP BY ALL)),
o AS (SELECT * FROM k UNION ALL SELECT score_pos, criterion, domain, target_fraction, 'infinity'::double, 0 FROM n),
g AS (SELECT o.*, usable, kept / usable::double AS share, abs(kept / usable::double - target_fraction) AS gap FROM o JOIN n USING (score_pos, criterion, domain, target_fraction)),
b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY score_pos, criterion, domain, target_fraction ORDER BY round(gap, 12), kept) = 1)
"""

QUERIES = {"p1_cutoffs": p1_cutoffs, "p1_found": p1_found}
SQL = {
    "p1_cutoffs": _SQL + """SELECT t.score_pos, t.criterion, t.domain, t.target_fraction, b.usable, b.cutoff, b.kept::bigint AS kept, round(b.share, 9) AS share, round(b.gap, 9) AS gap
 FROM (SELECT DISTINCT * FROM keep_targets) t LEFT JOIN b USING (score_pos, criterion, domain, target_fraction)""",
    "p1_found": _SQL + "SELECT DISTINCT criterion, domain FROM b WHERE gap > 0.050000001",
}
