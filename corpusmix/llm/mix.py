"""Problem 4: drawing records so that domains reach target shares of the tokens.

Each mix is a schedule of slots of BLOCK tokens. Slot i belongs to the domain at the point
frac(i * golden ratio) on the line of cumulative weights, so every stretch of the schedule holds
each domain in proportion. Each domain's records are shuffled by hash and laid end to end, again
for every repeat allowed; cut every BLOCK tokens they form blocks, and the n-th slot of a domain
takes its n-th block. Slots beyond the last block stay empty and show as a shortfall.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmix.llm.common import DOMAINS, SIZE_SQL, record_size, table
from corpusmix.operators.order import number_rows
from corpusmix.shared import materialize

#: Slots by which a domain's number of slots may differ from its weight of them: the points of N slots in a stretch of the
#: line differ from its share by at most a few times log(N), below this for any N that can be.
SLACK = 64
#: Tokens of a slot. Shares are met to about a slot and a record for each domain.
BLOCK = 256
GOLDEN = 0.6180339887498949


class Mix:
    """Lazy results of one call: chosen (rows), schedule (slots) and shares (report)."""

    def __init__(self, chosen: DataFrame, schedule: DataFrame, shares: DataFrame):
        self.chosen, self.schedule, self.shares = chosen, schedule, shares


def mix(records: DataFrame, targets: DataFrame, seed: int = 0, block: int = BLOCK) -> Mix:
    """Draw every mix of targets from the records with a domain from 0 to 21.

    records: row_id (unique), domain, text, token_count; sizes are record_size. targets: mix_id,
    domain, weight, max_repeats, budget_share; rows with a null or of a weight or budget that isn't
    positive draw nothing but stand in the report; equal rows count once.
    chosen: mix_id, domain, row_id, repeats (1..max_repeats), tokens (of all repeats), first_slot.
    shares: a row per row of targets with the pool's and the drawn tokens and records, the share
    reached, the domain's slots and how many of them have no block, and whether the domain is too
    small: it has slots without a block, or nearly, and max_repeats times it is less than its weight.
    Empty tables give no chosen rows.
    """
    spark = records.sparkSession
    keys = ["mix_id", "domain", "weight", "max_repeats", "budget_share"]
    targets = targets.select(*keys).distinct()
    pool = records.where(F.col("domain").between(0, DOMAINS - 1)).select("row_id", F.col("domain").alias("_domain"), record_size().alias("_size"))
    pool = pool.withColumn("_shuffle", F.xxhash64(F.lit(seed), "row_id"))
    laid = number_rows(materialize(pool, "pool"), ["_domain"], ["_shuffle", "row_id"], "_size", "_nth", "_start")
    totals = {d: t for d, t in laid.groupBy("_domain").agg(F.sum("_size")).collect()}  # at most 22 rows
    everything = sum(totals.values())
    sums: dict[str, float] = {}
    plans = []  # the rows of targets: mixes times 22 domains
    lines = [r.asDict() for r in targets.collect()]
    for m in sorted({r["mix_id"] for r in lines if r["mix_id"] is not None}):
        own = [r for r in lines if r["mix_id"] == m and None not in r.values() and r["weight"] > 0 and r["budget_share"] > 0 and r["domain"] in range(DOMAINS)]
        own.sort(key=lambda r: r["domain"])
        # A mix's size; of different budget_shares for a mix the largest counts.
        size = max([r["budget_share"] for r in own], default=0) * everything
        slots, at, whole = -(-int(size) // block), 0.0, sum(r["weight"] for r in own)
        sums[m] = max(1.0, whole)
        for r in own:
            plans.append((m, r["domain"], at, at + r["weight"] / whole if r is not own[-1] else 1.0, max(0, r["max_repeats"]), slots, totals.get(r["domain"], 0)))
            at += r["weight"] / whole
    lay = spark.createDataFrame(plans, "_mix string, _d long, _from double, _to double, _max int, _slots long, _total long")
    sizes = {p[0]: p[5] for p in plans}
    every = [spark.range(n).select(F.lit(m).alias("_mix"), F.col("id").alias("_slot")) for m, n in sizes.items()] or [lay.select("_mix", F.lit(0).cast("long").alias("_slot"))]
    points = every[0]
    for e in every[1:]:
        points = points.unionByName(e)
    point = (F.col("_slot") + 1) * F.lit(GOLDEN)
    points = points.withColumn("_point", point - F.floor(point))
    small = F.broadcast(lay)  # mixes times domains
    slots = points.join(small, "_mix").where("_from <= _point and _point < _to").select("_mix", "_d", "_slot")
    ranked = materialize(number_rows(slots, ["_mix", "_d"], ["_slot"], rank="_block"), "schedule")
    drawn = materialize(ranked.groupBy("_mix", "_d").agg(F.count(F.lit(1)).alias("_n")), "drawn")  # mixes times domains
    use = F.broadcast(lay.join(drawn, ["_mix", "_d"]))
    # Only the passes over a record whose block a slot takes are laid out.
    passes = laid.join(use, F.col("_domain") == F.col("_d")).withColumn("_e", F.least(F.col("_max"), F.ceil((F.col("_n") * block - F.col("_start")) / F.col("_total"))).cast("int")).where("_e > 0")
    passes = passes.withColumn("_pass", F.explode(F.sequence(F.lit(0), F.col("_e") - 1)))
    passes = passes.select("_mix", "_d", "row_id", "_size", F.expr(f"(_pass * _total + _start) div {block}").alias("_block"))
    hit = passes.join(ranked, ["_mix", "_d", "_block"])
    chosen = hit.groupBy("_mix", "_d", "row_id").agg(F.count(F.lit(1)).cast("int").alias("repeats"), F.sum("_size").alias("tokens"), F.min("_slot").alias("first_slot"))
    chosen = materialize(chosen.select(F.col("_mix").alias("mix_id"), F.col("_d").alias("domain"), "row_id", "repeats", "tokens", "first_slot"), "mix")
    got = chosen.groupBy("mix_id", "domain").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("records")).select(F.col("mix_id").alias("_m"), F.col("domain").alias("_g"), "tokens", "records")
    mixed = chosen.groupBy("mix_id").agg(F.sum("tokens").alias("mix_tokens")).select(F.col("mix_id").alias("_mm"), "mix_tokens")
    have = F.try_element_at(F.create_map(*[x for d in totals for x in (F.lit(d).cast("long"), F.lit(totals[d]).cast("long"))]), F.col("domain").cast("long")) if totals else F.lit(None).cast("long")
    want = F.col("weight") * F.col("budget_share") * F.lit(everything)
    shares = targets.join(got, (F.col("mix_id") == F.col("_m")) & (F.col("domain") == F.col("_g")), "left").join(mixed, F.col("mix_id") == F.col("_mm"), "left")
    slots_of = drawn.select(F.col("_mix").alias("_sm"), F.col("_d").alias("_sd"), F.col("_n").alias("slots"))
    shares = shares.join(F.broadcast(slots_of), (F.col("mix_id") == F.col("_sm")) & (F.col("domain") == F.col("_sd")), "left")
    pooled = F.when(F.col("domain").between(0, DOMAINS - 1), F.coalesce(have, F.lit(0)))
    scale = F.try_element_at(F.create_map(*[F.lit(x) for p in sums.items() for x in p]), F.col("mix_id")) if sums else F.lit(1.0)
    blocks = F.ceil(F.greatest(F.col("max_repeats"), F.lit(0)) * F.coalesce(pooled, F.lit(0)) / block).cast("long")
    shares = shares.select(*keys, pooled.alias("pool_tokens"), zero("tokens").alias("tokens"), zero("records").alias("records"), zero("slots").alias("slots"), F.greatest(F.lit(0).cast("long"), zero("slots") - blocks).alias("empty_slots"), (zero("slots") * scale - blocks + SLACK > 0).alias("_short"), (zero("tokens") / F.col("mix_tokens")).alias("share"), (F.col("max_repeats") * pooled < want).alias("_lacks"))
    # Slots without a block, or nearly, name the domain; the totals decide those within a slot of it.
    shares = shares.withColumn("too_small", F.col("_short") & F.col("_lacks")).drop("_short", "_lacks")
    return Mix(chosen, ranked.select(F.col("_mix").alias("mix_id"), F.col("_d").alias("domain"), F.col("_slot").alias("slot"), F.col("_block").alias("block")), shares)


def zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0)).cast("long")


def _mix(spark: SparkSession, sf_dir: str) -> Mix:
    return mix(table(spark, sf_dir, "unified_data"), table(spark, sf_dir, "mix_targets"))


def p4_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).chosen


def p4_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).shares


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).shares.where("too_small").select("mix_id", "domain").distinct()


QUERIES = {"p4_chosen": p4_chosen, "p4_shares": p4_shares, "p4_found": p4_found}
SQL = {
    "p4_found": f"""WITH d AS (SELECT domain, sum({SIZE_SQL}) AS t FROM unified_data WHERE domain BETWEEN 0 AND 21 GROUP BY 1)
 SELECT DISTINCT mix_id, m.domain FROM mix_targets m LEFT JOIN d USING (domain)
 WHERE max_repeats * coalesce(t, 0) < weight * budget_share * (SELECT sum(t) FROM d)""",
}
