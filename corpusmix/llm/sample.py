"""Problem 6: a sample that stays the same as the data grows.

The ledger is a table of the keys chosen so far, a folder with a part for each run, which a run adds
whole or not at all. A later run keeps all of them by a join, and fills
the quota's growth from keys not seen in the ledger, those of lowest hash first. The quota's place
among the hashes is found by counting keys per hash range and reading only the one range it falls in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmix.functions.rng import uniform, uniform_sql
from corpusmix.llm.common import table
from corpusmix.operators.order import number_rows
from corpusmix.shared import folders, materialize, publish, temporary

RATE, SEED = 0.1, 20
#: Ranges of equal width over the hashes; the one that the quota falls in is sorted.
RANGES = 65536


def key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A record's doc_id in its one spelling; a null or blank one is made from the text as doc_ids are."""
    given = F.lower(F.trim(F.col(doc_id)))
    return F.when(given.isNull() | (given == ""), F.substring(F.md5(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")), 1, 12)).otherwise(given)


def grow(keys: DataFrame, ledger: DataFrame | None, rate: float = RATE, seed: int = SEED, run: int = 0) -> DataFrame:
    """The new ledger: key, priority, run (the run that chose it).

    keys: key; nulls are left out, repeated keys count once. ledger: an earlier result or None; all
    its keys stay, also those that are no longer among keys, which count for the quota. The quota is
    rate times the distinct keys, rounded up; a ledger larger than that stays whole. Ties of priority
    go by key. Empty tables give what the ledger has.
    """
    spark = keys.sparkSession
    distinct = keys.where("key is not null").select("key").distinct()
    if ledger is None:
        ledger = spark.createDataFrame([], "key string, priority double, run int")
    ledger = ledger.select("key", "priority", "run")
    marked = distinct.join(ledger.select(F.col("key").alias("_kept")), F.col("key") == F.col("_kept"), "left")
    marked = materialize(marked.select("key", uniform(seed, "key").alias("priority"), F.col("_kept").isNotNull().alias("_in")), "keys")
    spread = F.floor(F.col("priority") * RANGES).cast("int")
    counts = marked.groupBy("_in", spread.alias("_range")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 2 * RANGES rows
    total = sum(r["n"] for r in counts)
    need = max(0, -int(-rate * total // 1) - ledger.count())
    at, before = -1, 0
    for r in sorted((r for r in counts if not r["_in"]), key=lambda r: r["_range"]):
        at = r["_range"]
        if before + r["n"] >= need:
            break
        before += r["n"]
    fresh = marked.where("not _in")
    below = fresh.where(spread < at) if need else fresh.where("false")
    edge = number_rows(fresh.where(spread == at), [], ["priority", "key"]).where(F.col("rank") < max(0, need - before)).drop("rank")
    return ledger.unionByName(below.unionByName(edge).select("key", "priority", F.lit(run).alias("run")))


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger kept at a path; None before its first run."""
    runs = [f for f in folders(spark, path) if f.startswith("run=")]
    if not runs:
        return None
    return spark.read.schema("key string, priority double, run int").option("basePath", path).parquet(*[f"{path}/{r}" for r in runs])


def update(keys: DataFrame, path: str, run: int, rate: float = RATE, seed: int = SEED) -> DataFrame:
    """The ledger at path after adding what a run chooses from keys (see grow).

    The run's own rows become a folder of the ledger at once, when they are complete; a run that is
    there already, or that another driver adds meanwhile, isn't chosen again.
    """
    spark = keys.sparkSession
    if f"run={run}" not in folders(spark, path):
        new = grow(keys, read_ledger(spark, path), rate, seed, run).where(F.col("run") == run)
        publish(new.select("key", "priority"), f"{path}/run={run}")
    return read_ledger(spark, path)


def batches(records: DataFrame, runs: list[int], path: str, rate: float = RATE, seed: int = SEED) -> DataFrame:
    """The ledger at path after taking the records up to each batch of runs in turn."""
    ledger = read_ledger(records.sparkSession, path)
    for n in runs:
        ledger = update(records.where(F.col("batch_no") <= n).select(key().alias("key")), path, n, rate, seed)
    return ledger


def p6_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every delivery of the keys chosen when the batches up to 4, 8 and all are taken in turn."""
    records = table(spark, sf_dir, "unified_data")
    last = records.agg(F.max("batch_no")).first()[0] or 0
    keyed = materialize(records.select("row_id", "batch_no", key().alias("key")), "keyed")
    own = keyed.select(F.col("key").alias("doc_id"), F.lit(None).cast("string").alias("text"), "batch_no")
    ledger = batches(own, [n for n in (4, 8) if n < last] + [last], temporary(spark, "ledger"))
    return keyed.join(ledger, "key").select("row_id", F.col("key").alias("doc_id"), F.col("run").alias("since_batch"))


def _sql() -> str:
    """Three steps of growth, each keeping the former ones."""
    k = "CASE WHEN nullif(lower(trim(doc_id)), '') IS NULL THEN substr(md5(coalesce(text, '')), 1, 12) ELSE lower(trim(doc_id)) END"
    u = uniform_sql(SEED, "k")
    steps = f"""WITH r AS (SELECT row_id, batch_no, {k} AS k FROM unified_data), z AS (SELECT greatest(8, max(batch_no)) AS last FROM r),
 d AS (SELECT k, min(batch_no) AS b, {u} AS u FROM r GROUP BY k),
 l1 AS (SELECT k FROM d WHERE b <= 4 QUALIFY row_number() OVER (ORDER BY u, k) <= ceil({RATE} * count(*) OVER ())),
 l2 AS (SELECT k FROM d WHERE b <= 8 AND k NOT IN (FROM l1) QUALIFY row_number() OVER (ORDER BY u, k) <= ceil({RATE} * (SELECT count(*) FROM d WHERE b <= 8)) - (SELECT count(*) FROM l1)),
 l3 AS (SELECT k FROM d WHERE k NOT IN (FROM l1) AND k NOT IN (FROM l2) QUALIFY row_number() OVER (ORDER BY u, k) <= ceil({RATE} * (SELECT count(*) FROM d)) - (SELECT count(*) FROM l1) - (SELECT count(*) FROM l2)),
 l AS (SELECT k, 4 AS since_batch FROM l1 UNION ALL SELECT k, 8 FROM l2 UNION ALL SELECT k, (SELECT last FROM z) FROM l3)
"""
    return steps + "SELECT row_id, r.k AS doc_id, since_batch FROM r JOIN l USING (k)"


QUERIES = {"p6_sample": p6_sample}
SQL = {"p6_sample": _sql()}
