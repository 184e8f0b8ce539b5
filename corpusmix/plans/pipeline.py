"""The whole way from raw shards to a written selection."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmix.operators import select
from corpusmix.schema import CRITERIA
from corpusmix.shared import materialize
from corpusmix.sources import shards, writers


def pool_of(preprocessed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The selection's two inputs from preprocessed shards; a record is named by its shard and row."""
    rows = preprocessed.withColumn("row_id", F.col("shard_idx") * F.lit(1 << 32) + F.col("row_in_shard"))
    pool = rows.select("row_id", "domain", F.greatest(F.lit(1).cast("long"), F.expr("doc_char_count div 4")).alias("tokens"))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("criterion"), F.col(f"qs_{c}").cast("double").alias("x")) for i, c in enumerate(CRITERIA)]))
    return pool, rows.select("row_id", each.alias("_e")).select("row_id", "_e.criterion", "_e.x")


def resample(spark: SparkSession, raw: DataFrame, theta: DataFrame, out: str, target_tokens: int | None = None, normalizer: str = "rank", seed: int = 42) -> dict:
    """Preprocess raw shards, select by theta, write the selected texts as parquet and summarise.

    Returns the summary: documents before and after, tokens, and the change by domain.
    """
    done = materialize(shards.preprocess(raw), "preprocessed")
    pool, long = pool_of(done)
    chosen = select.select(select.rank_rows(select.merge(select.normalized(pool, long, normalizer), theta)), seed)
    rows = select.repeat(chosen)
    if target_tokens:
        rows = select.thin(rows, target_tokens, seed)
    rows = materialize(rows.select("row_id", "copy", "domain", "tokens", "rank", "value", "weight"), "selected")
    keyed = rows.select("*", F.expr(f"row_id div {1 << 32}").alias("shard_idx"), (F.col("row_id") % (1 << 32)).alias("row_in_shard"))
    texts = shards.fetch(keyed, done.select("shard_idx", "row_in_shard", "text"))
    writers.save(texts.select("text", F.col("row_id").alias("doc_id"), "domain", F.col("rank").alias("quality_rank"), F.col("weight").alias("sampling_weight"), F.col("value").alias("sampling_value")), out)
    change = select.domain_change(pool, rows.groupBy("row_id", "domain").agg(F.count(F.lit(1)).alias("copies")))
    n = pool.count()
    k = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    return {"records": n, "selected": k[0], "tokens": k[1], "domains": json.loads(writers.summary_json(change.orderBy("domain")))}
