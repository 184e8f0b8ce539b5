"""Shards preprocessed as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmix.functions.taxonomy import domain, signals


def run(spark: SparkSession, source: str, out: str, state: str, files_per_batch: int = 1000) -> None:
    """Preprocess the raw parquet files of a folder that no earlier run with this state has taken.

    Each file is taken once: the state folder remembers it, and the sink commits a batch's files
    together, so a run that broke off can be started again. Records keep their row_in_shard. Rows
    without a domain are dropped.
    """
    raw = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    rows = raw.select("text", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("doc_char_count"), domain().alias("domain"), "shard_idx", "row_in_shard", *signals()).where("domain >= 0")
    q = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events and their values by type and hour; on a stream, hours are closed when they are `late` behind."""
    e = events.where("ts is not null")
    e = e.withWatermark("ts", late) if e.isStreaming else e
    return e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")
