"""Sharded record stores: preprocessing, indexes, offsets and lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmix.functions.taxonomy import domain, signals


def shard_of_path(path: Column) -> Column:
    """The number in a file name like train-00012-of-03291.parquet or preprocessed_00012.parquet; null without one."""
    n = F.coalesce(F.nullif(F.regexp_extract(path, r"-(\d+)-of-\d+", 1), F.lit("")), F.nullif(F.regexp_extract(path, r"_(\d+)\.parquet", 1), F.lit("")))
    return n.cast("long")


def preprocess(raw: DataFrame) -> DataFrame:
    """The records with a domain: text, doc_char_count, domain, shard_idx, row_in_shard, five signals.

    row_in_shard is numbered anew from 0 within each shard, in the order of the raw rows; of rows that
    stand twice in a shard both are kept, in the order of their texts. A shard is a file of bounded size.
    """
    kept = raw.select("shard_idx", F.col("row_in_shard").alias("_row"), "text", domain().alias("domain"), *signals()).where("domain >= 0")
    order = Window.partitionBy("shard_idx").orderBy("_row", "text", "domain")
    return kept.select(
        "text", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("doc_char_count"), "domain", "shard_idx",
        (F.row_number().over(order) - 1).cast("long").alias("row_in_shard"), *[c for c in kept.columns if c.startswith("qs_")],
    )


def index(raw: DataFrame) -> DataFrame:
    """shard_idx, num_docs, num_discarded, counted from the rows themselves."""
    d = raw.select("shard_idx", (domain() >= 0).alias("ok"))
    return d.groupBy("shard_idx").agg(F.sum(F.col("ok").cast("long")).alias("num_docs"), F.sum((~F.col("ok")).cast("long")).alias("num_discarded"))


def latest(index_rows: DataFrame) -> DataFrame:
    """One row per shard of a stored index: of repeated runs the one that took longest, then the most documents."""
    w = Window.partitionBy("shard_idx").orderBy(F.desc_nulls_last("elapsed_seconds"), F.desc_nulls_last("num_docs"))
    return index_rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def disagreements(counted: DataFrame, stored: DataFrame) -> DataFrame:
    """Shards whose stored num_docs isn't what the rows give, or that only one side knows."""
    s = latest(stored).select("shard_idx", F.col("num_docs").alias("stored"))
    both = counted.select("shard_idx", F.col("num_docs").alias("counted")).join(s, "shard_idx", "full")
    return both.where(~F.col("stored").eqNullSafe(F.col("counted")))


def offsets(counted: DataFrame) -> DataFrame:
    """shard_idx, num_docs, start_idx, end_idx: each shard's stretch of the global numbers. One row per shard."""
    w = Window.orderBy("shard_idx").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("num_docs").over(w), F.lit(0)).cast("long")
    return counted.select("shard_idx", "num_docs", start.alias("start_idx")).withColumn("end_idx", F.col("start_idx") + F.col("num_docs"))


def locate(global_idx: DataFrame, spans: DataFrame) -> DataFrame:
    """shard_idx and row_in_shard of each global_idx; numbers beyond the store find nothing.

    The spans don't overlap, so the shard is the last that starts at or before the number: an as-of
    join, made by laying numbers and starts in one order within stretches of equal width.
    """
    width = 1 << 16
    s = spans.where("num_docs > 0").select("shard_idx", "start_idx", "end_idx")
    cells = F.explode(F.sequence(F.expr(f"start_idx div {width}"), F.expr(f"(end_idx - 1) div {width}")))
    s = s.withColumn("_cell", cells)
    g = global_idx.where("global_idx >= 0").withColumn("_cell", F.expr(f"global_idx div {width}"))
    hit = g.join(s, "_cell").where("start_idx <= global_idx and global_idx < end_idx")
    return hit.select("global_idx", "shard_idx", (F.col("global_idx") - F.col("start_idx")).alias("row_in_shard"))


def fetch(selected: DataFrame, docs: DataFrame, keys: tuple[str, ...] = ("shard_idx", "row_in_shard")) -> DataFrame:
    """The rows of docs for the selected keys, once for each time a key was selected."""
    return selected.join(docs, list(keys))


def pending(wanted: DataFrame, done: DataFrame, key: str = "shard_idx") -> DataFrame:
    """What is wanted and not yet done."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")
