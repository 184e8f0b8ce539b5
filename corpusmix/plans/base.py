"""Inputs that many queries start from, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmix.schema import DOMAINS, PREFIX_DOMAIN

Q = ("q0", "q1", "q2", "q3", "q4")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def finite(x: Column) -> Column:
    """A score, 0 where it is null, NaN or infinite."""
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x + 0.0).otherwise(0.0)


def pool(spark: SparkSession, sf_dir: str, *also: str) -> DataFrame:
    """Records with a domain of 0 to 21: row_id, domain, tokens (a quarter of the characters, at least 1), q0..q4."""
    scores = [finite(F.try_element_at("quality_scores", F.lit(i + 1))).alias(q) for i, q in enumerate(Q)]
    tokens = F.greatest(F.lit(1).cast("long"), F.expr("coalesce(length(text), 0) div 4")).alias("tokens")
    return table(spark, sf_dir, "unified_data").where(F.col("domain").between(0, DOMAINS - 1)).select("row_id", "domain", tokens, *scores, *also)


def _finite_sql(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR isnan({x}) OR isinf({x}) THEN 0.0::double ELSE {x} END"


POOL = (
    "pool AS (SELECT row_id, domain, greatest(1, coalesce(length(text), 0) // 4)::bigint AS tokens, text, "
    + ", ".join(f"{_finite_sql(f'quality_scores[{i + 1}]')} AS {q}" for i, q in enumerate(Q))
    + f" FROM unified_data WHERE domain BETWEEN 0 AND {DOMAINS - 1})"
)


def long(df: DataFrame, *keep: str) -> DataFrame:
    """A row for each record and criterion: criterion (0 to 4) and x."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("criterion"), F.col(q).alias("x")) for i, q in enumerate(Q)]))
    return df.select(*keep, each.alias("_e")).select(*keep, "_e.criterion", "_e.x")


LONG = "long AS (" + " UNION ALL ".join(f"SELECT row_id, domain, tokens, {i} AS criterion, {q} AS x FROM pool" for i, q in enumerate(Q)) + ")"

DOMAIN_CASE = "CASE substr(code, 1, 2) " + " ".join(f"WHEN '{p}' THEN {d}" for p, d in sorted(PREFIX_DOMAIN.items())) + " ELSE -1 END"


def _json_sql(path: str) -> str:
    full = f"$.free_decimal_correspondence.primary.{path}"
    return f"CASE WHEN json_valid(eai_taxonomy) AND json_type(eai_taxonomy, '{full}') = 'VARCHAR' THEN json_extract_string(eai_taxonomy, '{full}') END"


RAW = f"""coded AS (SELECT *, {_json_sql('code')} AS code, {_json_sql('labels.level_1')} AS level_1, {_json_sql('labels.level_2')} AS level_2 FROM raw_shard),
 raw AS (SELECT *, CASE WHEN length(code) >= 2 THEN {DOMAIN_CASE} ELSE -1 END::bigint AS domain FROM coded)"""
