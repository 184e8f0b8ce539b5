"""Column expressions shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOMAINS = 22


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def estimate(text: str = "text") -> Column:
    """greatest(1, length div 4); a null text counts as length 0."""
    return F.greatest(F.lit(1).cast("long"), F.expr(f"coalesce(length(`{text}`), 0) div 4"))


def distrusted(text: str = "text", token_count: str = "token_count") -> Column:
    """Whether a token count is null, below 1, or off the estimate by more than three times."""
    n, e = F.col(token_count), estimate(text)
    return n.isNull() | (n < 1) | (n > 3 * e) | (n * 3 < e)


def record_size(text: str = "text", token_count: str = "token_count") -> Column:
    """A record's size in tokens: its token_count, or the estimate where that is distrusted."""
    return F.when(distrusted(text, token_count), estimate(text)).otherwise(F.col(token_count)).cast("long")


SIZE_SQL = """CASE WHEN token_count IS NULL OR token_count < 1 OR token_count > 3 * greatest(1, coalesce(length(text), 0) // 4)
 OR token_count * 3 < greatest(1, coalesce(length(text), 0) // 4) THEN greatest(1, coalesce(length(text), 0) // 4) ELSE token_count END"""


def clean_source(source: str = "source") -> Column:
    """A source's one spelling: lower case, no outer blanks, hyphens; 'unknown' for null or blank."""
    s = F.regexp_replace(F.lower(F.trim(F.col(source))), "_", "-")
    return F.when(s.isNull() | (s == ""), F.lit("unknown")).otherwise(s)


def clean_lang(lang: str = "lang") -> Column:
    """A language's one spelling: lower case, no region; 'und' for null or blank."""
    s = F.split(F.lower(F.trim(F.col(lang))), "[-_]").getItem(0)
    return F.when(s.isNull() | (s == ""), F.lit("und")).otherwise(s)


SOURCE_SQL = "coalesce(nullif(replace(lower(trim(source)), '_', '-'), ''), 'unknown')"
LANG_SQL = "coalesce(nullif(regexp_extract(lower(trim(lang)), '^[^-_]*'), ''), 'und')"
