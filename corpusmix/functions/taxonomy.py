"""Domain and quality signals of raw records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmix.schema import CRITERIA, PREFIX_DOMAIN

ROOT = "$.free_decimal_correspondence.primary"


def _field(taxonomy: str, path: str) -> Column:
    """A string field of valid JSON; null for invalid JSON, a missing field or one of another type."""
    parsed = F.try_parse_json(F.col(taxonomy))
    value = F.try_variant_get(parsed, path, "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(parsed, path, "string"))


def code(taxonomy: str = "eai_taxonomy") -> Column:
    return _field(taxonomy, f"{ROOT}.code")


def labels(taxonomy: str = "eai_taxonomy") -> list[Column]:
    return [_field(taxonomy, f"{ROOT}.labels.level_{i}").alias(f"level_{i}") for i in (1, 2)]


def domain_of_code(c: Column) -> Column:
    """The domain of a code's first two characters; -1 for null, shorter and unmapped codes."""
    pairs = [x for p, d in sorted(PREFIX_DOMAIN.items()) for x in (F.lit(p), F.lit(d).cast("long"))]
    known = F.try_element_at(F.create_map(*pairs), F.substring(c, 1, 2))
    return F.when(F.length(c) >= 2, F.coalesce(known, F.lit(-1).cast("long"))).otherwise(F.lit(-1).cast("long"))


def domain(taxonomy: str = "eai_taxonomy") -> Column:
    return domain_of_code(code(taxonomy))


def signals(quality: str = "quality_signals") -> list[Column]:
    """The five signals, as floats; 0 where a level of the structure or the value is missing."""
    return [F.coalesce(F.col(f"{quality}.fasttext.{c}").cast("float"), F.lit(0).cast("float")).alias(f"qs_{c}") for c in CRITERIA]
