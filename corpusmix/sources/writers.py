"""Writers of selected records."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from corpusmix.operators.order import number_rows


def save(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite") -> None:
    """parquet, jsonl, csv (with header, quoted) or txt (the column text)."""
    w = df.write.mode(mode)
    if kind == "parquet":
        w.parquet(path)
    elif kind == "jsonl":
        w.json(path)
    elif kind == "csv":
        w.option("header", True).option("escape", '"').csv(path)
    elif kind == "txt":
        df.select(F.regexp_replace("text", r"[\r\n]+", " ").alias("value")).write.mode(mode).text(path)
    else:
        raise ValueError("kind is parquet, jsonl, csv or txt")


def shards(df: DataFrame, key: str, per_shard: int) -> DataFrame:
    """Add shard: rows in the order of key, per_shard to each; the last one, kept for validation, may hold fewer."""
    n = number_rows(df, [], [key], rank="_n")
    return n.withColumn("shard", F.expr(f"_n div {int(per_shard)}")).drop("_n")


def save_shards(df: DataFrame, key: str, path: str, per_shard: int) -> None:
    """One folder per shard, shard=N, of text only."""
    shards(df, key, per_shard).select("shard", "text").repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)


#: Rows of a result that goes through the driver.
SMALL = 1000


def small(df: DataFrame) -> list[Row]:
    """All rows of a result of at most SMALL rows; a larger one isn't cut but refused."""
    rows = df.limit(SMALL + 1).collect()
    if len(rows) > SMALL:
        raise ValueError(f"more than {SMALL} rows: write the table with save instead")
    return rows


def summary_json(df: DataFrame) -> str:
    """A small result as JSON text; ValueError beyond SMALL rows."""
    return json.dumps([json.loads(r[0]) for r in small(df.select(F.to_json(F.struct("*"))))], ensure_ascii=False, indent=1)


def report(title: str, tables: dict[str, DataFrame]) -> str:
    """Small results as a Markdown text; ValueError beyond SMALL rows of a table."""
    lines = [f"# {title}", ""]
    for name, df in tables.items():
        lines += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        lines += ["| " + " | ".join("" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v) for v in r) + " |" for r in small(df)]
        lines.append("")
    return "\n".join(lines)
