"""Readers of documents in files: parquet, JSON lines, CSV and plain text.

Each gives text, domain (-1 where there is none), token_count (estimated from words where there is
none) and doc_id, with the columns found by their usual names.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmix.functions.text import doc_id, tokens_by_words

# The names a column goes by, first match wins.
TEXT_NAMES = ("text", "content", "document", "doc", "body", "sentence", "input")
DOMAIN_NAMES = ("domain", "label", "category", "domain_id")
TOKEN_NAMES = ("token_count", "tokens", "num_tokens", "length")


def pick(df: DataFrame, names: tuple[str, ...]) -> str | None:
    """The first of names among the columns, whatever the case."""
    have = {c.lower(): c for c in df.columns}
    return next((have[n] for n in names if n in have), None)


def unify(df: DataFrame, text: str | None = None, domain: str | None = None, tokens: str | None = None, limit: int | None = None) -> DataFrame:
    """text, doc_id, token_count, domain. limit takes some rows, as a reader's option for a first look."""
    text = text or pick(df, TEXT_NAMES)
    if text is None:
        raise ValueError(f"no text column among {df.columns}; name it")
    domain, tokens = domain or pick(df, DOMAIN_NAMES), tokens or pick(df, TOKEN_NAMES)
    t: Column = F.col(f"`{text}`").cast("string")
    d = F.coalesce(F.expr(f"try_cast(`{domain}` as bigint)"), F.lit(-1).cast("long")) if domain else F.lit(-1).cast("long")
    n = F.coalesce(F.expr(f"try_cast(`{tokens}` as bigint)"), tokens_by_words(t)) if tokens else tokens_by_words(t)
    out = df.select(t.alias("text"), doc_id(t).alias("doc_id"), n.alias("token_count"), d.alias("domain"))
    return out.limit(limit) if limit is not None else out


def read_parquet(spark: SparkSession, path: str, **options) -> DataFrame:
    return unify(spark.read.parquet(path), **options)


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    """One JSON object a line; blank lines are skipped. schema saves a pass over the files."""
    r = spark.read.schema(schema) if schema else spark.read
    return unify(r.json(path), **options)


def read_csv(spark: SparkSession, path: str, encoding: str = "UTF-8", sep: str | None = None, **options) -> DataFrame:
    """With a header; quoted fields may hold line ends. sep: by default a tab for files ending in .tsv, else a comma."""
    sep = sep or ("\t" if PurePosixPath(path).suffix.lower() == ".tsv" else ",")
    df = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').option("encoding", encoding).csv(path)
    return unify(df, **options)


def read_txt(spark: SparkSession, path: str, mode: str = "lines", limit: int | None = None) -> DataFrame:
    """mode 'lines': a document per line that isn't blank, trimmed; 'single': a document per file."""
    if mode not in ("lines", "single"):
        raise ValueError("mode is lines or single")
    df = spark.read.text(path, wholetext=mode == "single")
    if mode == "lines":
        df = df.select(F.trim("value").alias("value")).where("value <> ''")
    return unify(df.withColumnRenamed("value", "text"), limit=limit)


_READERS: dict[str, Callable[..., DataFrame]] = {"parquet": read_parquet, "jsonl": read_jsonl, "csv": read_csv, "txt": read_txt}
_ENDINGS = {".parquet": "parquet", ".pq": "parquet", ".jsonl": "jsonl", ".jsonlines": "jsonl", ".ndjson": "jsonl", ".json": "jsonl", ".csv": "csv", ".tsv": "csv", ".txt": "txt", ".text": "txt"}


def register(kind: str, reader: Callable[..., DataFrame], *endings: str) -> None:
    """Add a reader (spark, path, **options) under a name and file endings."""
    _READERS[kind] = reader
    for e in endings:
        _ENDINGS[e.lower()] = kind


def reader_of(path: str, kind: str | None = None) -> Callable[..., DataFrame]:
    """The reader of a kind, or else of the path's ending."""
    kind = kind or _ENDINGS.get(PurePosixPath(path).suffix.lower())
    if kind not in _READERS:
        raise ValueError(f"no reader for {path}; known kinds: {', '.join(sorted(_READERS))}")
    return _READERS[kind]


def read(spark: SparkSession, path: str, kind: str | None = None, **options) -> DataFrame:
    return reader_of(path, kind)(spark, path, **options)
