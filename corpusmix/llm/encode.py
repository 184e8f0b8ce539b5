"""Problem 7: the ids of every document under a public byte-level tokenizer."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmix.llm.bpe import DEFAULT_PATH, Bpe, Decoder, Memo, split
from corpusmix.llm.common import table
from corpusmix.shared import ship, spread

_memos: dict[int, Memo] = {}


def _memo(shared) -> Memo:
    """One for each worker process and broadcast merge list."""
    if shared.value is not (next(iter(_memos.values())).bpe if _memos else None):
        _memos.clear()
        _memos[0] = Memo(shared.value)
    return _memos[0]


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str = DEFAULT_PATH) -> DataFrame:
    """key and ids (array<int>) of each row.

    Null and empty texts give an empty list; marker strings of the tokenizer are ordinary text;
    bytes that aren't UTF-8 count as U+FFFD. Rows stay as they are, repeated and null keys too;
    other columns are ignored; an empty table gives no rows. path: the tokenizer's JSON file, read
    by the driver; the merge list, of fixed size, is broadcast.
    """
    ship(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(Bpe.from_json(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = _memo(shared).__getitem__
        for b in batches:
            flat, ends = array("i"), [0]
            for text in b.column(1):
                text = text.as_py()
                if text:
                    flat.extend(chain.from_iterable(map(get, split(text))))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, dtype=np.int32) if flat else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], ["_key", "ids"])

    rows = documents.select(F.col(key).alias("_key"), F.expr(f"make_valid_utf8(`{text}`)").alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()
    return spread(rows).mapInArrow(run, f"_key {kind}, ids array<int>").select(F.col("_key").alias(key), "ids")


def decode(encoded: DataFrame, key: str = "doc_id", path: str = DEFAULT_PATH) -> DataFrame:
    """key and text of rows of encode; a null list gives a null text."""
    ship(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(Bpe.from_json(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for ids in b.column(1):
                d = Decoder(shared.value)
                texts.append(d.feed(ids.as_py()) + d.end() if ids.is_valid else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["_key", "text"])

    rows = encoded.select(F.col(key).alias("_key"), "ids")
    kind = rows.schema["_key"].dataType.simpleString()
    return rows.mapInArrow(run, f"_key {kind}, text string").select(F.col("_key").alias(key), "text")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


def p7_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, and the length of the text that decoding its ids gives."""
    return decode(p7_ids(spark, sf_dir)).select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("md5"))


QUERIES = {"p7_ids": p7_ids, "p7_round_trip": p7_round_trip}
SQL = {"p7_round_trip": "SELECT doc_id, length(coalesce(text, '')) AS n_chars, md5(coalesce(text, '')) AS md5 FROM documents"}
