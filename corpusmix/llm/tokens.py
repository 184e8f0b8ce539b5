"""Problem 5: tokens of each record under a public tokenizer, and totals by source, language and domain.

Each task keeps the distinct pre-split pieces of its records as symbol arrays and merges them
together in rounds, so a piece is merged once however often it occurs. Nothing but the sums of each
slice is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmix.llm.bpe import DEFAULT_PATH, Bpe, Rounds, split
from corpusmix.llm.common import clean_lang, clean_source, distrusted, estimate, record_size, table
from corpusmix.shared import ship, spread

#: Distinct pieces a task holds; beyond it they are forgotten and merged anew where they recur.
HELD = 1 << 20
#: Characters of a piece beyond which it goes through the transducer of bpe.py.
LONG = 256


def tokens(records: DataFrame, path: str = DEFAULT_PATH) -> DataFrame:
    """row_id, source, lang, domain, token_count, estimate, distrusted, size, tokens of each row.

    tokens: how many ids the tokenizer gives the text, 0 for a null or empty one. estimate: a
    quarter of its characters, at least 1. distrusted: whether token_count is null or doesn't fit
    the estimate; size: the estimate then, else token_count. source and lang are in their one
    spelling, 'unknown' and 'und' for null; domain stays as it is. Repeated rows each count; other
    columns are ignored; an empty table gives no rows.
    """
    ship(records.sparkSession)
    shared = records.sparkSession.sparkContext.broadcast(Bpe.from_json(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rounds, held = Rounds(shared.value), {}
        for b in batches:
            column = b.column(b.num_columns - 1)
            pieces = [split(t) if (t := x.as_py()) else () for x in column]
            if len(held) > HELD:
                held.clear()
            new = list(set().union(*pieces).difference(held))
            # Rounds over all pieces are as many as the longest one needs: pieces beyond the window are streamed.
            long = [p for p in new if len(p) > LONG]
            held.update((p, len(shared.value.piece(p))) for p in long)
            new = [p for p in new if len(p) <= LONG]
            if new:
                held.update(zip(new, rounds.counts([p.encode("utf-8", "replace") for p in new]).tolist()))
            get = held.__getitem__
            counts = pa.array([sum(map(get, p)) for p in pieces], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], counts], [*b.schema.names[:-1], "tokens"])

    rows = records.select(
        "row_id", clean_source().alias("source"), clean_lang().alias("lang"), "domain", "token_count", estimate().alias("estimate"),
        distrusted().alias("distrusted"), record_size().alias("size"), F.expr("make_valid_utf8(text)").alias("_text"),
    )
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return spread(rows).mapInArrow(run, f"{schema}, tokens bigint")


def budget(counted: DataFrame) -> DataFrame:
    """Totals of each (source, lang, domain): records, tokens, sizes and how many counts were distrusted."""
    return counted.groupBy("source", "lang", "domain").agg(
        F.count(F.lit(1)).alias("records"), F.sum("tokens").alias("tokens"), F.sum("size").alias("size"), F.sum(F.col("distrusted").cast("long")).alias("distrusted")
    )


def p5_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget(tokens(table(spark, sf_dir, "unified_data")))


def p5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(table(spark, sf_dir, "unified_data")).select("row_id", "tokens", "size")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(table(spark, sf_dir, "unified_data")).where("distrusted").select("row_id").distinct()


QUERIES = {"p5_budget": p5_budget, "p5_tokens": p5_tokens, "p5_found": p5_found}
_E = "greatest(1, coalesce(length(text), 0) // 4)"
SQL = {"p5_found": f"SELECT row_id FROM unified_data WHERE token_count IS NULL OR token_count < 1 OR token_count > 3 * {_E} OR token_count * 3 < {_E}"}
