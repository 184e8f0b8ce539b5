"""Rows of tokens for training: laying documents end to end, packing them, and looking into the rows."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmix.operators.order import number_rows
from corpusmix.shared import ship

def lay(docs: DataFrame, key: str, tokens: str, size: int, begin: str = "<begin>") -> DataFrame:
    """key, row, place, token: every document's tokens behind a begin mark, end to end, cut into rows of size.

    tokens: array<string>. The last row may be shorter.
    """
    d = docs.select(key, F.concat(F.array(F.lit(begin)), F.coalesce(tokens, F.array())).alias("_t")).withColumn("_n", F.size("_t"))
    n = number_rows(d, [], [key], "_n", "_k", "_start")
    e = n.select(key, "_start", F.posexplode("_t").alias("_p", "token")).withColumn("_at", F.col("_start") + F.col("_p"))
    return e.select(key, F.expr(f"_at div {size}").alias("row"), (F.col("_at") % size).cast("int").alias("place"), "token")


def row_stats(laid: DataFrame, begin: str = "<begin>") -> DataFrame:
    """row, tokens, distinct_tokens, longest_run (of equal tokens), documents (that begin in it). A row is of bounded size."""
    w = Window.partitionBy("row").orderBy("place")
    new = laid.withColumn("_new", F.when(F.lag("token").over(w).eqNullSafe(F.col("token")), 0).otherwise(1))
    run = new.withColumn("_run", F.sum("_new").over(w)).groupBy("row", "_run").agg(F.count(F.lit(1)).alias("_len"), F.first("token").alias("token"))
    a = run.groupBy("row").agg(F.sum("_len").alias("tokens"), F.countDistinct("token").alias("distinct_tokens"), F.max("_len").alias("longest_run"))
    b = laid.groupBy("row").agg(F.count(F.when(F.col("token") == begin, 1)).alias("documents"))
    return a.join(b, "row")


def top_tokens(laid: DataFrame, k: int = 5) -> DataFrame:
    """row, place, token, n of the k most frequent tokens of each row, ties by token."""
    n = laid.groupBy("row", "token").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("row").orderBy(F.desc("n"), "token")
    return n.select("row", F.row_number().over(w).cast("long").alias("place"), "token", "n").where(F.col("place") <= k)


def only_in(a: DataFrame, b: DataFrame, token: str = "token") -> DataFrame:
    """Distinct tokens of a that b lacks."""
    return a.select(token).distinct().join(b.select(token).distinct(), token, "left_anti")


def reader_stats(docs: DataFrame, reader: str, length: str, size: int) -> DataFrame:
    """Documents, tokens, mean, least, most and deviation of lengths, and those longer than two rows, by reader."""
    n = F.col(length)
    return docs.groupBy(reader).agg(F.count(F.lit(1)).alias("docs"), F.sum(n).alias("tokens"), F.avg(n).alias("mean"), F.min(n).alias("least"), F.max(n).alias("most"), F.stddev_pop(n).alias("std"), F.count(F.when(n > 2 * size, 1)).alias("long_docs"))


def best_fit(docs: DataFrame, key: str, length: str, readers: int, size: int, buffer: int = 256) -> DataFrame:
    """key, reader, row, used: documents packed into rows of size + 1 as a training reader does.

    Every reader takes every readers-th document, in the order of key. It holds `buffer` documents; a
    row takes the longest that fits, again and again, and when none fits, the shortest, of which it
    uses what fills the row. A document's length counts a begin mark too. Nulls and lengths below 0
    count as 0. The last row of a reader may be left with room. What a reader takes depends on all it
    took before, so a reader is one task, which streams keys and lengths and holds only its buffer.
    """
    ship(docs.sparkSession)
    d = docs.select(F.col(key).alias("_key"), (F.greatest(F.coalesce(F.col(length), F.lit(0)), F.lit(0)) + 1).cast("long").alias("_len"))
    n = number_rows(d, [], ["_key"], rank="_i").select("_key", "_len", "_i", (F.col("_i") % readers).cast("int").alias("reader"))
    schema = T.StructType([d.schema["_key"], T.StructField("reader", T.IntegerType()), T.StructField("row", T.LongType()), T.StructField("used", T.LongType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, object]] = []  # length, minus the place, key: sorted
        reader, row, room = None, 0, size + 1
        out: list[tuple] = []

        def take() -> None:
            nonlocal row, room
            i = bisect.bisect_right(held, (room, 1)) - 1
            if i < 0:
                i = bisect.bisect_right(held, (held[0][0], 1)) - 1
            n, _, k = held.pop(i)
            used = min(n, room)
            out.append((k, reader, row, used))
            room -= used
            if room == 0:
                row, room = row + 1, size + 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [[], [], [], []]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, pa.int32(), pa.int64(), pa.int64()))], ["_key", "reader", "row", "used"])

        kind = pa.null()
        for b in batches:
            kind = b.schema.field(0).type
            for k, n, i, r in zip(*(c.to_pylist() for c in b.columns)):
                if r != reader:
                    while held:
                        take()
                    reader, row, room = r, 0, size + 1
                if len(held) == buffer:
                    take()
                bisect.insort(held, (n, -i, k))
            yield flush()
        while held:
            take()
        if out:
            yield flush()

    own = n.repartition(readers, "reader").sortWithinPartitions("reader", "_i")
    return own.mapInArrow(pack, schema).withColumnRenamed("_key", key)


def decode_rows(laid: DataFrame, begin: str = "<begin>") -> DataFrame:
    """row, part, tokens, text: each row cut at its begin marks, the marks left out. Part 0 continues the row before."""
    w = Window.partitionBy("row").orderBy("place")
    p = laid.withColumn("part", F.sum((F.col("token") == begin).cast("int")).over(w).cast("int")).where(F.col("token") != begin)
    g = p.groupBy("row", "part").agg(F.array_sort(F.collect_list(F.struct("place", "token"))).alias("_t"))  # a row is of bounded size
    return g.select("row", "part", F.size("_t").alias("tokens"), F.array_join(F.transform("_t", lambda x: x["token"]), " ").alias("text"))
