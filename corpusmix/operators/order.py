"""Ranks and running sums over an order, without one task per group.

A window over a whole table, or over a group that holds a third of it, runs in one task. Here the
rows are range-partitioned by (groups, order), sorted inside each partition and numbered; the
number of rows and the weight of each (partition, group) are added up, and each row's place is its
place in the partition plus what lies before the partition.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmix.shared import materialize, ship


def _running(weight: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            w = pc.fill_null(b.column(b.schema.get_field_index(weight)), 0).cast(pa.int64())
            inclusive = pc.add(pc.cumulative_sum(w), total)
            exclusive = pc.subtract(inclusive, w)
            if b.num_rows:
                total = inclusive[-1].as_py()
            yield pa.RecordBatch.from_arrays([*b.columns, exclusive], [*b.schema.names, "_cum"])

    return run


def number_rows(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[Column | str],
    weight: str | None = None,
    rank: str = "rank",
    running: str = "running",
) -> DataFrame:
    """Add the 0-based rank of each row in its group and, given weight, the weight before it.

    order: further sort keys; give a unique last key for a result that doesn't vary between runs.
    weight: a column of whole numbers, null counts as 0. groups are compared null-safe.
    The result's rows equal df's, in any order; an empty df gives an empty result. df must have no
    columns named _i, _cum, _pid or like the new ones.
    """
    ship(df.sparkSession)
    keys = [*[F.col(g) for g in groups], *[F.col(o) if isinstance(o, str) else o for o in order]]
    part = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    if weight:
        schema = T.StructType([*part.schema.fields, T.StructField("_cum", T.LongType())])
        part = part.mapInArrow(_running(weight), schema)
    part = materialize(part.withColumn("_i", F.monotonically_increasing_id()), "ordered")
    part = part.withColumn("_pid", F.shiftright("_i", 33))
    sums = [F.min("_i").alias("_first"), F.count(F.lit(1)).alias("_n")]
    if weight:
        sums += [F.min("_cum").alias("_cum0"), F.sum(F.coalesce(F.col(weight), F.lit(0))).alias("_w")]
    starts = part.groupBy("_pid", *groups).agg(*sums)
    before = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if weight:
        starts = starts.withColumn("_w_before", F.coalesce(F.sum("_w").over(before), F.lit(0)))
    # One row for each (partition, group) that occurs: at most partitions + groups rows, as ranges are contiguous.
    starts = starts.select(*[F.col(c).alias(f"_s_{c}") for c in ["_pid", *groups]], "_first", "_before", *(["_cum0", "_w_before"] if weight else []))
    on = F.col("_pid") == F.col("_s__pid")
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"_s_{g}"))
    out = part.join(starts, on)
    new = [(F.col("_before") + F.col("_i") - F.col("_first")).cast("long").alias(rank)]
    if weight:
        new.append((F.col("_w_before") + F.col("_cum") - F.col("_cum0")).cast("long").alias(running))
    return out.select(*df.columns, *new)


def quantiles(df: DataFrame, by: str, x: str, **at: float) -> DataFrame:
    """A row for each group with a column for each quantile asked for, exact, with linear interpolation.

    Nulls aren't counted; a group of nulls gives no row. Values are counted and numbered, so no task
    holds a group's values, as an exact percentile aggregate would.
    """
    counts = df.where(F.col(x).isNotNull()).groupBy(by, x).agg(F.count(F.lit(1)).alias("_n"))
    ranked = number_rows(counts, [by], [x], "_n", "_rank", "_below")
    total = ranked.groupBy(by).agg(F.sum("_n").alias("_all"))
    ranked = ranked.join(F.broadcast(total), by)
    picks = []
    for name, p in at.items():
        place = F.lit(p) * (F.col("_all") - 1)
        for end, k in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            picks.append(F.max(F.when((F.col("_below") <= k) & (k < F.col("_below") + F.col("_n")), F.col(x))).alias(f"{name}_{end}"))
    found = ranked.groupBy(by).agg(F.max("_all").alias("_all"), *picks)
    out = []
    for name, p in at.items():
        place = F.lit(p) * (F.col("_all") - 1)
        out.append((F.col(f"{name}_lo") + (F.col(f"{name}_hi") - F.col(f"{name}_lo")) * (place - F.floor(place))).alias(name))
    return found.select(by, *out)
