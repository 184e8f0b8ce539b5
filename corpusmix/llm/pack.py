"""Problem 2: filling sequences of a fixed capacity with whole records.

How many records there are of each size is a table of at most capacity rows, whatever the corpus.
The packing is planned on it: sizes above a third of the capacity are matched, the largest with the
largest that still fits, so at most two of them share a sequence; smaller sizes then fill the
tightest gaps, largest first. A plan line says which records of a size, by their place among that
size, go to which sequences; records find theirs by a join, in parallel.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmix.llm.common import SIZE_SQL, record_size, table
from corpusmix.operators.order import number_rows
from corpusmix.shared import materialize

PLAN = "_pack string, _size long, _from long, _to long, _bin long, _each long"


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Lines (size, from, to, bin, each) and the number of bins.

    The records of a size whose place is in from..to-1 go to bins bin, bin + 1, ..., each of them
    taking `each` records. counts: by size, from 1 to capacity.
    """
    lines: list[tuple[int, int, int, int, int]] = []
    left, used = dict(counts), defaultdict(int)
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> (first bin, bins)
    bins = 0

    def place(size: int, first: int, n: int, each: int) -> None:
        lines.append((size, used[size], used[size] + n * each, first, each))
        used[size] += n * each

    large = sorted(s for s in counts if 3 * s > capacity)
    while large:
        s = large[-1]
        if not left[s]:
            large.pop()
            continue
        k = bisect.bisect_right(large, capacity - s) - 1
        while k >= 0 and not left[large[k]]:
            large.pop(k)
            k -= 1
        t = large[k] if k >= 0 else 0
        n = left[s] if not t else left[s] // 2 if t == s else min(left[s], left[t])
        if t == s and not n:  # one is left of a size that fits twice: it takes the next smaller one, if any
            k -= 1
            while k >= 0 and not left[large[k]]:
                large.pop(k)
                k -= 1
            t = large[k] if k >= 0 else 0
            n = min(left[s], left[t]) if t else left[s]
        if t == s:
            place(s, bins, n, 2)
            left[s] -= 2 * n
        else:
            place(s, bins, n, 1)
            left[s] -= n
            if t:
                place(t, bins, n, 1)
                left[t] -= n
        gaps[capacity - s - t].append((bins, n))
        bins += n
    open_gaps = sorted(g for g in gaps if g)
    for s in sorted((s for s in counts if 3 * s <= capacity), reverse=True):
        while left[s]:
            k = bisect.bisect_left(open_gaps, s)
            if k == len(open_gaps):  # no gap takes it: new bins
                each = capacity // s
                new = -(-left[s] // each)
                gaps[capacity].append((bins, new))
                open_gaps.append(capacity)
                bins += new
            g = open_gaps[k]
            each = g // s
            first, n = gaps[g].pop()
            if not gaps[g]:
                open_gaps.pop(k)
            take = min(n, left[s] // each)
            rest: list[tuple[int, int, int]] = []
            if take:
                place(s, first, take, each)
                left[s] -= take * each
                rest.append((g - each * s, first, take))
            if take < n:
                if left[s] and left[s] < each:
                    few = left[s]
                    place(s, first + take, 1, few)
                    left[s] = 0
                    rest.append((g - few * s, first + take, 1))
                    take += 1
                if take < n:
                    rest.append((g, first + take, n - take))
            for gap, b, m in rest:
                if gap:
                    if not gaps[gap]:
                        bisect.insort(open_gaps, gap)
                    gaps[gap].append((b, m))
    return lines, bins


def pieces(records: DataFrame, specs: DataFrame) -> DataFrame:
    """pack_id, bin, row_id, piece, pieces, tokens: where each record, or piece of one, goes.

    records: row_id (unique), text, token_count; a record's size is record_size. specs: pack_id,
    capacity; a row with a null or a capacity below 1 is left out, equal rows count once and of
    different capacities for a pack_id the largest counts. A record larger than the capacity is cut
    into full sequences of its own and a rest that is packed like any record. Records are placed by
    (size, row_id), so the result is the same on every run. Empty tables give no rows.
    """
    spark = records.sparkSession
    packs = dict(specs.where("pack_id is not null and capacity >= 1").groupBy("pack_id").agg(F.max("capacity")).collect())
    # Texts are read once, for their length.
    sized = materialize(records.select(F.col("row_id").alias("_row"), record_size().alias("_n")), "sizes")
    cut = F.explode(F.array(*[F.struct(F.lit(p).alias("_pack"), F.lit(c).cast("long").alias("_cap")) for p, c in sorted(packs.items())] or [F.expr("named_struct('_pack', cast(null as string), '_cap', 1L)")]))
    every = sized.select("_row", "_n", cut.alias("_x")).select("_row", "_n", "_x._pack", "_x._cap").where("_pack is not null")
    every = every.withColumn("_whole", F.when(F.col("_n") > F.col("_cap"), F.expr("_n div _cap")).otherwise(0)).withColumn("_size", F.col("_n") - F.col("_whole") * F.col("_cap"))
    # Records in the order of their size, once for all capacities: the place among a size follows from (size, row_id).
    rest = number_rows(every.where("_size > 0").select("_pack", "_size", "_row", "_whole"), ["_pack", "_size"], ["_row"], rank="_place")
    counts: dict[str, dict[int, int]] = {p: {} for p in packs}
    # At most capacity rows for each capacity.
    for p, s, n in rest.groupBy("_pack", "_size").agg(F.count(F.lit(1))).collect():
        counts[p][s] = n
    lines, ends = [], {}
    for p, c in packs.items():
        found, ends[p] = plan(counts[p], c)
        lines += [(p, *x) for x in found]
    planned = F.broadcast(spark.createDataFrame(lines, PLAN)) if lines else spark.createDataFrame([], PLAN)
    placed = rest.join(planned, ["_pack", "_size"]).where("_from <= _place and _place < _to")
    placed = placed.select(
        F.col("_pack").alias("pack_id"), (F.col("_bin") + F.expr("(_place - _from) div _each")).alias("bin"), F.col("_row").alias("row_id"),
        (F.col("_whole") + 1).alias("piece"), (F.col("_whole") + 1).alias("pieces"), F.col("_size").alias("tokens"),
    )
    full = number_rows(every.where("_whole > 0").select("_pack", "_row", "_whole", "_size", "_cap"), ["_pack"], ["_row"], "_whole", "_nth", "_bins")
    end = F.create_map(*[x for p in ends for x in (F.lit(p), F.lit(ends[p]))]) if ends else F.expr("map('', 0)")
    full = full.withColumn("_piece", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_whole")))).select(
        F.col("_pack").alias("pack_id"), (F.try_element_at(end, F.col("_pack")) + F.col("_bins") + F.col("_piece") - 1).cast("long").alias("bin"), F.col("_row").alias("row_id"),
        F.col("_piece").alias("piece"), (F.col("_whole") + F.when(F.col("_size") > 0, 1).otherwise(0)).alias("pieces"), F.col("_cap").alias("tokens"),
    )
    return placed.unionByName(full)


def sequences(placed: DataFrame, specs: DataFrame) -> DataFrame:
    """pack_id, bin, row_ids (ascending), tokens, fill: one row per sequence, of at most capacity records."""
    capacity = specs.where("pack_id is not null and capacity >= 1").groupBy("pack_id").agg(F.max("capacity").alias("_cap"))
    bins = placed.groupBy("pack_id", "bin").agg(F.array_sort(F.collect_list("row_id")).alias("row_ids"), F.sum("tokens").alias("tokens"))
    return bins.join(capacity, "pack_id").select("pack_id", "bin", "row_ids", "tokens", (F.col("tokens") / F.col("_cap")).alias("fill"))


def p2_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = table(spark, sf_dir, "pack_specs")
    return sequences(pieces(table(spark, sf_dir, "unified_data"), specs), specs)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that had to be divided, from the packing itself."""
    placed = pieces(table(spark, sf_dir, "unified_data"), table(spark, sf_dir, "pack_specs"))
    return placed.where("pieces > 1").select("pack_id", "row_id").distinct()


QUERIES = {"p2_sequences": p2_sequences, "p2_found": p2_found}
SQL = {"p2_found": f"SELECT DISTINCT pack_id, row_id FROM unified_data, pack_specs WHERE ({SIZE_SQL}) > capacity"}
