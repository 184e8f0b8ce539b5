"""Problem 3: records that are edited copies of each other.

Similarity is the Jaccard index of the sets of word runs (shingles). The join is exact: all sets are
ordered by one global order of the shingles, rare ones first, and a pair at or above the threshold
must share MATCHES shingles early in that order, within the first part of either set. Those parts
are indexed and joined, and every pair that meets the count is verified on the whole sets. The order
comes from counts of all shingles in a table of fixed size, so any error in them costs time only.

Sets, postings and pairs travel as packed arrays, a few bytes for each entry, not as rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmix.llm.common import table
from corpusmix.llm.words import WordHashes, mix64, runs, words
from corpusmix.shared import materialize, release, ship, spread

RUN, LEAST_WORDS, THRESHOLD = 3, 40, 0.5
#: Shingles that a similar pair shares early in the order; longer parts of sets are indexed for more.
MATCHES = 4
#: Bits of a shingle's hash, and the records that are sorted together with it in 64 bits.
BITS, TOGETHER = 48, 256
#: Counters of shingles, as powers of two: a quarter as many as there are shingles, within these bounds. A byte for each
#: is broadcast, 16 MB at most.
FEWEST, MOST = 18, 24
#: Postings for each group of the joins, and postings of one shingle beyond which it is split.
GROUP, HOT = 1 << 20, 4096
#: Pairs of a group that are held before they are counted and packed, and splits of a class of equal sets in a join.
PAIRS, SPLITS = 1 << 22, 16
#: Bits of the filter of the records to verify, as a power of two, and of those that one group of it holds.
FILTER, PART = 24, 18


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed block; each is stored by the bytes of its values, first all lowest bytes."""
    parts = []
    for a in arrays:
        raw = np.ascontiguousarray(a)
        planes = raw.view(np.uint8).reshape(-1, raw.itemsize).T.tobytes()
        z = pa.compress(planes, codec="zstd", asbytes=True) if planes else b""
        parts.append(len(raw).to_bytes(8, "little") + len(z).to_bytes(8, "little") + raw.dtype.char.encode() + z)
    return b"".join(parts)


def unpack(block: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(block):
        n, size, kind = int.from_bytes(block[at : at + 8], "little"), int.from_bytes(block[at + 8 : at + 16], "little"), np.dtype(block[at + 16 : at + 17].decode())
        at += 17
        planes = pa.decompress(block[at : at + size], n * kind.itemsize, codec="zstd", asbytes=True) if n else b""
        out.append(np.frombuffer(np.frombuffer(planes, dtype=np.uint8).reshape(kind.itemsize, -1).T.tobytes(), dtype=kind) if n else np.zeros(0, dtype=kind))
        at += size
    return out


def segments(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for sizes[0] entries, then the next ones."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes - starts, sizes)


def _sets(run: int, least: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 1 << 14):
                b = whole.slice(at, 1 << 14)
                lists = [words(t.as_py()) for t in b.column(1)]
                lists = [w if len(w) >= max(run, least) else [] for w in lists]
                flat, starts = known.of(lists)
                h = runs(flat, run) >> np.uint64(64 - BITS)
                of = np.repeat(np.arange(len(lists), dtype=np.uint64), np.diff(starts))
                inside = of[: len(h)] == of[run - 1 :] if len(h) else np.zeros(0, dtype=bool)
                both = np.unique(of[: len(h)][inside] << np.uint64(BITS) | h[inside])
                rec, sh = (both >> np.uint64(BITS)).astype(np.int64), both & np.uint64((1 << BITS) - 1)
                n = np.bincount(rec, minlength=len(lists))
                ends = np.cumsum(n)
                keep = np.flatnonzero(n)
                data = memoryview(sh).cast("B")
                same = [xxhash.xxh64_intdigest(data[8 * (ends[i] - n[i]) : 8 * ends[i]]) - (1 << 63) for i in keep]
                # Sorted sets are stored as differences, six bytes each.
                diff = np.diff(sh, prepend=np.uint64(0))
                first = ends[keep] - n[keep]
                diff[first] = sh[first]
                small = np.ascontiguousarray(diff.view(np.uint8).reshape(-1, 8)[:, : BITS // 8])
                sets = pa.Array.from_buffers(pa.binary(), len(keep), [None, pa.py_buffer(np.r_[0, BITS // 8 * ends[keep]].astype(np.int32)), pa.py_buffer(small)])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), pa.array(n[keep], pa.int32()), pa.array(same, pa.int64()), sets], ["row_id", "n", "same", "shingles"])

    return make


def _unset(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of a batch in one array, and where each set starts."""
    if not len(column):
        return np.zeros(0, dtype=np.uint64), np.zeros(1, dtype=np.int64)
    wide = pa.types.is_large_binary(column.type)
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]].reshape(-1, BITS // 8)
    diff = np.zeros((len(data), 8), dtype=np.uint8)
    diff[:, : BITS // 8] = data
    starts = (ends - ends[0]) // (BITS // 8)
    total = np.cumsum(diff.reshape(-1).view(np.uint64), dtype=np.uint64)
    before = np.r_[np.uint64(0), total][starts[:-1]]
    return total - np.repeat(before, np.diff(starts)), starts


_HALF = np.uint64(BITS // 2)


def turn(shingles: np.ndarray) -> np.ndarray:
    """The halves of a shingle exchanged: an order that has nothing to do with the groups, which go by the first half."""
    return (shingles & np.uint64((1 << BITS // 2) - 1)) << _HALF | shingles >> _HALF


def _cell(shingles: np.ndarray, counters: int) -> np.ndarray:
    return (shingles * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - counters)).astype(np.int64)


def _count(counters: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << counters, dtype=np.uint32)
        for b in batches:
            np.add.at(total, _cell(_unset(b.column(0))[0], counters), 1)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), pa.array([pack(x.astype(np.int64)) for x in total.reshape(64, -1)], pa.binary())], ["block", "counts"])

    return make


def _sum(group: pa.Table) -> pa.Table:
    total = None
    for x in group.column("counts"):
        own = unpack(x.as_py())[0]
        total = own if total is None else total + own
    return pa.table({"block": group.column("block")[:1].cast(pa.int32()), "counts": pa.array([pack(total)], pa.binary())})


def _add(group: pa.Table) -> pa.Table:
    total = unpack(_sum(group).column("counts")[0].as_py())[0]
    # Eighths of powers of two are enough for an order; 0 and 1 stay apart.
    level = np.where(total > 1, np.minimum(255, 1 + np.ceil(8 * np.log2(np.maximum(total, 1)))), total).astype(np.uint8)
    return pa.table({"block": group.column("block")[:1].cast(pa.int32()), "levels": pa.array([level.tobytes()], pa.binary())})


def _levels(own: DataFrame, counters: int) -> bytes:
    """A level for each counter. Blocks of all tasks are added in two steps, each of about the root of their number."""
    tasks = own.rdd.getNumPartitions()
    parts = own.select("shingles").mapInArrow(_count(counters), "block int, counts binary").withColumn("_some", F.spark_partition_id() % max(1, round(tasks**0.5)))
    some = parts.groupBy("block", "_some").applyInArrow(_sum, "block int, counts binary")
    rows = dict(some.groupBy("block").applyInArrow(_add, "block int, levels binary").collect())
    return b"".join(rows.get(i, b"\0" * ((1 << counters) // 64)) for i in range(64))


def _postings(levels, counters: int, mean: float, groups: int, threshold: float):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(levels.value, dtype=np.uint8)
        for b in batches:
            sh, starts = _unset(b.column(2))
            n = np.diff(starts)
            rows = b.column(0).to_numpy()
            of = np.repeat(np.arange(len(n)), n)
            lv = level[_cell(sh, counters)]
            # One number for record, level and shingle: sorting it orders each set, and keeps all three.
            key = (of % TOGETHER).astype(np.uint64) << np.uint64(56) | lv.astype(np.uint64) << np.uint64(BITS) | turn(sh)
            for x in range(0, len(n), TOGETHER):
                key[starts[x] : starts[min(x + TOGETHER, len(n))]].sort()
            lv = (key >> np.uint64(BITS)).astype(np.uint8)
            sh = turn(key & np.uint64((1 << BITS) - 1))
            place = segments(np.zeros(len(n), dtype=np.int64), n)
            # A partner has at least threshold * n shingles in common.
            first = np.minimum(n, n - np.ceil(threshold * n - 1e-9).astype(np.int64) + MATCHES)
            use = (place < first[of]) & (lv > 1)
            sh, lv, place, of = sh[use], lv[use], place[use], of[use]
            group, token, side = ((sh >> _HALF) * np.uint64(groups) >> _HALF).astype(np.int64), sh.astype(np.uint32), np.zeros(len(sh), dtype=np.uint8)
            # A counter holds other shingles too, as many as the mean; what it has beyond them may be one frequent shingle.
            splits = np.maximum(1, np.ceil((2.0 ** ((lv.astype(np.float64) - 1) / 8) - mean) / HOT)).astype(np.int64)
            hot = np.flatnonzero(splits > 1)
            if len(hot):
                # A frequent shingle's records are dealt to splits; each two splits meet in a group of their own.
                rest = splits <= 1
                own = (mix64(rows[of[hot]].astype(np.uint64)) % splits[hot].astype(np.uint64)).astype(np.int64)
                each = splits[hot]
                other = segments(np.zeros(len(hot), dtype=np.int64), each)
                i = np.repeat(hot, each)
                mine = np.repeat(own, each)
                lo, hi = np.minimum(mine, other), np.maximum(mine, other)
                part = mix64(sh[i] ^ mix64((lo * (1 << 31) + hi).astype(np.uint64)))
                group = np.r_[group[rest], ((part >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)]
                token = np.r_[token[rest], part.astype(np.uint32)]
                side = np.r_[side[rest], np.where(mine == other, 0, np.where(mine == lo, 1, 2)).astype(np.uint8)]
                place, of = np.r_[place[rest], place[i]], np.r_[of[rest], of[i]]
            order = np.lexsort((rows[of], group))
            token, side, place, of, group = token[order], side[order], place[order], of[order], group[order]
            ends = np.flatnonzero(np.r_[group[1:] != group[:-1], True]) + 1 if len(group) else np.zeros(0, dtype=np.int64)
            begin, ids, blocks = 0, [], []
            for end in ends:
                o = of[begin:end]
                new = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
                recs = o[new]
                blocks.append(pack(np.diff(rows[recs], prepend=0), n[recs].astype(np.uint32), np.diff(np.r_[new, len(o)]).astype(np.uint32), token[begin:end].astype(np.uint32), place[begin:end].astype(np.uint32), side[begin:end]))
                ids.append(group[begin])
                begin = end
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blocks, pa.binary())], ["part", "block"])

    return make


def _meet(groups: int, threshold: float):
    """Pairs of a group's postings, as counts of shared shingles, packed by the group of the pair."""

    def make(group: pa.Table) -> pa.Table:
        row, n, tok, place, side = [], [], [], [], []
        for x in group.column("block"):
            r, m, c, t, p, s = unpack(x.as_py())
            row.append(np.repeat(np.cumsum(r), c))
            n.append(np.repeat(m, c))
            tok.append(t)
            place.append(p)
            side.append(s)
        row, n, tok, place, side = (np.concatenate(x) for x in (row, n, tok, place, side))
        n, place = n.astype(np.int64), place.astype(np.int64)
        order = np.argsort(tok, kind="stable")
        row, n, tok, place, side = row[order], n[order], tok[order], place[order], side[order]
        starts = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]])
        size = np.diff(np.r_[starts, len(tok)])
        nth = segments(np.zeros(len(starts), dtype=np.int64), size)
        left: list[np.ndarray] = []
        right: list[np.ndarray] = []
        held, ids, blocks = 0, [], []

        def flush() -> None:
            nonlocal held
            if held:
                i, j = np.concatenate(left), np.concatenate(right)
                left.clear(), right.clear()
                held = 0
                counted(row, n, i, j, ids, blocks)

        live = np.flatnonzero(nth >= 1)
        step = 1
        while len(live):
            for x in range(0, len(live), PAIRS):
                i = live[x : x + PAIRS]
                j = i - step
                need = np.ceil((n[i] + n[j]) * (threshold / (1 + threshold)) - 1e-9)
                most = MATCHES + np.minimum(n[i] - place[i] - 1, n[j] - place[j] - 1)
                ok = (most >= need) & (np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]) - 1e-9)
                s = side[i] + side[j]
                ok &= ((s == 0) | ((s == 3) & (side[i] != side[j]))) & (row[i] != row[j])
                left.append(i[ok])
                right.append(j[ok])
                held += len(left[-1])
                if held >= PAIRS:
                    flush()
            step += 1
            live = live[nth[live] >= step]
        flush()
        return pa.table({"part": pa.array(ids, pa.int32()), "block": pa.array(blocks, pa.binary())})

    def counted(row: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, ids: list, blocks: list) -> None:
        """Pack pairs, each with how often it occurs, by the group of the pair."""
        swap = row[i] > row[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        a, b, na, nb = row[i], row[j], n[i], n[j]
        asked = np.minimum(MATCHES, np.ceil((na + nb) * (threshold / (1 + threshold)) - 1e-9)).astype(np.uint8)
        to = (mix64(a.astype(np.uint64)) % np.uint64(groups)).astype(np.int64)
        order = np.lexsort((b, a, to))
        a, b, asked, to = a[order], b[order], asked[order], to[order]
        ends = np.flatnonzero(np.r_[to[1:] != to[:-1], True]) + 1 if len(to) else np.zeros(0, dtype=np.int64)
        begin = 0
        for end in ends:
            x, y, z = a[begin:end], b[begin:end], asked[begin:end]
            new = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
            blocks.append(pack(np.diff(x[new], prepend=0), y[new] - x[new], np.minimum(255, np.diff(np.r_[new, len(x)])).astype(np.uint8), z[new]))
            ids.append(to[begin])
            begin = end

    return make


def _enough(group: pa.Table) -> pa.Table:
    got = [unpack(x.as_py()) for x in group.column("block")]
    a, b = np.concatenate([np.cumsum(g[0]) for g in got]), np.concatenate([np.cumsum(g[0]) + g[1] for g in got])
    c, asked = np.concatenate([g[2] for g in got]).astype(np.int64), np.concatenate([g[3] for g in got])
    order = np.lexsort((b, a))
    a, b, c, asked = a[order], b[order], c[order], asked[order]
    new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    keep = new[np.add.reduceat(c, new) >= asked[new]]
    return pa.table({"a": pa.array(a[keep], pa.int64()), "b": pa.array(b[keep], pa.int64())})


def _bits(rows: np.ndarray) -> np.ndarray:
    return (mix64(rows.astype(np.uint64)) >> np.uint64(64 - FILTER)).astype(np.int64)


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        bits = np.unique(np.concatenate([_bits(c.to_numpy()) for c in b.columns]))
        yield pa.RecordBatch.from_arrays([pa.array((bits >> PART).astype(np.int32)), pa.array(bits.astype(np.int32))], ["block", "bit"])


def _any(group: pa.Table) -> pa.Table:
    total = np.zeros(1 << PART, dtype=bool)
    total[group.column("bit").to_numpy() & ((1 << PART) - 1)] = True
    return pa.table({"block": group.column("block")[:1].cast(pa.int32()), "bits": pa.array([np.packbits(total).tobytes()], pa.binary())})


def _filter(close: DataFrame) -> bytes:
    """A bit for each hash of a record of a pair. A group has at most 2^PART distinct bits, however many pairs there are."""
    rows = dict(close.select("a", "b").mapInArrow(_mark, "block int, bit int").distinct().groupBy("block").applyInArrow(_any, "block int, bits binary").collect())
    return b"".join(rows.get(i, b"\0" * ((1 << PART) // 8)) for i in range(1 << (FILTER - PART)))


def _pick(bits):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.unpackbits(np.frombuffer(bits.value, dtype=np.uint8)).astype(bool)
        for b in batches:
            yield b.take(pa.array(np.flatnonzero(seen[_bits(b.column(0).to_numpy())])))

    return make


def _verify(threshold: float):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, xs = _unset(batch.column(2))
            y, ys = _unset(batch.column(3))
            nx, ny = np.diff(xs), np.diff(ys)
            common = np.zeros(len(nx), dtype=np.int64)
            for at in range(0, len(nx), 1 << 14):
                to = min(at + (1 << 14), len(nx))
                pair = np.arange(to - at, dtype=np.uint64) << np.uint64(BITS)
                keys = np.sort(np.r_[np.repeat(pair, nx[at:to]) | x[xs[at] : xs[to]], np.repeat(pair, ny[at:to]) | y[ys[at] : ys[to]]])
                twice = keys[1:][keys[1:] == keys[:-1]]
                common[at:to] = np.bincount((twice >> np.uint64(BITS)).astype(np.int64), minlength=to - at)
            union = nx + ny - common
            ok = pa.array(np.flatnonzero(common >= threshold * union - 1e-9))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(ok), batch.column(1).take(ok), pa.array(common / np.maximum(union, 1)).take(ok)], ["a", "b", "similarity"])

    return make


def split(row: str) -> Column:
    return F.pmod(F.xxhash64(row), F.lit(SPLITS)).cast("int").alias("_split")


class NearDuplicates:
    """pairs: a, b, similarity (a < b) between representatives; copies: row_id, rep of every record
    whose set another record has too, the representative (its least row_id) among them; sets: row_id, n."""

    def __init__(self, pairs: DataFrame, copies: DataFrame, sets: DataFrame):
        self.pairs, self.copies, self.sets = pairs, copies, sets

    def all_pairs(self) -> DataFrame:
        """row_id_a < row_id_b of every similar pair of records, those with equal sets included."""
        one = self.copies.select(F.col("rep").alias("a"), F.col("row_id").alias("_ra"))
        two = self.copies.select(F.col("rep").alias("b"), F.col("row_id").alias("_rb"))
        wide = self.pairs.select("a", "b").join(one, "a", "left").join(two, "b", "left").select(F.coalesce("_ra", "a").alias("x"), F.coalesce("_rb", "b").alias("y"))
        # Each two copies make a row; a class's copies are dealt to splits on one side and stand in each on the other.
        dealt = one.withColumn("_split", split("_ra"))
        every = two.withColumn("_each", F.explode(F.array(*[F.lit(i) for i in range(SPLITS)])))
        same = dealt.join(every, (F.col("a") == F.col("b")) & (F.col("_split") == F.col("_each")) & (F.col("_ra") < F.col("_rb"))).select(F.col("_ra").alias("x"), F.col("_rb").alias("y"))
        both = wide.unionByName(same).where("x <> y")
        return both.select(F.least("x", "y").alias("row_id_a"), F.greatest("x", "y").alias("row_id_b")).distinct()

    def groups(self) -> DataFrame:
        """row_id, group_id, links: the least row_id reachable over similar pairs, and the number of similar
        records, for every record with at least the words asked for. links counts copies one by one."""
        edges = self.pairs.select(F.col("a").alias("x"), F.col("b").alias("y"))
        edges = materialize(edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))), "edges")
        label = edges.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("g"))
        label = materialize(label, "labels")
        while True:
            # The least label among the neighbours, then that label's own label.
            best = edges.join(label.select(F.col("x").alias("y"), "g"), "y").groupBy("x").agg(F.min("g").alias("m"))
            new = label.join(best, "x").select("x", "g", F.least("g", "m").alias("m"))
            jump = label.select(F.col("x").alias("m"), F.col("g").alias("j"))
            new = materialize(new.join(jump, "m", "left").select("x", F.col("g").alias("_old"), F.least(F.coalesce("j", "m"), "m").alias("g")), "labels")
            release(label)
            done, label = new.where("g < _old").isEmpty(), new
            if done:
                break
        size = self.copies.groupBy("rep").agg(F.count(F.lit(1)).alias("k"))
        near = edges.join(size, F.col("y") == F.col("rep"), "left").groupBy("x").agg(F.sum(F.coalesce("k", F.lit(1))).alias("links"))
        rep = self.sets.select("row_id").join(self.copies, "row_id", "left").select("row_id", F.coalesce("rep", "row_id").alias("rep"))
        out = rep.join(label.select(F.col("x").alias("rep"), "g"), "rep", "left").join(near.withColumnRenamed("x", "rep"), "rep", "left").join(size, "rep", "left")
        return out.select("row_id", F.coalesce("g", "rep").alias("group_id"), (F.coalesce("links", F.lit(0)) + F.coalesce("k", F.lit(1)) - 1).cast("long").alias("links"))


def near_duplicates(records: DataFrame, threshold: float = THRESHOLD, run: int = RUN, least_words: int = LEAST_WORDS) -> NearDuplicates:
    """Similar pairs among records (row_id: unique; text).

    Rows without a row_id are left out; of rows that repeat as a whole the pairs come out once. Texts of fewer than least_words words, or too few for one run, null and empty ones among them,
    belong to no pair. Shingles are compared by BITS bits of their hashes. Other columns are ignored; empty
    tables give no rows. threshold: above 0, up to 1.
    """
    spark = records.sparkSession
    ship(spark)
    texts = records.select("row_id", F.expr("make_valid_utf8(text)").alias("_text")).where("row_id is not null and _text is not null")
    sets = materialize(spread(texts).mapInArrow(_sets(run, least_words), "row_id bigint, n int, same bigint, shingles binary"), "sets")
    many = sets.groupBy("same").agg(F.min("row_id").alias("rep"), F.count(F.lit(1)).alias("_k")).where("_k > 1").drop("_k")
    # A class may hold a third of all records: its records are dealt to splits, and its one row is repeated for each.
    each = many.withColumn("_split", F.explode(F.array(*[F.lit(i) for i in range(SPLITS)])))
    copies = materialize(sets.select("row_id", "same", split("row_id")).join(each, ["same", "_split"]).select("row_id", "rep"), "copies")
    own = sets.join(copies.where("row_id <> rep").select("row_id"), "row_id", "left_anti")
    total = sets.agg(F.sum("n")).first()[0] or 0
    counters = min(MOST, max(FEWEST, (total // 4).bit_length()))
    levels = spark.sparkContext.broadcast(_levels(own, counters))
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // GROUP))
    postings = own.select("row_id", "n", "shingles").mapInArrow(_postings(levels, counters, total / (1 << counters), groups, threshold), "part int, block binary")
    met = postings.groupBy("part").applyInArrow(_meet(groups, threshold), "part int, block binary")
    close = materialize(met.groupBy("part").applyInArrow(_enough, "a bigint, b bigint"), "close")
    bits = spark.sparkContext.broadcast(_filter(close))
    asked = sets.select("row_id", "shingles").mapInArrow(_pick(bits), "row_id bigint, shingles binary")
    left = close.join(asked.select(F.col("row_id").alias("a"), F.col("shingles").alias("sa")), "a")
    pairs = left.join(asked.select(F.col("row_id").alias("b"), F.col("shingles").alias("sb")), "b").select("a", "b", "sa", "sb")
    pairs = materialize(pairs.mapInArrow(_verify(threshold), "a bigint, b bigint, similarity double"), "similar")
    return NearDuplicates(pairs, copies, sets.select("row_id", "n"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "unified_data")).all_pairs()


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "unified_data")).groups()


QUERIES = {"p3_found": p3_found, "p3_groups": p3_groups}
_WORDS = "list_transform(regexp_extract_all(regexp_replace(coalesce(text, ''), '\\p{Cf}+', '', 'g'), '[\\p{L}\\p{N}]+'), lambda w: lower(w))"
SQL = {
    "p3_found": f"""WITH w AS (SELECT row_id, {_WORDS} AS w FROM unified_data),
 s AS (SELECT DISTINCT row_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM w, unnest(range(1, len(w) - 1)) u(i) WHERE len(w) >= 40),
 n AS (SELECT row_id, count(*) AS n FROM s GROUP BY 1),
 c AS (SELECT a.row_id AS row_id_a, b.row_id AS row_id_b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.row_id < b.row_id GROUP BY ALL)
 SELECT row_id_a, row_id_b FROM c JOIN n x ON x.row_id = row_id_a JOIN n y ON y.row_id = row_id_b WHERE 2 * c >= x.n + y.n - c"""
}
