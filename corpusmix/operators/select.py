"""Scores, ranks and sampling: from normalised signals to the selected records.

A record's merged score is a weighted sum of its normalised signals, by its domain's weights. Its
rank is the share of its domain's tokens in records at least as good, 0 being best. Its sampling
value falls with the rank along a curve of its domain, and says how many copies of it are drawn.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmix.functions.rng import TWO_32, TWO_52, first_words, tail_words, uniform
from corpusmix.operators import normalize
from corpusmix.operators.order import number_rows
from corpusmix.shared import materialize, ship, spread

SIGMAS = ("s0", "s1", "s2", "s3", "s4")
WEIGHTS = ("a0", "a1", "a2", "a3", "a4")
#: Records of a domain that ranks rest on where all would be too many; the domain's all where it has fewer.
REFERENCE = 10_000
#: Ranges of a hash by which rows are counted, records that a task ranks at once, pairs hashed at once, rows of a batch.
RANGES, BLOCK, PAIRS, BATCH = 4096, 1 << 18, 1 << 14, 1 << 15


def normalized(pool: DataFrame, long: DataFrame, name: str = "rank") -> DataFrame:
    """row_id, domain, tokens and the five normalised signals s0..s4, written once for all that follows.

    pool: row_id, domain, tokens. long: row_id, criterion, x of the same rows.
    """
    n = normalize.normalizer(name)(long).select("row_id", "criterion", "sigma")
    wide = n.groupBy("row_id").agg(*[F.max(F.when(F.col("criterion") == i, F.col("sigma"))).alias(s) for i, s in enumerate(SIGMAS)])
    return materialize(pool.select("row_id", "domain", "tokens").join(wide, "row_id"), "normalized")


def merge(scored: DataFrame, theta: DataFrame) -> DataFrame:
    """Add merged, rounded to 12 places, and the parameters; domains without parameters drop out.

    theta: domain, a0..a4, lambda, omega, eta, epsilon, and experiment_id where there are several:
    a record then gives a row for each. theta has domains times experiments rows and is small.
    """
    dot = sum((F.col(s) * F.col(a) for s, a in zip(SIGMAS, WEIGHTS)), F.lit(0.0))
    joined = scored.join(theta, "domain").withColumn("merged", F.round(dot, 12) + 0.0)
    return joined.drop(*SIGMAS, *WEIGHTS)


def rank_rows(merged: DataFrame, groups: tuple[str, ...] = ("domain",)) -> DataFrame:
    """Add rank: the tokens up to and with a record, best first, over the group's; ties by row_id.

    0.5 where the group has no tokens.
    """
    n = number_rows(merged, groups, [F.desc("merged"), "row_id"], "tokens", "_place", "_before")
    total = merged.groupBy(*groups).agg(F.sum("tokens").alias("_all"))
    r = F.when(F.col("_all") > 0, (F.col("_before") + F.col("tokens")) / F.col("_all")).otherwise(0.5)
    return n.join(F.broadcast(total), list(groups)).withColumn("rank", F.round(r, 12)).drop("_place", "_before", "_all")


def _over_scores(merged: DataFrame, weights: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """rank by the weight at or above each distinct score; weights: groups, merged, _w."""
    scores = weights.groupBy(*groups, "merged").agg(F.sum("_w").cast("long").alias("_w"))
    n = number_rows(scores, groups, [F.desc("merged")], "_w", "_place", "_before")
    total = scores.groupBy(*groups).agg(F.sum("_w").alias("_all"))
    r = F.when(F.col("_all") > 0, (F.col("_before") + F.col("_w")) / F.col("_all")).otherwise(0.5)
    ranks = n.join(F.broadcast(total), list(groups)).select(*groups, "merged", F.round(r, 12).alias("rank"))
    return merged.join(ranks, [*groups, "merged"])


def rank_range(merged: DataFrame, groups: tuple[str, ...] = ("domain",)) -> DataFrame:
    """Add rank as rank_rows does, with equal scores sharing the last one's."""
    return _over_scores(merged, merged.select(*groups, "merged", F.col("tokens").alias("_w")), groups)


def reference_rows(rows: DataFrame, size: int, seed: int = 1729) -> DataFrame:
    """The `size` rows of lowest hash of each domain, all rows of a smaller one.

    Rows are counted by domain and hash range first; only those up to the range in which a domain
    reaches its size are ordered, which is `size` rows and one range.
    """
    u = uniform(seed, "row_id")
    part = F.floor(u * RANGES).cast("int")
    counts = rows.groupBy("domain", part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most domains * RANGES rows
    seen: dict[int, int] = {}
    last: dict[int, int] = {}
    for r in sorted((r for r in counts if r["domain"] is not None), key=lambda r: (r["domain"], r["part"])):
        if seen.get(r["domain"], 0) < size:
            last[r["domain"]] = r["part"]
        seen[r["domain"]] = seen.get(r["domain"], 0) + r["n"]
    if not last:
        return rows.where("false")
    limit = F.try_element_at(F.create_map(*[F.lit(x).cast("long") for p in sorted(last.items()) for x in p]), F.col("domain").cast("long"))
    w = Window.partitionBy("domain").orderBy(u, "row_id")
    return rows.where(part <= limit).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= size).drop("_k")


def _shares(scores: np.ndarray, tokens: np.ndarray, of: np.ndarray) -> np.ndarray:
    """For each score in `of` the tokens of reference scores at or above it, over all; 0.5 without tokens."""
    order = np.argsort(-scores, kind="stable")
    upto = np.r_[0, np.cumsum(tokens[order])]
    if upto[-1] <= 0:
        return np.full(len(of), 0.5)
    return _round12(upto[np.searchsorted(-scores[order], -of, "right")] / upto[-1])


def _round12(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 1e12 + 0.5) / 1e12


def rank_subset(merged: DataFrame, size: int, seed: int = 1729) -> DataFrame:
    """Add rank among `size` records of each domain, those of lowest hash: their tokens at or above the score.

    The rank is 0 for a score above all of them. The reference scores, at most domains * size, are
    broadcast; ranking is a binary search in one narrow pass. Rows of a null domain drop out.
    """
    spark = merged.sparkSession
    ship(spark)
    by: dict[int, list] = {}
    for d, m, t in reference_rows(merged.select("domain", "row_id", "merged", "tokens"), size, seed).where("merged is not null").select("domain", "merged", "tokens").collect():
        by.setdefault(d, []).append((m, t))
    shared = spark.sparkContext.broadcast({d: (np.array([m for m, _ in x]), np.array([t or 0 for _, t in x], dtype=np.int64)) for d, x in by.items()})
    schema = T.StructType([*merged.schema.fields, T.StructField("rank", T.DoubleType())])
    at, key = merged.columns.index("merged"), merged.columns.index("domain")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pc.and_(pc.is_valid(b.column(at)), pc.is_valid(b.column(key))))
            m, d = b.column(at).to_numpy(zero_copy_only=False), b.column(key).to_numpy(zero_copy_only=False)
            rank = np.zeros(len(m))
            for x in np.unique(d):
                own = d == x
                rank[own] = _shares(*shared.value[x], m[own])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rank)], [*b.schema.names, "rank"])

    return merged.mapInArrow(run, schema)


MANY = "experiment_id bigint, row_id bigint, domain bigint, tokens bigint, rank double, value double, copies int, weight double"


def _scores(x: np.ndarray, a: tuple) -> np.ndarray:
    total = np.zeros(len(x))
    for i in range(len(WEIGHTS)):
        total = total + x[:, i] * a[i]
    return _round12(total)


def _bound(ref: np.ndarray, p: tuple) -> float:
    """The highest reference score of a rank above omega: only records above it have a rank up to omega. -inf where it isn't known.

    ref: tokens and signals. p: experiment_id, weights, lambda, omega, eta, epsilon.
    """
    omega = p[7]
    if not np.isfinite(p[1:]).all():
        return -np.inf
    if omega < 0:
        return np.inf
    s, tokens = _scores(ref[:, 1:], p[1:6]), ref[:, 0].astype(np.int64)
    if tokens.sum() <= 0:
        return -np.inf if omega >= 0.5 else np.inf
    order = np.argsort(-s)
    s, upto = s[order], np.cumsum(tokens[order])
    beyond = np.flatnonzero(np.r_[s[1:] != s[:-1], True] & (_round12(upto / upto[-1]) > omega))
    return s[beyond[0]] if len(beyond) else -np.inf


def _ranks(ref: np.ndarray, tokens: np.ndarray, p: tuple, bound: float, of: np.ndarray) -> np.ndarray:
    """_shares of `of` among the reference scores, sorting those above bound only unless many of `of` are below it."""
    total = tokens.sum()
    if total <= 0:
        return np.full(len(of), 0.5)
    s = _scores(ref, p[1:6])
    low = np.flatnonzero(of <= bound)
    if len(low) > 16:
        return _shares(s, tokens, of)
    at = np.flatnonzero(~(s <= bound))
    top = s[at]
    order = np.argsort(-top)
    upto = np.r_[0, np.cumsum(tokens[at[order]])]
    rank = upto[np.searchsorted(-top[order], -of, "right")]
    for i in low:
        rank[i] = tokens[s >= of[i]].sum()
    return _round12(rank / total)


def _bounds(spark, shared, sets: dict[int, list]) -> dict[int, list[float]]:
    """_bound of each domain's sets, found in parallel."""
    places = [(d, i) for d in shared.value for i in range(len(sets[d]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [places[i] for i in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_bound(shared.value[d][0], shared.value[d][1][i]) for d, i in at], pa.float64())], ["id", "bound"])

    out = {d: [0.0] * len(sets[d]) for d in shared.value}
    tasks = max(1, min(4 * spark.sparkContext.defaultParallelism, len(places) // 64))
    for k, bound in spark.range(0, len(places), 1, tasks).mapInArrow(run, "id bigint, bound double").collect():  # domains times experiments rows
        d, i = places[k]
        out[d][i] = bound
    return out


def select_many(scored: DataFrame, theta: DataFrame, size: int = REFERENCE, seed: int = 42, columns: tuple[str, ...] = ()) -> DataFrame:
    """Selections of many sets of parameters in one narrow pass over the records.

    scored: rows of `normalized`. theta: as in merge, with experiment_id; domains times experiments
    rows, which are broadcast, as are `size` reference records of each domain. A record's rank under
    a set is its place among the reference records' scores under it. Every pair of a record and a set
    is hashed, many at once; ranks are found, by binary search, of records that the set's curve may
    draw and those whose hash is below epsilon. Only drawn records leave the task. Gives
    experiment_id, row_id, domain, tokens, rank, value, copies, weight, or the columns asked for.
    Records with a null signal or domain are never drawn.
    """
    spark = scored.sparkSession
    ship(spark)
    refs: dict[int, list] = {}
    for r in reference_rows(scored, size).select("domain", "tokens", *SIGMAS).collect():
        if None not in tuple(r)[2:]:
            refs.setdefault(r["domain"], []).append(tuple(r)[1:])
    sets: dict[int, list] = {}
    for r in theta.select("domain", "experiment_id", *WEIGHTS, "lambda", "omega", "eta", "epsilon").collect():
        sets.setdefault(r["domain"], []).append(tuple(r)[1:])
    for own in sets.values():
        own.sort(key=lambda p: len(str(p[0])))  # heads of one length are hashed together
    shared = spark.sparkContext.broadcast({d: (np.array(refs[d], dtype=np.float64), sets[d]) for d in sets if d in refs})
    limits = spark.sparkContext.broadcast(_bounds(spark, shared, sets))
    names = [f.split()[0] for f in MANY.split(", ")]
    kept = [n for n in names if not columns or n in columns]

    def draw(rows: np.ndarray, tokens: np.ndarray, x: np.ndarray, domain: int) -> Iterator[list[np.ndarray]]:
        ref, own = shared.value[domain]
        weights, signals = ref[:, 0].astype(np.int64), ref[:, 1:].copy("F")
        texts = [b":%d" % r for r in rows.tolist()]
        order = np.argsort([len(t) for t in texts], kind="stable")
        rows, tokens, x, texts = rows[order], tokens[order], x[order].copy("F"), [texts[i] for i in order]
        ends = [*np.flatnonzero(np.diff([len(t) for t in texts])) + 1, len(texts)]
        slices = [(i, min(i + PAIRS, b)) for a, b in zip([0, *ends], ends) for i in range(a, b, PAIRS)]
        many, head = max(1, PAIRS // len(rows)), 0
        hashes = np.empty((many, len(rows)), np.uint32)
        k = 0
        while k < len(own):
            heads = [b"%d:%d" % (seed, p[0]) for p in own[k : k + many]]
            heads = [h for h in heads if len(h) == len(heads[0])]
            if head != len(heads[0]):
                head = len(heads[0])
                tails = [tail_words(texts[a:b], head) for a, b in slices]
            for (a, b), t in zip(slices, tails):
                hashes[: len(heads), a:b] = first_words(heads, t)
            for h, first, p, bound in zip(heads, hashes, own[k : k + len(heads)], limits.value[domain][k : k + len(heads)]):
                lam, omega, eta, epsilon = p[6:]
                score = _scores(x, p[1:6])
                least = _round12(np.float64(epsilon))
                if 0 <= least < 1:  # below the curve only a hash below epsilon draws
                    at = np.flatnonzero((first <= np.uint32(least * TWO_32)) | ~(score <= bound))
                else:
                    at = np.arange(len(rows))
                if not len(at):
                    continue
                rank = _ranks(signals, weights, p, bound, score[at])
                curve = (2.0 / (1.0 + np.exp(np.clip(-lam * (omega - rank), -100.0, 100.0)))) ** eta + epsilon
                value = _round12(np.where(rank <= omega, curve, epsilon))
                whole = np.floor(value)
                u, part = first[at] / TWO_32, value - whole
                for i in np.flatnonzero((u < part) & (part < u + 1 / TWO_32)):  # the first 32 bits don't tell
                    u[i] = (int.from_bytes(md5(h + texts[at[i]]).digest()[:8], "big") >> 12) / TWO_52
                copies = (whole + (u < part)).astype(np.int32)
                some = copies > 0
                at, value = at[some], value[some]
                n = len(at)
                if n:
                    every = (np.full(n, p[0], np.int64), rows[at], np.full(n, domain, np.int64), tokens[at], rank[some], value, copies[some], 1 / np.maximum(value, 1e-10))
                    yield [c for c, name in zip(every, names) if name in kept]
            k += len(heads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        drawn: list[list[np.ndarray]] = []
        count = 0
        for b in chain(batches, (None,)):
            if b is not None:
                held.append(b)
            if not held or (b is not None and sum(h.num_rows for h in held) < BLOCK):
                continue
            t = pa.Table.from_batches(held).drop_null()
            held = []
            row, domain, tokens = (t.column(c).to_numpy() for c in ("row_id", "domain", "tokens"))
            x = np.column_stack([t.column(s).to_numpy() for s in SIGMAS])
            for d in np.unique(domain):
                if d in shared.value:
                    own = domain == d
                    for found in draw(row[own], tokens[own], x[own], int(d)):
                        drawn.append(found)
                        count += len(found[0])
                        if count >= BATCH:
                            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*drawn)], kept)
                            drawn, count = [], 0
        if drawn:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*drawn)], kept)

    return spread(scored.select("row_id", "domain", "tokens", *SIGMAS)).mapInArrow(run, ", ".join(f for f in MANY.split(", ") if f.split()[0] in kept))


def sampling_value() -> Column:
    """(2 / (1 + e^(-lambda (omega - rank))))^eta + epsilon up to rank omega, epsilon beyond; to 12 places."""
    e = F.greatest(F.lit(-100.0), F.least(F.lit(100.0), -F.col("lambda") * (F.col("omega") - F.col("rank"))))
    curve = F.pow(2.0 / (1.0 + F.exp(e)), F.col("eta")) + F.col("epsilon")
    return F.round(F.when(F.col("rank") <= F.col("omega"), curve).otherwise(F.col("epsilon")), 12)


def copies(value: str, seed: int, *keys: str) -> Column:
    """The whole part of a sampling value, and one more with the probability of the rest."""
    return (F.floor(value) + (uniform(seed, *keys) < F.col(value) - F.floor(value)).cast("long")).cast("int")


def importance(value: str) -> Column:
    return 1 / F.greatest(F.col(value), F.lit(1e-10))


def select(ranked: DataFrame, seed: int = 42, keys: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """Add value, copies and weight; rows without a copy drop out."""
    v = ranked.withColumn("value", sampling_value())
    return v.withColumn("copies", copies("value", seed, *keys)).withColumn("weight", importance("value")).where("copies > 0")


def repeat(selected: DataFrame) -> DataFrame:
    """A row for each copy, numbered by copy from 0."""
    return selected.withColumn("copy", F.explode(F.expr("filter(sequence(0, copies), i -> i < copies)")))


def thin(rows: DataFrame, target: int, seed: int = 42, keys: tuple[str, ...] = ("row_id", "copy")) -> DataFrame:
    """Drop rows at random so that the tokens come to about the target; all stay where there are no more."""
    total = rows.agg(F.sum("tokens").alias("_all"))
    joined = rows.crossJoin(F.broadcast(total))  # one row
    return joined.where((F.col("_all") <= target) | (uniform(seed, *keys) < F.lit(float(target)) / F.col("_all"))).drop("_all")


def subsample(rows: DataFrame, budget: int, seed: int = 0, groups: tuple[str, ...] = (), key: str = "row_id") -> DataFrame:
    """Where a group's tokens exceed the budget, the 1.2 budget / mean tokens rows of lowest hash, at least 100."""
    stats = rows.groupBy(*groups).agg(F.sum("tokens").alias("_all"), F.count(F.lit(1)).alias("_n"))
    n = number_rows(rows.withColumn("_u", uniform(seed, *groups, key)), groups, ["_u", key], rank="_k")
    n = n.join(F.broadcast(stats), list(groups)) if groups else n.crossJoin(F.broadcast(stats))
    keep = F.greatest(F.lit(100), F.floor(F.lit(float(budget)) / (F.col("_all") / F.col("_n")) * 1.2))
    return n.where((F.col("_all") <= budget) | (F.col("_k") < keep)).drop("_u", "_k", "_all", "_n")


def subsample_copies(rows: DataFrame, budget: int, seed: int = 0, group: str = "experiment_id") -> DataFrame:
    """What subsample keeps of each group's copies, counted: group, row_id, copies.

    rows: group, row_id, tokens, copies; a written table, which is read again. Where a group has too
    many, only rows below a hash under which there are enough with near certainty are numbered; of
    groups that turn out to have too few there, all rows.
    """
    stats = rows.groupBy(group).agg(F.sum(F.col("tokens") * F.col("copies")).alias("_all"), F.sum("copies").alias("_n"))
    keep = F.greatest(F.lit(100), F.floor(F.lit(float(budget)) / (F.col("_all") / F.col("_n")) * 1.2))
    stats = materialize(stats.withColumn("_keep", F.when(F.col("_all") <= budget, F.col("_n")).otherwise(keep)), "budgets")
    share = (F.col("_keep") + 8 * F.sqrt("_keep") + 16) / F.col("_n")
    # hex digits that the hash's first eight may not exceed
    most = F.lower(F.lpad(F.hex(F.least(F.floor(share * TWO_32), F.lit(int(TWO_32) - 1)).cast("long")), 8, "0"))
    most = F.when(F.col("_n") <= F.col("_keep"), "ffffffff").otherwise(most)
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(group).cast("string"), F.col("row_id").cast("string"))), 1, 8)
    few = materialize(rows.join(stats.select(group, most.alias("_most")), group).where(digits <= F.col("_most")).drop("_most"), "lowest")
    found = few.groupBy(group).agg(F.sum("copies").alias("_found"))
    short = stats.join(found, group, "left").where(F.coalesce("_found", F.lit(0)) < F.least("_keep", "_n")).select(group)
    if short.take(1):
        short = materialize(short, "short")
        few = few.join(short, group, "left_anti").unionByName(rows.join(short, group, "left_semi"))
    n = number_rows(few.withColumn("_u", uniform(seed, group, "row_id")), [group], ["_u", "row_id"], "copies", "_place", "_before")
    n = n.join(stats.select(group, "_keep"), group).withColumn("copies", F.least(F.col("copies").cast("long"), F.col("_keep") - F.col("_before")))
    return n.where("copies > 0").groupBy(group, "row_id").agg(F.sum("copies").alias("copies"))


def weighted_sample(rows: DataFrame, weight: str, size: int, seed: int = 42, key: str = "row_id") -> DataFrame:
    """`size` rows without replacement, in proportion to weight: those of highest ln(u) / weight."""
    k = rows.where(F.col(weight) > 0).withColumn("_key", F.round(F.ln(uniform(seed, key) + 1e-300) / F.col(weight), 9))
    return number_rows(k, [], [F.desc("_key"), key], rank="_k").where(F.col("_k") < size).drop("_key", "_k")


def prefix(rows: DataFrame, order: list[Column | str], target: float, closed: bool = False) -> DataFrame:
    """Rows in an order until their tokens reach the target.

    The row that crosses the target stays, unless closed: then the sum with the row must not exceed it.
    """
    n = number_rows(rows, [], order, "tokens", "_place", "_before")
    last = F.col("_before") + F.col("tokens") <= target if closed else F.col("_before") < target
    return n.where(last).drop("_place", "_before")


def domain_change(pool: DataFrame, selected: DataFrame) -> DataFrame:
    """Records before and after and their ratio, of the domains that have any."""
    a = pool.groupBy("domain").agg(F.count(F.lit(1)).alias("original"))
    b = selected.groupBy("domain").agg(F.sum("copies").alias("selected"))
    j = a.join(b, "domain", "left").withColumn("selected", F.coalesce("selected", F.lit(0)).cast("long"))
    return j.withColumn("ratio", F.round(F.col("selected") / F.col("original"), 4))


def predicted_size(theta: DataFrame, pool: DataFrame, target: int) -> DataFrame:
    """Least, greatest and mean omega, the tokens they promise, and how that stands to a target."""
    o = theta.agg(F.min("omega").alias("omega_min"), F.max("omega").alias("omega_max"), F.avg("omega").alias("omega_avg"))
    t = o.crossJoin(pool.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens")))  # a row each
    t = t.withColumn("estimated", F.floor(F.col("total_tokens") * F.col("omega_avg")).cast("long"))
    note = F.when(F.col("estimated") < target * 0.8, "below target").when(F.col("estimated") > target * 1.2, "above target").otherwise("near target")
    return t.withColumn("note", note)
