"""Problem 8: passages of evaluation items within training documents.

Both sides are winnowed: of every window of consecutive k-word runs the one of the lowest hash is
kept, so a stretch of k + window - 1 words that both share holds a run that both keep. Kept runs are
joined by hash, with the words around them, and each hit is extended word by word on both sides; it
counts if it reaches the length asked for or the whole item. Items shorter than that length form
groups by their own length, each with its own k, so a short item makes no other one dearer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmix.llm.common import table
from corpusmix.llm.words import WordHashes, runs, words
from corpusmix.shared import materialize, ship, spread

LENGTH = 12
#: Bits of the filter of the items' kept runs, as a power of two, and of those that one group of it holds.
FILTER, PART = 25, 18
#: Splits of each hash in the join, over which a hot one's documents are dealt.
SPLITS = 16


def shape(length: int) -> tuple[int, int]:
    """k and window for stretches of `length` words: together they span just that."""
    k = max(1, (2 * length + 2) // 3)
    return k, length - k + 1


def kept(h: np.ndarray, of: np.ndarray, window: int) -> np.ndarray:
    """Places of h that are the lowest (the last of equals) of some window within one text."""
    if window == 1:
        return np.arange(len(h))
    if len(h) < window:
        return np.zeros(0, dtype=np.int64)
    view = np.lib.stride_tricks.sliding_window_view(h, window)
    place = np.arange(len(view)) + window - 1 - np.argmin(view[:, ::-1], axis=1)
    keep = np.zeros(len(h), dtype=bool)
    keep[place[of[: len(view)] == of[window - 1 :]]] = True
    return np.flatnonzero(keep)


def around(length: int) -> tuple[int, int]:
    """Words before a kept run and in all that decide whether it lies in a stretch of `length` words."""
    k, _ = shape(length)
    return length - k, 2 * length - k


def fingerprints(texts: list[list[str]], known: WordHashes, lengths: list[int], own: bool, outside: int, seen: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the text's number, hash and surrounding words of every kept run.

    own: a text of fewer words than the last length has runs for its own length only, others for the
    last one; else every text has runs for each length. outside: what stands for a word beyond the
    text. seen: a filter of hashes; others are left out.
    """
    flat, starts = known.of(texts)
    size = np.diff(starts)
    of = np.repeat(np.arange(len(texts)), size)
    done: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for n in lengths:
        k, window = shape(n)
        if len(flat) < k:
            continue
        if k not in done:
            h = runs(flat, k)
            at = np.flatnonzero(of[: len(h)] == of[k - 1 :])
            done[k] = h[at], at
        h, at = done[k]
        place = kept(h, of[at], window)
        hashes, place = h[place], at[place]
        if own:
            use = np.minimum(size, lengths[-1])[of[place]] == n
        else:
            use = seen[_bits(hashes, n)] if seen is not None else np.ones(len(place), dtype=bool)
        hashes, place = hashes[use], place[use]
        before, width = around(n)
        j = place[:, None] + np.arange(-before, width - before)
        d = of[place]
        inside = (j >= starts[d][:, None]) & (j < starts[d + 1][:, None])
        near = np.where(inside, flat[np.clip(j, 0, len(flat) - 1)], np.uint64(outside))
        # A text that repeats itself has many equal ones; one is enough.
        sums = runs(near.ravel(), width)[::width] if len(near) else np.zeros(0, dtype=np.uint64)
        _, first = np.unique(np.stack([d.astype(np.uint64), sums]), axis=1, return_index=True) if len(d) else (None, np.zeros(0, dtype=np.int64))
        yield n, d[first], hashes[first], near[first]


def _bits(hashes: np.ndarray, n: int) -> np.ndarray:
    return (hashes * np.uint64(2 * n + 1) >> np.uint64(64 - FILTER)).astype(np.int64)


def _rows(key: pa.Array, found: Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]], names: list[str], bits: bool = False) -> Iterator[pa.RecordBatch]:
    for n, d, hashes, near in found:
        data = pa.py_buffer(np.ascontiguousarray(near))
        ends = pa.py_buffer((np.arange(len(d) + 1) * near.shape[1] * 8).astype(np.int32))
        columns = [key.take(pa.array(d, pa.int64())), pa.array(np.full(len(d), n, dtype=np.int32)), pa.array(hashes.view(np.int64)), pa.Array.from_buffers(pa.binary(), len(d), [None, ends, data])]
        if bits:
            columns.append(pa.array(_bits(hashes, n).astype(np.int32)))
        yield pa.RecordBatch.from_arrays(columns, names)


def extended(n: int, doc: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Whether the words around joined runs agree on n consecutive words with the run among them."""
    before, width = around(n)
    k, _ = shape(n)
    same = doc.reshape(-1, width) == item.reshape(-1, width)
    middle = same[:, before : before + k].all(axis=1)
    left = np.cumprod(same[:, :before][:, ::-1], axis=1).sum(axis=1) if before else np.zeros(len(same), dtype=np.int64)
    right = np.cumprod(same[:, before + k :], axis=1).sum(axis=1) if before else np.zeros(len(same), dtype=np.int64)
    return middle & (left + right + k >= n)


def _filter(group: pa.Table) -> pa.Table:
    bits = np.zeros(1 << PART, dtype=bool)
    bits[group.column("bit").to_numpy() & ((1 << PART) - 1)] = True
    return pa.table({"part": group.column("part")[:1].cast(pa.int32()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})


def leaks(documents: DataFrame, items: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, item_id: the document holds `length` consecutive words of the item, or all of a shorter one.

    Texts of items without words, and null texts, match nothing; items may share texts; a null
    doc_id or item_id stays. Rows are distinct. Other columns are ignored; empty tables give no rows.
    Only a filter of fixed size is broadcast: documents' kept runs that no item has end there, and the
    others are joined with the items' by hash, each hash over SPLITS.
    """
    spark = documents.sparkSession
    ship(spark)
    dkind, ikind = documents.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            texts = [words(t.as_py()) for t in b.column(1)]
            yield from _rows(b.column(0), fingerprints(texts, known, list(range(1, length + 1)), True, 1), ["item_id", "n", "hash", "item_near", "bit"], True)

    rows = items.select("item_id", F.expr("make_valid_utf8(text)").alias("_text")).where("_text is not null")
    theirs = materialize(rows.mapInArrow(of_items, f"item_id {ikind}, n int, hash bigint, item_near binary, bit int"), "item-runs")
    lengths = sorted(r[0] for r in theirs.select("n").distinct().collect())  # at most `length` rows
    if not lengths:
        return spark.createDataFrame([], f"doc_id {dkind}, item_id {ikind}")
    # A row for each part of the filter; a part has at most 2^PART bits, however many items there are.
    parts = dict(theirs.select("bit").distinct().withColumn("part", F.shiftright("bit", PART)).groupBy("part").applyInArrow(_filter, "part int, bits binary").collect())
    empty = bytes((1 << PART) // 8)
    shared = spark.sparkContext.broadcast(b"".join(parts.get(i, empty) for i in range(1 << (FILTER - PART))))

    def of_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        seen = np.unpackbits(np.frombuffer(shared.value, dtype=np.uint8)).astype(bool)
        for b in batches:
            texts = [words(t.as_py()) for t in b.column(1)]
            yield from _rows(b.column(0), fingerprints(texts, known, lengths, False, 0, seen), ["doc_id", "n", "hash", "doc_near"])

    texts = documents.select("doc_id", F.expr("make_valid_utf8(text)").alias("_text")).where("_text is not null")
    ours = spread(texts).mapInArrow(of_documents, f"doc_id {dkind}, n int, hash bigint, doc_near binary")
    ours = ours.withColumn("_split", F.pmod(F.xxhash64("doc_id", "doc_near"), F.lit(SPLITS)).cast("int"))
    theirs = theirs.drop("bit").withColumn("_split", F.explode(F.array(*[F.lit(i) for i in range(SPLITS)])))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column(2).to_numpy()
            ok = np.zeros(len(n), dtype=bool)
            for x in np.unique(n):
                at = np.flatnonzero(n == x)
                near = [np.frombuffer(b"".join(b.column(c).take(pa.array(at)).to_pylist()), dtype=np.uint64) for c in (3, 4)]
                ok[at] = extended(int(x), *near)
            hit = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([b.column(0).take(hit), b.column(1).take(hit)], ["doc_id", "item_id"])

    met = ours.join(theirs, ["n", "hash", "_split"]).select("doc_id", "item_id", "n", "doc_near", "item_near")
    return met.mapInArrow(extend, f"doc_id {dkind}, item_id {ikind}").distinct()


def report(found: DataFrame) -> DataFrame:
    """item_id and in how many documents it was found."""
    return found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(p8_found(spark, sf_dir))


QUERIES = {"p8_found": p8_found, "p8_items": p8_items}
_WORDS = "list_transform(regexp_extract_all(regexp_replace(coalesce(text, ''), '\\p{Cf}+', '', 'g'), '[\\p{L}\\p{N}]+'), lambda w: lower(w))"
_SQL = f"""WITH d AS (SELECT doc_id, ' ' || array_to_string({_WORDS}, ' ') || ' ' AS w FROM documents),
 i AS (SELECT item_id, {_WORDS} AS w FROM eval_items),
 p AS (SELECT DISTINCT item_id, ' ' || array_to_string(w[s:s + 11], ' ') || ' ' AS w FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 11, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
 g AS (SELECT DISTINCT doc_id, item_id FROM (SELECT DISTINCT w FROM p) x JOIN d ON contains(d.w, x.w) JOIN p ON p.w = x.w)
"""
SQL = {"p8_found": _SQL + "SELECT doc_id, item_id FROM g", "p8_items": _SQL + "SELECT item_id, count(*) AS documents FROM g GROUP BY 1"}
