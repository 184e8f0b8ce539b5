"""Training-data operators against SQL, brute force and edge cases."""

from __future__ import annotations

import random
from collections import defaultdict
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmix import shared
from corpusmix.llm import bpe, common, cutoff, encode, leak, mix, neardup, pack, pii, pii_train, queries, sample, tokens
from corpusmix.llm.words import words


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(name, agree):
    agree(queries.queries()[name], queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_runs(name, spark, sf_dir):
    assert queries.queries()[name](spark, sf_dir).count() >= 0


LONG = "lorem ipsum dolor " * 20000
RECORD = "row_id long, doc_id string, text string, token_count long, domain long, quality_scores array<double>, source string, lang string, batch_no int, rank string, _n string, _domain string, _size string"


def records(spark, rows):
    """Rows given by their first nine fields, with further columns whose names operators use inside."""
    return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], RECORD)


@pytest.fixture
def awkward(spark):
    nan, inf = float("nan"), float("inf")
    return records(
        spark,
        [
            (1, "AB12 ", "some text of a few words", 6, 0, [0.5, None, nan, 0.1, 0.2], "web_one", "en-XX", 1),
            (2, "ab12", "some text of a few words", None, 0, [0.5], "WEB-ONE ", "EN", 2),
            (3, None, None, 7, 0, None, None, None, 2),
            (4, None, "", 0, 1, [inf, 1.0, 1.0, 1.0, 1.0], "", "", None),
            (5, "cd", LONG, 10**7, 1, [0.7, 0.1, 0.1, 0.1, 0.1], "b", "de", 3),
            (6, "ef", " \n\t", -5, -1, [], "b", "und", 3),
            (7, "gh", "日本語のテキスト 🎉 مرحبا", 5, 99, [0.5, 0.5, 0.5, 0.5, 0.5], "b", "fr", 3),
            (8, "ij", "plain", 1, None, [0.5, 0.5, 0.5, 0.5, 0.5], "b", "fr", 3),
            (1, "AB12 ", "some text of a few words", 6, 0, [0.5, None, nan, 0.1, 0.2], "web_one", "en-XX", 1),
        ],
    )


@pytest.fixture
def none(awkward):
    return awkward.where("false")


# 1


TARGET = "score_pos int, criterion string, domain long, target_fraction double, rank string"


def test_cutoffs(spark, awkward, none):
    t = spark.createDataFrame([(0, "dclm", 0, 0.5, ""), (0, "dclm", 1, 0.4, ""), (1, "edu", 0, 0.5, ""), (0, "dclm", 5, 0.5, ""), (0, "dclm", None, 0.5, ""), (0, "dclm", 0, None, ""), (None, None, None, None, ""), (9, "far", 0, 0.5, "")], TARGET)
    got = {(r["criterion"], r["domain"], r["target_fraction"]): r for r in cutoff.cutoffs(awkward, t).collect()}
    assert len(got) == 8
    r = got["dclm", 0, 0.5]
    # All three usable scores are equal: keep all or none, and none is no worse.
    assert (r["usable"], r["kept"], r["share"]) == (3, 0, 0.0)
    assert r["cutoff"] == float("inf")
    assert got["dclm", 1, 0.4]["usable"] == 1
    assert got["edu", 0, 0.5]["usable"] is None
    assert got["far", 0, 0.5]["kept"] is None
    assert {(r["criterion"], r["domain"]) for r in cutoff.missed(cutoff.cutoffs(awkward, t)).collect()} == {("dclm", 0), ("dclm", 1)}
    assert cutoff.cutoffs(none, t).count() == 8
    assert cutoff.cutoffs(awkward, t.where("false")).count() == 0


def test_cutoffs_against_brute_force(spark):
    r = random.Random(3)
    data = [(i, None, None, None, r.randrange(3), [r.choice([0.0, round(r.random(), 1), r.random()])], None, None, 1) for i in range(500)]
    targets = [(0, "c", d, f, "") for d in range(3) for f in (0.0, 0.1, 0.33, 0.5, 0.9, 1.0)]
    for row in cutoff.cutoffs(records(spark, data), spark.createDataFrame(targets, TARGET)).collect():
        s = [x[5][0] for x in data if x[4] == row["domain"]]
        best = min((round(abs(k / len(s) - row["target_fraction"]), 12), k) for k in [0, *(sum(v >= c for v in s) for c in set(s))])
        assert (round(row["gap"], 12), row["kept"]) == best
        assert sum(v >= row["cutoff"] for v in s) == row["kept"]


# 2


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=25), st.integers(60, 90))
def test_plan(counts, capacity):
    lines, bins = pack.plan(counts, capacity)
    filled, large = defaultdict(int), defaultdict(int)
    placed = defaultdict(int)
    for size, a, b, first, each in lines:
        assert (b - a) % each == 0
        assert a == placed[size]
        placed[size] = b
        for k in range((b - a) // each):
            filled[first + k] += each * size
            large[first + k] += each * (3 * size > capacity)
    assert placed == counts
    assert set(filled) == set(range(bins))
    assert all(v <= capacity for v in filled.values())
    assert all(v <= 2 for v in large.values())
    total = sum(k * v for k, v in counts.items())
    assert bins <= 2 * total / capacity + 1


def test_pack(spark, awkward, none):
    specs = spark.createDataFrame([("a", 4, "x"), ("b", 100, "x"), ("a", 3, "x"), (None, 5, "x"), ("c", None, "x"), ("d", 0, "x")], "pack_id string, capacity long, _pack string")
    placed = pack.pieces(awkward, specs)
    rows = placed.collect()
    sizes = {r["row_id"]: r["n"] for r in awkward.select("row_id", common.record_size().alias("n")).collect()}
    for p, cap in (("a", 4), ("b", 100)):
        fill, got = defaultdict(int), defaultdict(int)
        for r in rows:
            if r["pack_id"] == p:
                fill[r["bin"]] += r["tokens"]
                got[r["row_id"]] += r["tokens"]
        assert max(fill.values()) <= cap
        assert sorted(fill) == list(range(len(fill)))
        assert {k: v * (2 if k == 1 else 1) for k, v in sizes.items()} == got
    assert {(r["pack_id"], r["row_id"]) for r in rows if r["pieces"] > 1} == {(p, i) for p, c in (("a", 4), ("b", 100)) for i, n in sizes.items() if n > c}
    seqs = pack.sequences(placed, specs).collect()
    assert all(0 < s["fill"] <= 1 for s in seqs)
    assert pack.pieces(none, specs).count() == 0
    assert pack.pieces(awkward, specs.where("false")).count() == 0


def test_pack_is_tight(spark):
    r = random.Random(5)
    data = [(i, None, "x" * 4 * n, n, 0, [], None, None, 1) for i in range(2000) for n in [min(400, int(r.expovariate(1 / 80)) + 1)]]
    specs = spark.createDataFrame([("p", 513)], "pack_id string, capacity long")
    s = pack.sequences(pack.pieces(records(spark, data), specs), specs)
    assert s.agg(F.avg("fill")).first()[0] > 0.97


# 3


def jaccard_pairs(rows, threshold=0.5, run=3, least=40):
    sets = {i: {tuple(w[k : k + run]) for k in range(len(w) - run + 1)} for i, t in rows if len(w := words(t)) >= least}
    return {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def edited(seed, n=60, vocabulary=300):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(vocabulary)]
    base = [[r.choice(vocab) for _ in range(r.randrange(40, 160))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.randrange(0, 26)):
            k = r.randrange(len(w))
            r.choice([lambda: w.__setitem__(k, r.choice(vocab)), lambda: w.insert(k, r.choice(vocab)), lambda: w.pop(k)])()
        rows.append((i, " ".join(w)))
    rows += [(n, rows[0][1]), (n + 1, rows[0][1].upper()), (n + 2, "same " * 50), (n + 3, "same " * 70), (n + 4, "a b " * 30)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    rows = edited(seed)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "row_id long, text string").repartition(5))
    pairs = {(r["row_id_a"], r["row_id_b"]) for r in got.all_pairs().collect()}
    assert pairs == jaccard_pairs(rows)
    links = defaultdict(set)
    for a, b in pairs:
        links[a].add(b)
        links[b].add(a)
    group = {i: i for i, _ in rows}
    for _ in rows:
        for i in links:
            group[i] = min([group[i], *(group[j] for j in links[i])])
    for r in got.groups().collect():
        assert (r["group_id"], r["links"]) == (group[r["row_id"]], len(links[r["row_id"]]))


def test_near_duplicates_split_frequent_shingles(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT", 4)
    monkeypatch.setattr(neardup, "PAIRS", 50)
    rows = edited(7, 90)
    ours = neardup._postings
    # The executors' copy of the module keeps its own limit, so the split is tried on batches here.
    import numpy as np
    import pyarrow as pa

    sets = [b for b in neardup._sets(3, 40)(iter([pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], ["row_id", "t"])]))]
    counts = np.zeros(1 << 18, dtype=np.int64)
    for b in sets:
        counts += np.bincount(neardup._cell(neardup._unset(b.column(3))[0], 18), minlength=len(counts))
    level = np.where(counts > 1, np.minimum(255, 1 + np.ceil(8 * np.log2(np.maximum(counts, 1)))), counts).astype(np.uint8)
    shared = type("B", (), {"value": level.tobytes()})()
    blocks = defaultdict(list)
    for b in sets:
        for out in ours(shared, 18, counts.sum() / len(counts), 3, 0.5)(iter([b.select([0, 1, 3])])):
            for part, block in zip(out.column(0).to_pylist(), out.column(1)):
                blocks[part].append(block)
    met = defaultdict(list)
    for part, bs in blocks.items():
        t = neardup._meet(2, 0.5)(pa.table({"part": [part] * len(bs), "block": pa.chunked_array([pa.array([x.as_py() for x in bs], pa.binary())])}))
        for p, x in zip(t.column("part").to_pylist(), t.column("block")):
            met[p].append(x.as_py())
    close = set()
    for p, bs in met.items():
        t = neardup._enough(pa.table({"part": [p] * len(bs), "block": pa.array(bs, pa.binary())}))
        close |= set(zip(t.column("a").to_pylist(), t.column("b").to_pylist()))
    want = {p for p in jaccard_pairs(rows)}
    assert want <= close


def test_near_duplicates_edges(spark, awkward, none):
    n = neardup.near_duplicates(awkward.withColumn("a", F.lit(1)).withColumn("n", F.lit(2)), least_words=3)
    assert {tuple(r) for r in n.all_pairs().collect()} == {(1, 2)}
    for r in n.groups().collect():
        assert r["group_id"] == (1 if r["row_id"] < 3 else r["row_id"])
    e = neardup.near_duplicates(none)
    assert e.all_pairs().count() == 0
    assert e.groups().count() == 0


def test_pack_of_arrays():
    import numpy as np

    for a in ([], [1], list(range(1000))):
        x, y = neardup.unpack(neardup.pack(np.array(a, dtype=np.int64), np.array(a, dtype=np.uint32)))
        assert x.tolist() == a == y.tolist()


# 4


MIX = "mix_id string, domain long, weight double, max_repeats int, budget_share double, _d string"


def test_mix(spark):
    r = random.Random(2)
    data = [(i, None, "x" * 4 * n, n, r.choice([0, 0, 0, 1, 2]), [], None, None, 1) for i in range(1500) for n in [r.randrange(1, 400)]]
    t = spark.createDataFrame([("m", 0, 0.2, 1, 0.5, ""), ("m", 1, 0.5, 2, 0.5, ""), ("m", 2, 0.3, 4, 0.5, ""), ("n", 1, 1.0, 1, 0.9, ""), ("n", 7, 0.0, 1, 0.9, ""), ("n", None, 0.1, 1, 0.9, ""), ("o", 9, 1.0, 3, 0.2, "")], MIX)
    m = mix.mix(records(spark, data), t)
    chosen = m.chosen.collect()
    total = sum(x[3] for x in data)
    by = defaultdict(int)
    limits = {("m", 0): 1, ("m", 1): 2, ("m", 2): 4, ("n", 1): 1}
    for c in chosen:
        assert 1 <= c["repeats"] <= limits[c["mix_id"], c["domain"]]
        by[c["mix_id"], c["domain"]] += c["tokens"]
    for d, w in ((0, 0.2), (1, 0.5), (2, 0.3)):
        assert by["m", d] / (0.5 * total) == pytest.approx(w, abs=0.02)
    have = sum(x[3] for x in data if x[4] == 1)
    assert by["n", 1] == have  # too small: all of it, once
    s = {(x["mix_id"], x["domain"]): x for x in m.shares.collect()}
    assert s["n", 1]["too_small"] and not s["m", 1]["too_small"] and s["o", 9]["too_small"]
    assert s["m", 0]["tokens"] == by["m", 0]
    again = mix.mix(records(spark, data).repartition(7), t).chosen
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, chosen))


def test_small_domains_are_those_of_the_totals(spark):
    r = random.Random(4)
    data = [(i, None, "x" * 4 * n, n, r.randrange(9), [], None, None, 1) for i in range(900) for n in [r.randrange(1, 400)]]
    total = [sum(x[3] for x in data if x[4] == d) for d in range(9)]
    rows = [(f"m{k}", d, (w := r.uniform(0.02, 0.2)), r.randrange(0, 4), 0.8, "") for k in range(6) for d in range(9)]
    rows += [("edge", d, 1 / 9, 1, total[d] * 9 / sum(total) * f, "") for d, f in ((0, 1.0001), (1, 0.9999))]
    t = spark.createDataFrame(rows, MIX)
    got = {(x["mix_id"], x["domain"]): x["too_small"] for x in mix.mix(records(spark, data), t).shares.collect()}
    assert got == {(m, d): k * total[d] < w * b * sum(total) for m, d, w, k, b, _ in rows}


def test_mix_edges(spark, awkward, none):
    t = spark.createDataFrame([("m", 0, 1.0, 1, 1.0, "")], MIX)
    assert mix.mix(none, t).chosen.count() == 0
    assert mix.mix(none, t).shares.count() == 1
    assert mix.mix(awkward, t.where("false")).chosen.count() == 0
    assert mix.mix(awkward, t).chosen.select("row_id").distinct().count() == 3


# 5 and 7


@pytest.fixture(scope="module")
def model():
    return bpe.Bpe.from_json()


@pytest.fixture(scope="module")
def known(model):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.DEFAULT_PATH)
    t.encode_special_tokens = True
    return t


TEXTS = ["", None, " ", "Hello world", "<|endoftext|> is text", "a" * 5000, "日本語" * 400, "x​y﻿   z", "line\r\nend\n\n\n  tab\t", "it's we'll I'D", "🎉" * 300, "ab" * 3000, LONG, "\u0001\u0002", "é" * 777]


def test_encode(spark, known):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "null key", "x"), (3, "Hello world", "x")], "doc_id long, text string, ids string")
    got = [(r["doc_id"], list(r["ids"])) for r in encode.encode(df).collect()]
    want = [(i, known.encode(t, add_special_tokens=False).ids if t else []) for i, t in [*enumerate(TEXTS), (None, "null key"), (3, "Hello world")]]
    assert sorted(got, key=str) == sorted(want, key=str)
    back = {r["doc_id"]: r["text"] for r in encode.decode(encode.encode(df.where("doc_id is not null"))).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    assert encode.encode(df.where("false")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_encode_any_text(model, known, text):
    text = text.encode("utf-8", "ignore").decode()
    ids = [i for p in bpe.split(text) for i in model.piece(p)]
    assert ids == known.encode(text, add_special_tokens=False).ids
    assert bpe.Rounds(model).counts([p.encode() for p in bpe.split(text)] or [b"a"]).sum() == (len(ids) or 1)
    d = bpe.Decoder(model)
    assert "".join(d.feed([i]) for i in ids) + d.end() == text


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 97))
def test_stream(model, seed, part):
    r = random.Random(seed)
    data = "".join(r.choice(["a", "e", "th", "日", "é", "zz", "ing", "\u0000"]) for _ in range(r.randrange(1500, 3000))).encode()
    parts = [data[i : i + part] for i in range(0, len(data), part)]
    assert list(model.stream(parts)) == model.merge([model.of_byte[b] for b in data])


def test_long_pieces(model):
    """A piece of 300,000 letters: the transducer in parts and the heap agree, in time in proportion to it."""
    r = random.Random(1)
    text = "".join(r.choice("abcdefgh") for _ in range(300_000))
    data = text.encode()
    ids = model.piece(text)
    assert b"".join(model.tokens[i] for i in ids) == data
    assert ids == tuple(model._merge_long([model.of_byte[b] for b in data]))
    assert ids == tuple(model.stream(data[i : i + 1000] for i in range(0, len(data), 1000)))


@pytest.mark.parametrize("seed", range(20))
def test_merging_by_heap(model, seed):
    r = random.Random(seed)
    ids = [model.of_byte[r.choice(b"aab nthe  ")] for _ in range(r.randrange(1, 128))]
    assert model._merge_long(ids) == model.merge(ids)


def test_tokens(spark, awkward, none, known):
    got = {r["row_id"]: r for r in tokens.tokens(awkward).collect()}
    for r in awkward.collect():
        t = r["text"]
        assert got[r["row_id"]]["tokens"] == (len(known.encode(t, add_special_tokens=False).ids) if t else 0)
    assert got[1]["source"] == got[2]["source"] == "web-one" and got[1]["lang"] == "en"
    assert got[3]["source"] == "unknown" and got[3]["lang"] == "und"
    assert {i for i, r in got.items() if r["distrusted"]} == {2, 3, 4, 5, 6}
    b = tokens.budget(tokens.tokens(awkward))
    assert b.agg(F.sum("records")).first()[0] == 9
    assert tokens.tokens(none).count() == 0


# 6


def keys(spark, n, start=0):
    return spark.createDataFrame([(f"k{i}",) for i in range(start, n)], "key string")


def test_sample_grows(spark):
    a = sample.grow(keys(spark, 500), None, 0.1)
    b = sample.grow(keys(spark, 2000).repartition(9), a, 0.1, run=1)
    one, two = ({r["key"] for r in x.collect()} for x in (a, b))
    assert len(one) == 50 and len(two) == 200 and one <= two
    assert {r["key"] for r in sample.grow(keys(spark, 500).repartition(11), None, 0.1).collect()} == one
    gone = sample.grow(keys(spark, 400, 300), a, 0.1, run=2)
    assert {r["key"] for r in gone.collect()} == one  # never shrinks


def test_sample_edges(spark, awkward, none):
    k = awkward.select(sample.key().alias("key"))
    s = {r["key"] for r in sample.grow(k, None, 1.0).collect()}
    assert "ab12" in s and len(s) == 6  # a null and an empty text share a key
    assert sample.grow(none.select(sample.key().alias("key")), None).count() == 0
    assert sample.grow(spark.createDataFrame([(None,), ("a",), ("a",)], "key string"), None, 1.0).count() == 1
    assert sample.grow(keys(spark, 50), None, 0.0).count() == 0


def test_ledger_at_a_path(spark, tmp_path):
    path = f"{tmp_path}/ledger"
    assert sample.read_ledger(spark, path) is None
    one = {r["key"] for r in sample.update(keys(spark, 500), path, 1).collect()}
    two = sample.update(keys(spark, 2000), path, 2)
    assert len(one) == 50 and two.where("run = 1").count() == 50 and two.count() == 200
    before = sorted(map(tuple, two.collect()))
    assert sorted(map(tuple, sample.update(keys(spark, 9000), path, 2).collect())) == before  # the run is there already
    (tmp_path / "ledger" / "_half-x").mkdir()  # what a lost run may leave
    assert sorted(map(tuple, sample.read_ledger(spark, path).collect())) == before
    assert not shared.publish(keys(spark, 3), f"{path}/run=2")


# 8


def brute_leaks(docs, items, length=12):
    out = set()
    for i, t in items:
        w = words(t)
        n = min(length, len(w))
        grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
        for d, x in docs:
            v = words(x)
            if any(tuple(v[k : k + n]) in grams for k in range(len(v) - n + 1)) and grams:
                out.add((d, i))
    return out


@pytest.mark.parametrize("shortest", [1, 2, 6, 15])
def test_leaks(spark, shortest):
    r = random.Random(shortest)
    vocab = [f"v{i}" for i in range(12)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, text(r.randrange(shortest, shortest + 25))) for i in range(20)]
    docs = [(i, text(r.randrange(0, 80))) for i in range(60)]
    for i in range(60, 90):
        w = words(items[i % 20][1])
        a = r.randrange(len(w))
        docs.append((i, f"{text(9)}, {' '.join(w[a : a + r.randrange(8, 20)])}​! {text(7)}"))
    got = leak.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {tuple(x) for x in got.collect()} == brute_leaks(docs, items)


def test_leak_edges(spark):
    docs = spark.createDataFrame([(1, "one two THREE four"), (None, "one two three four five"), (2, None), (3, ""), (4, LONG), (1, "one two THREE four")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "One, two; three four", 1), (8, "", 1), (9, None, 1), (10, "dolor lorem " * 1, 1), (11, "One two three four", 1)], "item_id long, text string, doc_id long")
    want = {(1, 7), (None, 7), (1, 11), (None, 11), (4, 10)}
    assert {tuple(x) for x in leak.leaks(docs, items).collect()} == want
    assert leak.leaks(docs.where("false"), items).count() == 0
    assert leak.leaks(docs, items.where("false")).count() == 0


# 9


def test_weights_are_fitted():
    a = pii_train.accuracy(__import__("json").loads(pii.WEIGHTS.read_text()), pii_train.trials(123, 1500))
    assert all(p > 0.95 and r > 0.9 for p, r, _ in a.values()), a


def test_find(spark):
    rows = [
        (1, "Write to ann.lee (at) mail.site.example or call +1-202-555-0143. SSN: 912-45-6789"),
        (2, None),
        (3, ""),
        (4, "Posted by Elena Borkriova on day 3\n12b Old Mill Road, Flat 4\nIm Jahr 1893 kam eine Frau"),
        (5, "article no. 00248417L, Order 912-4417-20"),
        (6, LONG),
        (None, "look at example dot com, error at build@360"),
        (1, "plain"),
    ]
    names = spark.createDataFrame([("family", f"{s}{e}", "x") for s in ("Bork", "Kel", "Krihul") for e in ("riova", "ova", "mann", "sen")] + [("given", "Elena", "x"), (None, None, "x"), ("given", " ", "x")], "name_type string, name string, doc_id string")
    got = pii.find(spark.createDataFrame(rows, "doc_id long, text string"), names).collect()
    assert len(got) == 8
    by = {(r["doc_id"], r["redacted"]): [(f["kind"], f["value"]) for f in r["found"]] for r in got}
    assert by[1, "Write to [EMAIL] or call [PHONE]. SSN: [ID]"] == [("email", "ann.lee (at) mail.site.example"), ("phone", "+1-202-555-0143"), ("id", "912-45-6789")]
    assert by[4, "Posted by [NAME] on day 3\n[ADDRESS]\nIm Jahr 1893 kam eine Frau"] == [("name", "Elena Borkriova"), ("address", "12b Old Mill Road, Flat 4")]
    assert by[2, None] == by[3, ""] == by[1, "plain"] == by[6, LONG] == by[5, rows[4][1]] == by[None, rows[6][1]] == []
    for r, (_, t) in zip(got, rows):
        for f in r["found"]:
            assert t[f["start"] : f["start"] + len(f["value"])] == f["value"]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find(empty, names).count() == 0
    assert pii.find(spark.createDataFrame(rows, "doc_id long, text string"), names.where("false")).count() == 8
