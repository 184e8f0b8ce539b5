"""Readers, writers, shards and the incremental stream."""

import pytest
from pyspark.sql import functions as F

from corpusmix.operators import packing
from corpusmix.sources import readers, shards, writers
from corpusmix.streaming import incremental


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([("One, two", 3), ('A "b"\nc', None), ("", 5)], "text string, domain long")


@pytest.mark.parametrize("kind", ["parquet", "jsonl"])
def test_round_trip(spark, docs, tmp_path, kind):
    path = f"{tmp_path}/x.{kind}"
    writers.save(docs, path, kind)
    got = readers.read(spark, path)
    assert got.columns == ["text", "doc_id", "token_count", "domain"]
    assert sorted((r["text"], r["domain"]) for r in got.collect()) == [("", 5), ('A "b"\nc', -1), ("One, two", 3)]


def test_csv(spark, docs, tmp_path):
    path = f"{tmp_path}/x.csv"
    writers.save(docs, path, "csv")
    assert sorted((r["text"] or "", r["domain"]) for r in readers.read(spark, path).collect()) == [("", 5), ('A "b"\nc', -1), ("One, two", 3)]


def test_txt(spark, tmp_path):
    p = tmp_path / "x.txt"
    p.write_text("one\n\n  two \n")
    assert sorted(r["text"] for r in readers.read(spark, str(p)).collect()) == ["one", "two"]
    assert [r["text"] for r in readers.read(spark, str(p), mode="single").collect()] == ["one\n\n  two \n"]


def test_names(spark, tmp_path):
    spark.createDataFrame([("x", "7", 4)], "Content string, label string, length long").write.parquet(f"{tmp_path}/a")
    r = readers.read(spark, f"{tmp_path}/a", "parquet").first()
    assert (r["text"], r["domain"], r["token_count"]) == ("x", 7, 4)
    with pytest.raises(ValueError):
        readers.unify(spark.range(1))
    with pytest.raises(ValueError):
        readers.reader_of("x.doc")
    readers.register("doc", readers.read_txt, ".doc")
    assert readers.reader_of("x.doc") is readers.read_txt


def test_shard_names(spark):
    df = spark.createDataFrame([("/a/train-00012-of-03291.parquet",), ("preprocessed_00007.parquet",), ("x",)], "p string")
    assert [r[0] for r in df.select(shards.shard_of_path(F.col("p"))).collect()] == [12, 7, None]


def test_locate_across_cells(spark):
    spans = shards.offsets(spark.createDataFrame([(0, 100_000), (1, 0), (2, 70_000)], "shard_idx long, num_docs long"))
    g = spark.createDataFrame([(0,), (99_999,), (100_000,), (169_999,), (170_000,), (-1,)], "global_idx long")
    assert sorted(map(tuple, shards.locate(g, spans).collect())) == [(0, 0, 0), (99_999, 0, 99_999), (100_000, 2, 0), (169_999, 2, 69_999)]


def test_save_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(7)], "id long, text string")
    writers.save_shards(df, "id", f"{tmp_path}/s", 3)
    assert sorted((r["shard"], r["text"]) for r in spark.read.parquet(f"{tmp_path}/s").collect()) == [(i // 3, f"t{i}") for i in range(7)]


def test_report(spark):
    df = spark.createDataFrame([("a", 1.5), (None, None)], "k string, v double")
    assert "| a | 1.5 |" in writers.report("R", {"T": df})
    assert '"k": "a"' in writers.summary_json(df)


def test_incremental(spark, sf_dir, tmp_path):
    raw = spark.read.parquet(f"{sf_dir}/raw_shard.parquet")
    source, out, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    raw.write.parquet(source)
    incremental.run(spark, source, out, state)
    want = shards.preprocess(raw).count()
    assert spark.read.parquet(out).count() == want
    incremental.run(spark, source, out, state)  # nothing new
    assert spark.read.parquet(out).count() == want
    raw.withColumn("shard_idx", F.col("shard_idx") + 100).write.mode("append").parquet(source)
    incremental.run(spark, source, out, state)
    assert spark.read.parquet(out).count() == 2 * want
    assert incremental.windowed_counts(spark.read.parquet(f"{sf_dir}/events.parquet")).agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf_dir}/events.parquet").where("ts is not null").count()


def test_best_fit(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([9, 5, 3, 30, 0, None])], "id long, n long")
    got = packing.best_fit(df, "id", "n", 1, 15).collect()
    assert len(got) == 6
    rows = {}
    for r in got:
        rows[r["row"]] = rows.get(r["row"], 0) + r["used"]
    assert all(v <= 16 for v in rows.values())
    assert packing.best_fit(df.where("false"), "id", "n", 1, 15).collect() == []


def test_best_fit_streams_as_a_reader(spark):
    """Against the plain rule, with more documents than a batch holds and several readers."""
    import random

    r = random.Random(5)
    data = [(i, r.choice([None, -3, *range(60)])) for i in range(3000)]
    got = {x["id"]: (x["reader"], x["row"], x["used"]) for x in packing.best_fit(spark.createDataFrame(data, "id long, n long").repartition(5), "id", "n", 3, 40, buffer=8).collect()}
    want = {}
    for reader in range(3):
        docs = [(i, max(n or 0, 0) + 1) for i, n in data if i % 3 == reader]
        held, row, room = [], 0, 41
        while docs or held:
            while docs and len(held) < 8:
                held.append(docs.pop(0))
            fits = [d for d in held if d[1] <= room]
            d = max(fits, key=lambda d: (d[1], -d[0])) if fits else min(held, key=lambda d: (d[1], d[0]))
            held.remove(d)
            want[d[0]] = (reader, row, min(d[1], room))
            room -= min(d[1], room)
            if room == 0:
                row, room = row + 1, 41
    assert got == want


def test_reports_refuse_to_cut(spark):
    from corpusmix.sources import writers

    assert writers.summary_json(spark.range(2)).count("id") == 2
    for f in (writers.summary_json, lambda df: writers.report("t", {"x": df})):
        with pytest.raises(ValueError):
            f(spark.range(writers.SMALL + 1))


def test_tsv_and_input_key(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("text\tdomain\none, two\t3\n")
    (tmp_path / "b.jsonl").write_text('{"input": "x y"}\n')
    assert [(r["text"], r["domain"]) for r in readers.read(spark, f"{tmp_path}/a.tsv").collect()] == [("one, two", 3)]
    assert [r["text"] for r in readers.read(spark, f"{tmp_path}/b.jsonl").collect()] == ["x y"]


def test_doctored_index_is_found_out(spark):
    counted = spark.createDataFrame([(0, 5), (1, 6), (2, 7)], "shard_idx long, num_docs long")
    stored = spark.createDataFrame([(0, 5, 1.0), (1, 9, 1.0), (1, 6, 0.5), (3, 1, None), (3, 2, None)], "shard_idx long, num_docs long, elapsed_seconds double")
    got = {tuple(r) for r in shards.disagreements(counted, stored).select("shard_idx", "counted", "stored").collect()}
    assert got == {(1, 6, 9), (2, 7, None), (3, None, 2)}
    assert [r["shard_idx"] for r in shards.pending(counted, stored).collect()] == [2]


def test_logs_with_blanks_in_tasks(spark):
    from corpusmix.sources import logs

    text = "Evaluating: hella swag (10-shot, x)... accuracy: 0.51 | centered: -0.2 | time: 3.5s\nStep 00007 | CORE metric: 0.25\nTotal training time: 12.5m"
    df = spark.createDataFrame([(1, text), (2, "none")], "doc_id long, text string")
    assert [tuple(r) for r in logs.eval_log(df, "doc_id", "text").collect()] == [(1, "hella swag", 0.51, -0.2, 3.5)]
    assert [tuple(r) for r in logs.run_log(df, "doc_id", "text").collect()] == [(1, 0.25, 7, 12.5)]
