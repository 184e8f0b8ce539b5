"""Validation items keep their answers."""

from pyspark.sql import functions as F

from corpusmix.plans import catalog, validation


def test_blocks_hold_whole_items(spark, sf_dir):
    s = catalog.QUERIES["mask_token_stats_block"](spark, sf_dir).collect()
    assert s and all(r["cut_share"] == 0 for r in s)
    pairs = validation.eval_pairs(spark, sf_dir).select("item_id", F.size(validation._ids("context")).alias("c"), F.size(validation._ids("continuation")).alias("a"), "full_seq")
    assert pairs.where("c + a > 64").count() > 0
    for r in catalog.QUERIES["padded_items_block"](spark, sf_dir).join(pairs, "item_id").collect():
        assert len(r["token_ids"].split(" ")) == len(r["loss_mask"]) == 2048
        assert r["loss_mask"].rstrip("0") == ("1" * (r["c"] + r["a"]) if r["full_seq"] else "0" * r["c"] + "1" * r["a"])


def test_items_past_the_size_are_cut(spark, tmp_path):
    row = [("i", "t", "language_modeling", "one two three", "", "four five", None, -1, "answer_only")]
    spark.createDataFrame(row, "item_id string, task string, task_type string, context string, query string, answer string, choices array<string>, gold int, loss_strategy string").write.parquet(f"{tmp_path}/eval_items.parquet")
    got = {n: tuple(validation._padded(spark, str(tmp_path), n).select("token_ids", "loss_mask").first()) for n in (2, 4, 6)}
    assert got == {2: ("3 3", "00"), 4: ("3 3 5 4", "0001"), 6: ("3 3 5 4 4 0", "000110")}
