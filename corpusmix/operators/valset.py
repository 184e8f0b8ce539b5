"""Validation sets: from records of questions, passages and conversations to texts, tokens and loss masks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmix.functions.rng import uniform
from corpusmix.functions.text import words
from corpusmix.operators.order import number_rows

#: What no continuation consists of.
BARE = ("", ".", ",", "!", "?")


def _rtrim(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+$", "")


def clean_prefix(c: Column) -> Column:
    """Without a leading 'Passage:', 'Context:' or 'Sentence:' and one blank, and a trailing 'Answer:'."""
    return _rtrim(F.regexp_replace(F.regexp_replace(c, r"^(?:Passage|Context|Sentence): ?", ""), r"\s*Answer:\s*$", ""))


def clean_context(c: Column) -> Column:
    """Without bracketed tags, with single blanks, and with a capital at the start of each sentence."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(c, r"\[[a-z]+\]", " "), r" +", " "))
    up = lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 30))
    return F.array_join(F.transform(F.split(flat, r"\. "), up), ". ")


def choice(c: str | Column, i: str | Column) -> Column:
    """The choice at a place from 0; null where there is none."""
    i = F.col(i) if isinstance(i, str) else i
    return F.when(i >= 0, F.try_element_at(c, i + 1))


def lettered_choice(query: str, letter: str) -> Column:
    """The text behind the line 'X.' or 'X)' of a query, X being the letter; null where there is no such line."""
    lines = F.filter(F.split(query, r"\n"), lambda x: F.substring(x, 1, 1).eqNullSafe(F.col(letter)) & F.substring(x, 2, 1).isin(".", ")"))
    return F.trim(F.regexp_replace(F.try_element_at(lines, F.lit(1)), r"^.[.)]", ""))


def pairs(items: DataFrame, answer_tasks: tuple[str, ...] = ()) -> DataFrame:
    """item_id, task, context, continuation, full_seq of the items that make a pair.

    items: item_id, task, task_type, loss_strategy, context, query, choices, gold, answer. A schema
    takes the context that gold chooses, or the only one; multiple choice takes the choice gold names,
    or the answer. Continuations that are blank or a mark, and questions without text, make none.
    Where the whole sequence counts, a blank or, for answer_tasks, a line with 'Answer: ' joins both.
    """
    full = F.col("loss_strategy") == "full_seq"
    gold = choice("choices", "gold")
    ctx = F.coalesce(gold, "context")
    schema = F.when(~F.trim(F.coalesce("answer", F.lit(""))).isin(*BARE) & ctx.isNotNull(), F.struct(ctx.alias("context"), F.concat(F.when(ctx.rlike(r"\s$"), F.lit("")).otherwise(F.lit(" ")), "answer").alias("continuation")))
    plain = F.coalesce(F.when(full, clean_prefix(F.trim("context"))).otherwise(F.trim("context")), F.lit(""))
    lm = F.when(F.trim(F.coalesce("answer", F.lit(""))) != "", F.struct(plain.alias("context"), F.when(full & (plain != ""), F.concat(F.lit(" "), "answer")).otherwise(F.col("answer")).alias("continuation")))
    ask = _rtrim(F.concat_ws(" ", "context", "query"))
    ask = F.when(full, clean_prefix(ask)).otherwise(ask)
    said = F.coalesce(gold, "answer")
    between = F.when(F.col("task").isin(*answer_tasks), "\nAnswer: ").otherwise(" ") if answer_tasks else F.lit(" ")
    mc = F.when((F.coalesce("query", F.lit("")) != "") & (F.trim(F.coalesce(said, F.lit(""))) != "") & (F.trim(ask) != ""), F.struct(ask.alias("context"), F.when(full, F.concat(between, said)).otherwise(said).alias("continuation")))
    pair = F.when(F.col("task_type") == "schema", schema).when(F.col("task_type") == "language_modeling", lm).when(F.col("task_type") == "multiple_choice", mc)
    return items.select("item_id", "task", pair.alias("_p"), full.alias("full_seq")).where("_p is not null").select("item_id", "task", "_p.context", "_p.continuation", "full_seq")


def qa_text(question: Column, answer: Column, style: str = "plain") -> Column:
    """One text of a question and an answer. styles: plain, labelled, dialogue."""
    if style == "plain":
        return F.concat_ws("\n", question, answer)
    a, b = {"labelled": ("Question: ", "Answer: "), "dialogue": ("User: ", "Assistant: ")}[style]
    return F.concat(F.lit(a), question, F.lit("\n" + b), answer)


def option_text(query: Column, choices: Column) -> Column:
    """A query and its choices on lettered lines."""
    lines = F.transform(choices, lambda c, i: F.concat(F.char(i + 65), F.lit(". "), c))
    return F.concat_ws("\n", query, F.array_join(lines, "\n"))


def endings(df: DataFrame, context: str, options: str, label: str) -> DataFrame:
    """Items of a context and endings (story completion, commonsense, physical and open-book questions)."""
    return df.select("*", F.col(context).alias("_c"), choice(options, F.expr(f"try_cast({label} as int)")).alias("_e")).where("_e is not null").select(F.col("_c").alias("context"), F.col("_e").alias("continuation"))


def blank(df: DataFrame, sentence: str, options: str, label: str) -> DataFrame:
    """Items of a sentence with a gap '_': the text up to and with the chosen filling, and the rest."""
    pick = choice(options, F.expr(f"try_cast({label} as int)"))
    at = F.locate("_", F.col(sentence))
    d = df.select(F.col(sentence).alias("_s"), pick.alias("_p"), at.alias("_at")).where("_p is not null and _at > 0")
    return d.select(F.expr("concat(substring(_s, 1, _at - 1), _p)").alias("context"), F.expr("substring(_s, _at + 1)").alias("continuation"))


def cause(df: DataFrame, premise: str, options: str, label: str, ask: str) -> DataFrame:
    """Items of a premise and its cause or effect, joined by 'because' or 'so'."""
    join = F.when(F.col(ask) == "cause", " because ").otherwise(" so ")
    pick = choice(options, F.expr(f"try_cast({label} as int)"))
    return df.select(F.concat(F.regexp_replace(premise, r"[.]\s*$", ""), join).alias("context"), pick.alias("continuation")).where("continuation is not null")


def passages(df: DataFrame, passage: str, question: str, answer: Column) -> DataFrame:
    """Items of a passage, a question and an answer in words (yes or no, spans)."""
    return df.select(F.concat(passage, F.lit("\nQuestion: "), question, F.lit("\nAnswer:")).alias("context"), F.concat(F.lit(" "), answer).alias("continuation")).where("continuation is not null")


def dialogues(df: DataFrame, key: str, story: str, questions: str, answers: str) -> DataFrame:
    """Each question of a story with the questions and answers before it."""
    d = df.select(key, story, F.arrays_zip(F.col(questions).alias("q"), F.col(answers).alias("a")).alias("_qa"))
    d = d.select(key, story, "_qa", F.posexplode("_qa").alias("turn", "_t"))
    before = F.transform(F.slice("_qa", F.lit(1), F.col("turn")), lambda x: F.concat(F.lit("\nQ: "), x["q"], F.lit("\nA: "), x["a"]))
    return d.select(key, "turn", F.concat(F.col(story), F.array_join(before, ""), F.lit("\nQ: "), F.col("_t.q"), F.lit("\nA:")).alias("context"), F.concat(F.lit(" "), F.col("_t.a")).alias("continuation"))


def turns(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line, role, said of conversations written as lines 'User: ...' or '<|user_start|>: ...'."""
    rows = df.select(key, F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("line", "_l"))
    role = F.regexp_extract("_l", r"^(?:<\|(user|assistant)_start\|>|(User|Assistant)): ", 0)
    r = rows.withColumn("_r", role).where("_r <> ''")
    return r.select(key, "line", F.when(F.lower("_r").contains("assistant"), "assistant").otherwise("user").alias("role"), F.expr("substring(_l, length(_r) + 1)").alias("said"))


def pad(ids: Column, size: int, with_id: int = 0) -> Column:
    """Cut or filled up to size."""
    cut = F.slice(ids, 1, size)
    return F.concat(cut, F.array_repeat(F.lit(with_id), F.lit(size) - F.size(cut)))


def masked(context: Column, continuation: Column, full: Column, size: int) -> tuple[Column, Column]:
    """token_ids and loss_mask: the mask is set on the continuation, or on all where full, never on filling."""
    ids = F.concat(context, continuation)
    n = F.least(F.size(ids), F.lit(size))
    start = F.when(full, 0).otherwise(F.least(F.size(context), n))
    return pad(ids, size), F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i >= start) & (i < n))


def cap(df: DataFrame, by: str, n: int, key: str, seed: int = 42) -> DataFrame:
    """At most n rows of each group, those of lowest hash."""
    return number_rows(df.withColumn("_u", uniform(seed, key)), [by], ["_u", key], rank="_k").where(F.col("_k") < n).drop("_u", "_k")


def allocate(sizes: dict[str, int], target: int) -> dict[str, int]:
    """Equal shares of a target; what small sources lack goes to the others in proportion to what they have
    left, rounded down, and the remainder to the first ones by name."""
    sizes = {k: sizes[k] for k in sorted(sizes) if sizes[k]}
    if not sizes:
        return {}
    share = target // len(sizes)
    got = {k: min(share, n) for k, n in sizes.items()}
    rest = target - sum(got.values())
    spare = {k: n - got[k] for k, n in sizes.items()}
    total = sum(spare.values())
    if rest > 0 and total:
        for k, s in spare.items():
            got[k] += min(s, rest * s // total)
    for k, n in sizes.items():
        rest = target - sum(got.values())
        got[k] += max(0, min(rest, n - got[k]))
    return got


def equal_ratio(df: DataFrame, by: str, target: int, key: str, seed: int = 42) -> DataFrame:
    """About target rows, as equal as can be from each group, by hash. Counts of groups go to the driver."""
    d = df.where(F.col(by).isNotNull())
    got = allocate({str(r[0]): r[1] for r in d.groupBy(by).count().collect()}, target)
    n = number_rows(d.withColumn("_u", uniform(seed, key)), [by], ["_u", key], rank="_k")
    limits = df.sparkSession.createDataFrame(list(got.items()), "_by string, _limit long")
    return n.join(F.broadcast(limits), F.col(by).cast("string") == F.col("_by")).where("_k < _limit").drop("_u", "_k", "_by", "_limit")


def text_stats(df: DataFrame, by: list[str], text: str, key: str) -> DataFrame:
    """Texts, their mean, deviation, least and most characters, mean words, distinct lower-case words, and those for a text."""
    t = df.where(F.col(text).isNotNull()).withColumn("_w", words(F.lower(text)))
    s = t.groupBy(*by).agg(F.count(F.lit(1)).alias("texts"), F.avg(F.length(text)).alias("avg_chars"), F.stddev_pop(F.length(text)).alias("std_chars"), F.min(F.length(text)).cast("long").alias("min_chars"), F.max(F.length(text)).cast("long").alias("max_chars"), F.avg(F.size("_w")).alias("avg_words"))
    v = t.select(*by, F.explode(F.array_distinct("_w")).alias("_w")).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("vocabulary"))
    j = s.join(v, by, "left") if by else s.crossJoin(v)  # a row each
    v0 = F.coalesce("vocabulary", F.lit(0))
    return j.withColumn("vocabulary", v0).withColumn("per_text", v0 / F.col("texts"))


def distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the mean relative difference of four statistics of two text_stats rows, and what it suggests."""
    names = ("avg_chars", "std_chars", "avg_words", "per_text")
    j = a.select(*[F.col(n).alias(f"a_{n}") for n in names]).crossJoin(b.select(*[F.col(n).alias(f"b_{n}") for n in names]))
    parts = [F.abs(F.col(f"a_{n}") - F.col(f"b_{n}")) / F.greatest(F.abs(f"a_{n}"), F.abs(f"b_{n}"), F.lit(1e-10)) for n in names]
    j = j.select((sum(parts[1:], parts[0]) / len(names)).alias("score"))
    return j.withColumn("advice", F.when(F.col("score") < 0.1, "close").when(F.col("score") < 0.3, "usable").otherwise("different"))


def copy_items(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """Made items: a word to be repeated a number of times."""
    d = spark.range(n).withColumnRenamed("id", "item_id")
    times = (2 + F.floor(uniform(seed, F.lit("t"), "item_id") * 4)).cast("int")
    word = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("item_id").cast("string"))), 1, 5)
    return d.select("item_id", F.concat(F.lit("Repeat "), word, F.lit(" "), times.cast("string"), F.lit(" times:")).alias("context"), F.concat(F.lit(" "), F.array_join(F.array_repeat(word, times), " ")).alias("continuation"))


def operator_items(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """Made items: a sum, difference or product of two numbers."""
    d = spark.range(n).withColumnRenamed("id", "item_id")
    a, b, o = ((uniform(seed, F.lit(x), "item_id") * m).cast("int") for x, m in (("a", 90), ("b", 90), ("o", 3)))
    d = d.select("item_id", (a + 10).alias("_a"), (b + 10).alias("_b"), o.alias("_o"))
    r = F.when(F.col("_o") == 0, F.col("_a") + F.col("_b")).when(F.col("_o") == 1, F.col("_a") - F.col("_b")).otherwise(F.col("_a") * F.col("_b"))
    return d.select("item_id", F.concat_ws(" ", F.col("_a").cast("string"), F.element_at(F.array(F.lit("+"), F.lit("-"), F.lit("*")), F.col("_o") + 1), F.col("_b").cast("string"), F.lit("=")).alias("context"), F.concat(F.lit(" "), r.cast("string")).alias("continuation"))


def bracket_items(spark: SparkSession, n: int, length: int = 12, seed: int = 0) -> DataFrame:
    """Made items: nested brackets, and what closes them. Each depends on its number and the seed only."""
    import random

    def make(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            rows = []
            for i in p["id"]:
                r, out, stack = random.Random(int(i) * 1_000_003 + seed), [], []
                for _ in range(length):
                    if stack and r.random() < 0.4:
                        out.append(stack.pop())
                    else:
                        a, b = r.choice(["()", "[]", "{}", "<>"])
                        out.append(a)
                        stack.append(b)
                rows.append((int(i), " ".join(out), " " + " ".join(reversed(stack))))
            yield pd.DataFrame(rows, columns=["item_id", "context", "continuation"])

    return spark.range(n).mapInPandas(make, "item_id bigint, context string, continuation string").where("trim(continuation) <> ''")
