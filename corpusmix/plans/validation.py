"""Queries on validation sets, conversations, rows of tokens and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmix.functions.rng import uniform_sql
from corpusmix.functions.text import words
from corpusmix.operators import packing, valset
from corpusmix.plans.base import table
from corpusmix.plans.signals import rounded
from corpusmix.sources import logs, readers
from corpusmix.shared import shared_dir

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


ANSWER_TASKS = ("yes_no",)
WS = "[\\t-\\r ]"
_CLEAN = "regexp_replace(regexp_replace(regexp_replace({x}, '^(Passage|Context|Sentence): ?', ''), '" + WS + "*Answer:" + WS + "*$', ''), '" + WS + "+$', '')"
_ASK = "regexp_replace(concat_ws(' ', context, query), '" + WS + "+$', '')"
PAIRS = f"""g AS (SELECT *, CASE WHEN gold >= 0 AND gold < len(choices) THEN choices[gold + 1] END AS picked, loss_strategy = 'full_seq' AS full_seq FROM eval_items),
 pp AS (SELECT item_id, task, full_seq, coalesce(picked, context) AS context, CASE WHEN regexp_matches(coalesce(picked, context), '{WS}$') THEN '' ELSE ' ' END || answer AS continuation FROM g WHERE task_type = 'schema' AND trim(coalesce(answer, '')) NOT IN ('', '.', ',', '!', '?') AND coalesce(picked, context) IS NOT NULL
 UNION ALL SELECT item_id, task, full_seq, c, CASE WHEN full_seq AND c <> '' THEN ' ' || answer ELSE answer END FROM (SELECT *, coalesce(CASE WHEN full_seq THEN {_CLEAN.format(x='trim(context)')} ELSE trim(context) END, '') AS c FROM g) WHERE task_type = 'language_modeling' AND trim(coalesce(answer, '')) <> ''
 UNION ALL SELECT item_id, task, full_seq, q, CASE WHEN full_seq THEN CASE WHEN task = 'yes_no' THEN chr(10) || 'Answer: ' ELSE ' ' END || said ELSE said END FROM (SELECT *, CASE WHEN full_seq THEN {_CLEAN.format(x=_ASK)} ELSE {_ASK} END AS q, coalesce(picked, answer) AS said FROM g) WHERE task_type = 'multiple_choice' AND coalesce(query, '') <> '' AND trim(coalesce(said, '')) <> '' AND trim(q) <> '')"""


def items(spark, d):
    return table(spark, d, "eval_items")


@query(f"WITH {PAIRS} SELECT item_id, task, context, continuation, full_seq FROM pp")
def eval_pairs(spark, d):
    return valset.pairs(items(spark, d), ANSWER_TASKS)


@query("SELECT item_id, array_to_string(list_transform(string_split(trim(regexp_replace(regexp_replace(context, '\\[[a-z]+\\]', ' ', 'g'), ' +', ' ', 'g')), '. '), lambda s: upper(substr(s, 1, 1)) || substr(s, 2)), '. ') AS context FROM eval_items WHERE context IS NOT NULL")
def clean_contexts(spark, d):
    return items(spark, d).where("context is not null").select("item_id", valset.clean_context(F.col("context")).alias("context"))


@query("SELECT item_id, 'Question: ' || query || chr(10) || 'Answer: ' || answer AS text FROM eval_items WHERE length('Question: ' || query || chr(10) || 'Answer: ' || answer) >= 20")
def qa_texts(spark, d):
    t = items(spark, d).select("item_id", valset.qa_text(F.col("query"), F.col("answer"), "labelled").alias("text"))
    return t.where(F.length("text") >= 20)


@query("SELECT item_id, query || chr(10) || array_to_string(list_transform(choices, lambda c, i: chr((64 + i)::int) || '. ' || c), chr(10)) AS text FROM eval_items WHERE query IS NOT NULL AND choices IS NOT NULL")
def option_texts(spark, d):
    e = items(spark, d).where("query is not null and choices is not null")
    return e.select("item_id", valset.option_text(F.col("query"), F.col("choices")).alias("text"))


@query("SELECT context, choices[gold + 1] AS continuation FROM eval_items WHERE gold >= 0 AND choices[gold + 1] IS NOT NULL")
def choice_items(spark, d):
    return valset.endings(items(spark, d), "context", "choices", "gold")


_TURN = "tn AS (SELECT doc_id, i - 1 AS line, ls[i] AS l FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\r|\\n') AS ls FROM documents WHERE text IS NOT NULL), unnest(range(1, len(ls) + 1)) u(i)), sp AS (SELECT *, regexp_extract(l, '^(<\\|(user|assistant)_start\\|>|(User|Assistant)): ') AS r FROM tn)"


@query(f"WITH {_TURN} SELECT doc_id, line::int AS line, substr(l, length(r) + 1) AS said FROM sp WHERE r <> '' AND contains(lower(r), 'assistant')")
def assistant_turns(spark, d):
    return valset.turns(table(spark, d, "documents"), "doc_id", "text").where("role = 'assistant'").select("doc_id", "line", "said")


_IDS = "list_transform(list_filter(regexp_split_to_array(coalesce({c}, ''), '[\\t-\\r ]+'), lambda w: w <> ''), lambda w: length(w)::int)"


def _ids(c):
    return F.transform(words(F.coalesce(F.col(c), F.lit(""))), lambda w: F.length(w))


#: The block size of the whole items; SHORT shows what a cut does.
BLOCK, SHORT = 2048, 64


def _masked(spark, d, size):
    e = eval_pairs(spark, d).select("item_id", "task", "full_seq", _ids("context").alias("c"), _ids("continuation").alias("a"))
    ids, mask = valset.masked(F.col("c"), F.col("a"), F.col("full_seq"), size)
    return e.select("item_id", "task", ids.alias("ids"), mask.alias("mask"), F.size("c").alias("n_context"), F.size("a").alias("n_answer"))


def _masked_sql(size):
    return f"WITH {PAIRS}, im AS (SELECT item_id, task, full_seq, {_IDS.format(c='context')} AS c, {_IDS.format(c='continuation')} AS a FROM pp), ms AS (SELECT item_id, task, c, a, list_concat(c, a) AS ids, least(len(c) + len(a), {size}) AS n, CASE WHEN full_seq THEN 0 ELSE least(len(c), {size}) END AS st FROM im)"


def _padded_sql(size):
    return _masked_sql(size) + f" SELECT item_id, array_to_string(list_transform(range(1, {size + 1}), lambda i: CASE WHEN i <= n THEN ids[i] ELSE 0 END), ' ') AS token_ids, array_to_string(list_transform(range(0, {size}), lambda i: CASE WHEN i >= st AND i < n THEN '1' ELSE '0' END), '') AS loss_mask FROM ms"


def _padded(spark, d, size):
    m = _masked(spark, d, size)
    return m.select("item_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("token_ids"), F.array_join(F.transform("mask", lambda x: F.when(x, "1").otherwise("0")), "").alias("loss_mask"))


def _mask_stats_sql(size):
    return _masked_sql(size) + f" SELECT task, count(*) AS items, sum(n)::bigint AS tokens, sum(greatest(n - st, 0))::bigint AS loss_tokens, round(avg((len(c) + len(a) > {size})::int), 6) AS cut_share FROM ms GROUP BY 1"


def _mask_stats(spark, d, size):
    m = _masked(spark, d, size)
    n = F.least(F.col("n_context") + F.col("n_answer"), F.lit(size))
    return rounded(m.groupBy("task").agg(F.count(F.lit(1)).alias("items"), F.sum(n).alias("tokens"), F.sum(F.size(F.filter("mask", lambda x: x))).alias("loss_tokens"), F.avg((F.col("n_context") + F.col("n_answer") > size).cast("int")).alias("cut_share")))


@query(_padded_sql(BLOCK))
def padded_items_block(spark, d):
    """Items in the reference's block size, which none of the test items exceeds."""
    return _padded(spark, d, BLOCK)


@query(_padded_sql(SHORT))
def padded_items(spark, d):
    """Only the first 64 words: shows the cut; padded_items_block has the whole items."""
    return _padded(spark, d, SHORT)


@query(_mask_stats_sql(BLOCK))
def mask_token_stats_block(spark, d):
    return _mask_stats(spark, d, BLOCK)


@query(_mask_stats_sql(SHORT))
def mask_token_stats(spark, d):
    """Of the first 64 words; mask_token_stats_block counts the whole items."""
    return _mask_stats(spark, d, SHORT)


@query(f"WITH {PAIRS}, a AS (SELECT task, count(*) AS loaded FROM eval_items GROUP BY 1), v AS (SELECT task, count(*) AS valid, avg(length(context) + length(continuation)) AS avg_chars, avg(length(continuation) / greatest(length(context) + length(continuation), 1)::double) AS answer_share FROM pp GROUP BY 1) SELECT task, loaded, coalesce(valid, 0) AS valid, least(coalesce(valid, 0), 10) AS sampled, coalesce(valid, 0) > 10 AS capped, round(avg_chars, 6) AS avg_chars, round(answer_share, 6) AS answer_share FROM a LEFT JOIN v USING (task)")
def task_metadata(spark, d):
    a = items(spark, d).groupBy("task").agg(F.count(F.lit(1)).alias("loaded"))
    n = F.length("context") + F.length("continuation")
    v = eval_pairs(spark, d).groupBy("task").agg(F.count(F.lit(1)).alias("valid"), F.avg(n).alias("avg_chars"), F.avg(F.length("continuation") / F.greatest(n, F.lit(1))).alias("answer_share"))
    ok = F.coalesce("valid", F.lit(0))
    return rounded(a.join(v, "task", "left").select("task", "loaded", ok.alias("valid"), F.least(ok, F.lit(10)).alias("sampled"), (ok > 10).alias("capped"), "avg_chars", "answer_share"))


@query(f"SELECT task, item_id FROM eval_items QUALIFY row_number() OVER (PARTITION BY task ORDER BY {uniform_sql(42, 'item_id')}, item_id) <= 10")
def cap_per_task(spark, d):
    return valset.cap(items(spark, d).select("task", "item_id"), "task", 10, "item_id")


EQUAL = 400


@query(
    f"WITH n AS (SELECT source, count(*) AS n, {EQUAL} AS t FROM unified_data WHERE source IS NOT NULL GROUP BY 1), a AS (SELECT *, least(t // count(*) OVER (), n) AS g FROM n), b AS (SELECT *, t - sum(g) OVER () AS rest, n - g AS spare, sum(n - g) OVER () AS total FROM a), c AS (SELECT *, g + CASE WHEN rest > 0 AND total > 0 THEN least(spare, rest * spare // total) ELSE 0 END AS h FROM b), e AS (SELECT *, t - sum(h) OVER () - coalesce(sum(n - h) OVER (ORDER BY encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM c), f AS (SELECT source, h + greatest(0, least(room, n - h)) AS quota FROM e), k AS (SELECT source, row_id, row_number() OVER (PARTITION BY source ORDER BY {uniform_sql(42, 'row_id')}, row_id) AS k FROM unified_data) SELECT source, row_id FROM k JOIN f USING (source) WHERE k <= quota"
)
def equal_ratio(spark, d):
    return valset.equal_ratio(table(spark, d, "unified_data").select("source", "row_id"), "source", EQUAL, "row_id")


@query()
def mixed_clusters(spark, d):
    """A set of 100 texts: seven tenths from the pool by domain, three tenths from held-out items by task."""
    a = valset.equal_ratio(table(spark, d, "unified_data").where("domain between 0 and 21").select("domain", F.col("row_id").alias("id")), "domain", 70, "id")
    b = valset.equal_ratio(items(spark, d).select("task", F.col("item_id").alias("id")), "task", 30, "id")
    return a.select(F.lit("pool").alias("part"), F.col("domain").cast("string").alias("cluster"), "id").unionByName(b.select(F.lit("items").alias("part"), F.col("task").alias("cluster"), "id"))


_WL = "list_filter(regexp_split_to_array(lower({c}), '[\\t-\\r ]+'), lambda w: w <> '')"


def _stats_sql(t: str, key: str, by: str) -> str:
    g, j = (f"{by}, ", f"JOIN v USING ({by})") if by else ("", ", v")
    return f"w AS (SELECT {g}text, {_WL.format(c='text')} AS ws FROM {t} WHERE text IS NOT NULL), s AS (SELECT {g}count(*) AS texts, avg(length(text)) AS avg_chars, stddev_pop(length(text)) AS std_chars, min(length(text)) AS min_chars, max(length(text)) AS max_chars, avg(len(ws)) AS avg_words FROM w GROUP BY ALL), v AS (SELECT {g}count(DISTINCT x) AS vocabulary FROM (SELECT {g}unnest(ws) AS x FROM w) GROUP BY ALL), o AS (SELECT {g}texts, avg_chars, std_chars, min_chars, max_chars, avg_words, vocabulary, vocabulary / texts::double AS per_text FROM s {j})"


@query(f"WITH {_stats_sql('eval_items', 'item_id', 'task')} SELECT task, texts, round(avg_chars, 6) AS avg_chars, round(std_chars, 6) AS std_chars, min_chars, max_chars, round(avg_words, 6) AS avg_words, vocabulary, round(per_text, 6) AS per_text FROM o")
def text_stats(spark, d):
    return rounded(valset.text_stats(items(spark, d), ["task"], "text", "item_id"))


@query(
    f"WITH {_stats_sql('eval_items', 'item_id', '')}, "
    + _stats_sql("unified_data", "row_id", "").replace("w AS (", "w2 AS (").replace(" FROM w)", " FROM w2)").replace("s AS (SELECT count", "s2 AS (SELECT count").replace("FROM w GROUP", "FROM w2 GROUP").replace("v AS (SELECT count", "v2 AS (SELECT count").replace("o AS (", "o2 AS (").replace("FROM s , v)", "FROM s2, v2)")
    + ", q AS (SELECT ("
    + " + ".join(f"abs(o.{n} - o2.{n}) / greatest(abs(o.{n}), abs(o2.{n}), 1e-10)" for n in ("avg_chars", "std_chars", "avg_words", "per_text"))
    + ") / 4 AS score FROM o, o2) SELECT round(score, 6) AS score, CASE WHEN score < 0.1 THEN 'close' WHEN score < 0.3 THEN 'usable' ELSE 'different' END AS advice FROM q"
)
def distribution_distance(spark, d):
    a = valset.text_stats(items(spark, d), [], "text", "item_id")
    b = valset.text_stats(table(spark, d, "unified_data"), [], "text", "row_id")
    return rounded(valset.distance(a, b))


@query()
def made_items(spark, d):
    """Items that need no source: copying, arithmetic and brackets."""
    kinds = (("copy", valset.copy_items), ("operators", valset.operator_items), ("brackets", valset.bracket_items))
    parts = [f(spark, 100).select(F.lit(k).alias("task"), "item_id", "context", "continuation") for k, f in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_LAID = f"dw AS (SELECT doc_id, list_concat(['<begin>'], list_filter(regexp_split_to_array(coalesce(text, ''), '{WS}+'), lambda w: w <> '')) AS t FROM documents), ds AS (SELECT doc_id, t, sum(len(t)) OVER (ORDER BY doc_id) - len(t) AS s FROM dw), laid AS (SELECT doc_id, (s + i - 1) // 256 AS row, ((s + i - 1) % 256)::int AS place, t[i] AS token FROM ds, unnest(range(1, len(t) + 1)) u(i))"


def _laid(spark, d):
    return packing.lay(table(spark, d, "documents").select("doc_id", words(F.coalesce("text", F.lit(""))).alias("t")), "doc_id", "t", 256)


@query(
    f"WITH {_LAID}, n AS (SELECT row, place, token, CASE WHEN token IS NOT DISTINCT FROM lag(token) OVER (PARTITION BY row ORDER BY place) THEN 0 ELSE 1 END AS new FROM laid), r AS (SELECT *, sum(new) OVER (PARTITION BY row ORDER BY place) AS run FROM n), l AS (SELECT row, run, count(*) AS len FROM r GROUP BY ALL), m AS (SELECT row, max(len) AS longest_run FROM l GROUP BY 1) SELECT row::bigint AS row, count(*) AS tokens, count(DISTINCT token) AS distinct_tokens, any_value(longest_run) AS longest_run, count(*) FILTER (token = '<begin>') AS documents FROM laid JOIN m USING (row) GROUP BY 1"
)
def token_rows(spark, d):
    return packing.row_stats(_laid(spark, d))


@query(f"WITH {_LAID}, n AS (SELECT row::bigint AS row, token, count(*) AS n FROM laid GROUP BY ALL) SELECT row, row_number() OVER (PARTITION BY row ORDER BY n DESC, encode(token)) AS place, token, n FROM n QUALIFY place <= 5")
def top_tokens(spark, d):
    return packing.top_tokens(_laid(spark, d))


@query(f"WITH {_LAID}, p AS (SELECT row, place, token, sum((token = '<begin>')::int) OVER (PARTITION BY row ORDER BY place)::int AS part FROM laid) SELECT row::bigint AS row, part, count(*)::int AS tokens, md5(string_agg(token, ' ' ORDER BY place)) AS text_md5 FROM p WHERE token <> '<begin>' GROUP BY ALL")
def decoded_rows(spark, d):
    r = packing.decode_rows(_laid(spark, d))
    return r.select("row", "part", "tokens", F.md5("text").alias("text_md5"))


@query(f"WITH {_LAID} SELECT DISTINCT token FROM laid WHERE row % 2 = 0 AND token NOT IN (SELECT token FROM laid WHERE row % 2 = 1)")
def token_difference(spark, d):
    """Tokens of the even rows that no odd row has."""
    l = _laid(spark, d)  # noqa: E741
    return packing.only_in(l.where("row % 2 = 0"), l.where("row % 2 = 1"))


@query("SELECT (doc_id % 8)::int AS reader, count(*) AS docs, sum(coalesce(length(text), 0) // 4)::bigint AS tokens, round(avg(coalesce(length(text), 0) // 4), 6) AS mean, min(coalesce(length(text), 0) // 4) AS least, max(coalesce(length(text), 0) // 4) AS most, round(stddev_pop(coalesce(length(text), 0) // 4), 6) AS std, count(*) FILTER (coalesce(length(text), 0) // 4 > 1024) AS long_docs FROM documents GROUP BY 1")
def reader_stats(spark, d):
    t = table(spark, d, "documents").select((F.col("doc_id") % 8).cast("int").alias("reader"), F.expr("coalesce(length(text), 0) div 4").alias("n"))
    return rounded(packing.reader_stats(t, "reader", "n", 512))


@query("SELECT doc_id, length(text) // 4 AS tokens FROM documents WHERE length(text) // 4 > 2000")
def slow_documents(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.expr("length(text) div 4").alias("tokens"))
    return t.where("tokens > 2000")


@query()
def best_fit_rows(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.expr("coalesce(length(text), 0) div 4").alias("n"))
    return packing.best_fit(t, "doc_id", "n", 8, 1024)


_LINES = "ll AS (SELECT doc_id, i, ls[i] AS l FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\r|\\n') AS ls FROM documents WHERE text IS NOT NULL), unnest(range(1, len(ls) + 1)) u(i))"
_STEP = logs.STEP.replace("'", "''")


@query(
    f"WITH {_LINES}, st AS (SELECT doc_id, i, "
    + ", ".join(f"regexp_extract(l, '{_STEP}', {g}) AS g{g}" for g in range(1, 6))
    + f" FROM ll WHERE regexp_matches(l, '{_STEP}')), pm AS (SELECT doc_id, arg_max(regexp_extract(l, '{logs.MEMORY}', 1)::double, i) AS peak_mib FROM ll WHERE regexp_matches(l, '{logs.MEMORY}') GROUP BY 1) SELECT doc_id, count(*) AS steps, arg_max(g1::bigint, i) AS last_step, arg_max(g2::bigint, i) AS num_steps, arg_max(g3::double, i) AS loss, arg_max(replace(g4, ',', '')::bigint, i) AS tok_per_sec, arg_max(g5::double, i) AS mfu, any_value(peak_mib) AS peak_mib FROM st LEFT JOIN pm USING (doc_id) GROUP BY 1"
)
def train_logs(spark, d):
    return logs.train_log(table(spark, d, "documents"), "doc_id", "text")


_TASK = logs.TASK.replace("'", "''")


@query(
    f"WITH {_LINES}, ev AS (SELECT doc_id, i, regexp_extract(l, '{_TASK}', 1) AS task, regexp_extract(l, '{_TASK}', 2)::double AS accuracy, regexp_extract(l, '{_TASK}', 3)::double AS centered, regexp_extract(l, '{_TASK}', 4)::double AS seconds FROM ll WHERE regexp_matches(l, '{_TASK}')) SELECT doc_id, task, arg_max(accuracy, i) AS accuracy, arg_max(centered, i) AS centered, arg_max(seconds, i) AS seconds FROM ev GROUP BY ALL"
)
def eval_logs(spark, d):
    return logs.eval_log(table(spark, d, "documents"), "doc_id", "text")


@query(
    f"WITH {_LINES}, v AS (SELECT doc_id, i, CASE WHEN regexp_matches(l, '{logs.CORE}') THEN regexp_extract(l, '{logs.CORE}', 1)::double END AS core, CASE WHEN regexp_matches(l, '{logs.CORE_STEP}') THEN regexp_extract(l, '{logs.CORE_STEP}', 1)::bigint END AS core_step, CASE WHEN regexp_matches(l, '{logs.MINUTES}') THEN regexp_extract(l, '{logs.MINUTES}', 1)::double END AS minutes FROM ll WHERE regexp_matches(l, '{logs.CORE}|{logs.MINUTES}')) SELECT doc_id, arg_max(core, i) AS core, arg_max(core_step, i) AS core_step, arg_max(minutes, i) AS minutes FROM v GROUP BY 1"
)
def run_logs(spark, d):
    return logs.run_log(table(spark, d, "documents"), "doc_id", "text")


@query("SELECT count(*) AS records, count(DISTINCT substr(md5(text), 1, 12)) AS ids, sum(greatest(1, floor(len(list_filter(regexp_split_to_array(text, '[\\t-\\r ]+'), lambda w: w <> '')) * 1.3::double)))::bigint AS tokens FROM documents WHERE text IS NOT NULL")
def jsonl_round_trip(spark, d):
    """Texts written as JSON lines and read again through the readers."""
    path = f"{shared_dir(spark)}/round-trip-{spark.sparkContext.applicationId}.jsonl"
    table(spark, d, "documents").where("text is not null").select(F.col("text").alias("content")).write.mode("overwrite").json(path)
    r = readers.read(spark, path, schema="content string")
    return r.agg(F.count(F.lit(1)).alias("records"), F.countDistinct("doc_id").alias("ids"), F.sum("token_count").alias("tokens"))
