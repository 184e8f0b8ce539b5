"""Queries on raw shards, texts and domains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmix.functions import taxonomy, text
from corpusmix.operators import diagnose
from corpusmix.plans.base import POOL, RAW, pool, table
from corpusmix.schema import CRITERIA, DOMAIN_NAMES
from corpusmix.sources import shards

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def raw(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_shard")


@query(f"WITH {RAW} SELECT shard_idx, row_in_shard, domain FROM raw")
def raw_domains(spark, d):
    return raw(spark, d).select("shard_idx", "row_in_shard", taxonomy.domain().alias("domain"))


@query(f"WITH {RAW} SELECT shard_idx, row_in_shard, code, level_1, level_2, substr(code, 1, 2) AS prefix FROM raw")
def raw_labels(spark, d):
    c = taxonomy.code()
    return raw(spark, d).select("shard_idx", "row_in_shard", c.alias("code"), *taxonomy.labels(), F.substring(c, 1, 2).alias("prefix"))


_SIGNALS = ", ".join(f"round(coalesce(quality_signals.fasttext.{c}::float, 0)::double, 6) AS qs_{c}" for c in CRITERIA)


@query(f"SELECT shard_idx, row_in_shard, {_SIGNALS} FROM raw_shard")
def raw_signals(spark, d):
    s = raw(spark, d).select("shard_idx", "row_in_shard", *taxonomy.signals())
    return s.select("shard_idx", "row_in_shard", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in s.columns[2:]])


@query(f"WITH {RAW} SELECT substr(code, 1, 2) AS prefix, count(*) AS records FROM raw WHERE domain < 0 GROUP BY 1")
def discards_by_prefix(spark, d):
    r = raw(spark, d).select(F.substring(taxonomy.code(), 1, 2).alias("prefix"), taxonomy.domain().alias("domain"))
    return r.where("domain < 0").groupBy("prefix").agg(F.count(F.lit(1)).alias("records"))


@query(
    f"WITH {RAW} SELECT md5(text) AS text_md5, coalesce(length(text), 0)::bigint AS doc_char_count, domain, shard_idx, row_number() OVER (PARTITION BY shard_idx ORDER BY row_in_shard, text NULLS FIRST, domain) - 1 AS row_in_shard, {_SIGNALS} FROM raw WHERE domain >= 0"
)
def preprocessed(spark, d):
    p = shards.preprocess(raw(spark, d))
    return p.select(F.md5("text").alias("text_md5"), "doc_char_count", "domain", "shard_idx", "row_in_shard", *[F.round(F.col(f"qs_{c}").cast("double"), 6).alias(f"qs_{c}") for c in CRITERIA])


_INDEX = f"WITH {RAW}, idx AS (SELECT shard_idx, count(*) FILTER (domain >= 0) AS num_docs, count(*) FILTER (domain < 0) AS num_discarded FROM raw GROUP BY 1), spans AS (SELECT shard_idx, num_docs, coalesce(sum(num_docs) OVER (ORDER BY shard_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS start_idx FROM idx)"


@query(_INDEX + " SELECT * FROM idx")
def shard_counts(spark, d):
    return shards.index(raw(spark, d))


@query(
    _INDEX
    + ", kept AS (SELECT shard_idx, num_docs AS stored FROM shard_index QUALIFY row_number() OVER (PARTITION BY shard_idx ORDER BY elapsed_seconds DESC NULLS LAST, num_docs DESC NULLS LAST) = 1) SELECT shard_idx, i.num_docs AS counted, stored FROM idx i FULL JOIN kept USING (shard_idx) WHERE stored IS DISTINCT FROM i.num_docs"
)
def shard_disagreements(spark, d):
    return shards.disagreements(shards.index(raw(spark, d)), table(spark, d, "shard_index"))


@query(_INDEX + " SELECT shard_idx, num_docs, start_idx, start_idx + num_docs AS end_idx FROM spans")
def shard_offsets(spark, d):
    return shards.offsets(shards.index(raw(spark, d)))


@query(_INDEX + ", g AS (SELECT row_id * 7 AS global_idx FROM unified_data) SELECT global_idx, shard_idx, global_idx - start_idx AS row_in_shard FROM g JOIN spans ON global_idx >= start_idx AND global_idx < start_idx + num_docs")
def global_to_shard(spark, d):
    wanted = table(spark, d, "unified_data").select((F.col("row_id") * 7).alias("global_idx"))
    return shards.locate(wanted, shards.offsets(shards.index(raw(spark, d))))


@query(
    f"WITH {RAW}, p AS (SELECT shard_idx, row_number() OVER (PARTITION BY shard_idx ORDER BY row_in_shard, text NULLS FIRST, domain) - 1 AS row_in_shard, text FROM raw WHERE domain >= 0), s AS (SELECT shard_idx, row_in_shard FROM raw_shard) SELECT shard_idx, row_in_shard, md5(p.text) AS text_md5 FROM s JOIN p USING (shard_idx, row_in_shard)"
)
def fetched_texts(spark, d):
    """Repeated keys fetch a text as often as they occur."""
    r = raw(spark, d)
    return shards.fetch(r.select("shard_idx", "row_in_shard"), shards.preprocess(r).select("shard_idx", "row_in_shard", F.md5("text").alias("text_md5")))


@query(_INDEX + " SELECT DISTINCT shard_idx FROM raw_shard WHERE shard_idx NOT IN (SELECT i.shard_idx FROM idx i JOIN shard_index s ON i.shard_idx = s.shard_idx AND i.num_docs = s.num_docs)")
def shards_to_redo(spark, d):
    counted = shards.index(raw(spark, d))
    good = counted.join(table(spark, d, "shard_index").select("shard_idx", "num_docs"), ["shard_idx", "num_docs"])
    return shards.pending(counted.select("shard_idx"), good)


@query(f"WITH {RAW} SELECT level_1, level_2, grouping(level_1, level_2)::int AS level, count(*) AS records FROM raw WHERE code IS NOT NULL GROUP BY ROLLUP (level_1, level_2)")
def taxonomy_rollup(spark, d):
    r = raw(spark, d).select(taxonomy.code().alias("code"), *taxonomy.labels()).where("code is not null")
    return r.rollup("level_1", "level_2").agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("records"))


@query(f"WITH {RAW}, a AS (SELECT level_1, count(DISTINCT level_2) AS level_2s, count(*) AS records FROM raw WHERE code IS NOT NULL GROUP BY 1) SELECT *, round(records / sum(records) OVER (), 9) AS share FROM a")
def taxonomy_coverage(spark, d):
    r = raw(spark, d).select(taxonomy.code().alias("code"), *taxonomy.labels()).where("code is not null")
    a = r.groupBy("level_1").agg(F.countDistinct("level_2").alias("level_2s"), F.count(F.lit(1)).alias("records"))
    return a.join(a.agg(F.sum("records").alias("_all"))).select("level_1", "level_2s", "records", F.round(F.col("records") / F.col("_all"), 9).alias("share"))


@query(f"SELECT shard_idx FROM (SELECT DISTINCT shard_idx, (regexp_extract(path, '_(\\d+)\\.parquet', 1))::bigint AS named FROM shard_index) WHERE shard_idx = named")
def shard_of_file(spark, d):
    s = table(spark, d, "shard_index").select("shard_idx", shards.shard_of_path(F.col("path")).alias("named"))
    return s.where("shard_idx = named").select("shard_idx").distinct()


@query("SELECT row_id, substr(md5(text), 1, 12) AS doc_id FROM unified_data")
def doc_ids(spark, d):
    return table(spark, d, "unified_data").select("row_id", text.doc_id().alias("doc_id"))


_SP = "[\\x{9}-\\x{d}\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


@query(
    "SELECT row_id, greatest(1, floor(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\t-\\r ]+'), lambda w: w <> '')) * 1.3::double))::bigint AS by_words, greatest(1, coalesce(length(text), 0) // 4)::bigint AS by_chars, (coalesce(length(text), 0) // 4)::bigint AS no_floor FROM unified_data"
)
def token_estimates(spark, d):
    n = F.length("text")
    return table(spark, d, "unified_data").select("row_id", text.tokens_by_words().alias("by_words"), text.tokens_by_chars(n).alias("by_chars"), text.tokens_by_chars(n, False).alias("no_floor"))


_REPEAT = f"""dense AS (SELECT doc_id, regexp_replace(text, '{_SP}', '', 'g') AS t FROM documents WHERE length(text) >= 1000),
 chars AS (SELECT doc_id, c, count(*) AS n FROM (SELECT doc_id, unnest(string_split(t, '')) AS c FROM dense WHERE length(t) >= 1000) GROUP BY ALL),
 rep AS (SELECT doc_id FROM chars GROUP BY 1 HAVING max(n) / sum(n)::double > 0.3)"""


@query(f"WITH {_REPEAT} SELECT doc_id FROM rep")
def char_repetition(spark, d):
    return table(spark, d, "documents").where(text.repetitive()).select("doc_id")


@query(
    f"WITH {_REPEAT} SELECT CASE WHEN text IS NULL OR text = '' THEN 'empty' WHEN length(text) > 1000000 THEN 'too_long' WHEN doc_id IN (FROM rep) THEN 'repetition' ELSE 'kept' END AS reason, count(*) AS documents, sum(coalesce(length(text), 0))::bigint AS chars FROM documents GROUP BY 1"
)
def hygiene_reasons(spark, d):
    r = table(spark, d, "documents").select(text.hygiene().alias("reason"), F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    return r.groupBy("reason").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("chars"))


@query(f"WITH {_REPEAT} SELECT doc_id, length(text) // 4 AS tokens FROM documents WHERE length(text) BETWEEN 1 AND 1000000 AND doc_id NOT IN (FROM rep)")
def candidates(spark, d):
    c = table(spark, d, "documents").where(F.length("text").between(1, 1_000_000) & (text.hygiene() == "kept"))
    return c.select("doc_id", text.tokens_by_chars(F.length("text"), False).alias("tokens"))


@query("SELECT item_id, category FROM eval_items WHERE regexp_matches(lower(query), 'which|meant') OR starts_with(lower(coalesce(context, '')), 'if ') AND length(text) >= 20")
def keyword_items(spark, d):
    e = table(spark, d, "eval_items")
    asks = F.exists(F.array(F.lit("which"), F.lit("meant")), lambda k: F.contains(F.lower("query"), k))
    return e.where(F.coalesce(asks, F.lit(False)) | (F.startswith(F.lower(F.coalesce("context", F.lit(""))), F.lit("if ")) & (F.length("text") >= 20))).select("item_id", "category")


@query(
    "WITH t AS (SELECT unnest([100, 500, 1000, 2000, 5000]) AS threshold) SELECT threshold, count(*) FILTER (length(text) <= threshold) AS kept, round(count(*) FILTER (length(text) <= threshold) / count(*)::double, 9) AS kept_share, sum(CASE WHEN length(text) > threshold THEN length(text) // 4 ELSE 0 END)::bigint AS tokens_lost FROM documents, t WHERE length(text) >= 100 GROUP BY 1"
)
def length_thresholds(spark, d):
    n = table(spark, d, "documents").select(F.length("text").alias("n")).where("n >= 100")
    return diagnose.length_thresholds(n, "n", [100, 500, 1000, 2000, 5000])


@query("SELECT source, arg_min(doc_id, doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY source")
def first_of_source(spark, d):
    w = Window.partitionBy("source").orderBy("doc_id")
    t = table(spark, d, "documents").where("text is not null").select("source", "doc_id")
    return t.groupBy("source").agg(F.min("doc_id").alias("doc_id"))


@query("SELECT doc_id, round(length(regexp_replace(text, '[^ -~]', '', 'g')) / length(text)::double, 9) AS share FROM documents WHERE length(text) > 0")
def printable_shares(spark, d):
    return table(spark, d, "documents").where(F.length("text") > 0).select("doc_id", F.round(text.printable_share(), 9).alias("share"))


_NAMES = "dim AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(DOMAIN_NAMES)) + ") t(domain, name))"


@query(f"WITH {_NAMES} SELECT dim.domain::bigint AS domain, name, count(u.row_id) AS records FROM dim LEFT JOIN unified_data u ON u.domain = dim.domain GROUP BY ALL")
def domain_histogram(spark, d):
    return diagnose.domain_histogram(table(spark, d, "unified_data"))


@query(f"WITH {POOL}, a AS (SELECT domain, count(*) AS records, sum(coalesce(length(text), 0))::bigint AS chars, sum(tokens)::bigint AS tokens FROM pool GROUP BY 1) SELECT *, round(tokens / records::double, 9) AS tokens_each, round(100 * records / sum(records) OVER ()::double, 9) AS percent FROM a")
def domain_stats(spark, d):
    return diagnose.domain_stats(pool(spark, d, F.coalesce(F.length("text"), F.lit(0)).alias("chars")))


@query(
    f"WITH {POOL}, a AS (SELECT domain, count(*) AS n FROM pool GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, domain) AS down, row_number() OVER (ORDER BY n, domain) AS up, 100.0::double * n / sum(n) OVER () AS p FROM a) SELECT round(sum(p) FILTER (down <= 3), 6) AS top3, round(sum(p) FILTER (down <= 5), 6) AS top5, round(sum(p) FILTER (down <= 10), 6) AS top10, round(sum(p) FILTER (up <= 5), 6) AS bottom5, count(*) FILTER (p > 0.1) AS above_tenth, round(max(n) / min(n)::double, 6) AS max_min, round(sum(p * p) / 100, 6) AS hhi FROM r"
)
def concentration(spark, d):
    return diagnose.concentration(pool(spark, d))


@query(f"WITH {POOL} SELECT count(*) AS records, sum(coalesce(length(text), 0))::bigint AS chars, sum(tokens)::bigint AS tokens, floor(sum(coalesce(length(text), 0)) / 4.0)::bigint AS tokens_of_chars FROM pool")
def pool_totals(spark, d):
    p = pool(spark, d, F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    return p.agg(F.count(F.lit(1)).alias("records"), F.sum("chars").alias("chars"), F.sum("tokens").alias("tokens"), F.floor(F.sum("chars") / 4).cast("long").alias("tokens_of_chars"))


