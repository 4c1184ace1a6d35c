"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact_dedup, html_text, language_id, licenses, mixing, near_dedup, packing, topk, url_filters
from .common import table


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=4, percent=80)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    back = chat.read_back(chat.format_windows(turns.unionByName(control)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = back.select("conv_id", "formatted_chars", F.size("turns").alias("n"), F.struct("window", said.alias("said"), F.array_join("targets", "").alias("target")).alias("p"))
    whole = parts.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("formatted_chars").alias("formatted_chars"), F.array_sort(F.collect_list("p")).alias("p"))
    joined = lambda f: F.array_join(F.transform("p", lambda x: x[f]), "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return whole.select("conv_id", F.col("n_turns").cast("long"), digest(joined("said")).alias("turns_sha256"), F.char_length(joined("target")).cast("long").alias("loss_chars"), digest(joined("target")).alias("loss_sha256"), F.col("formatted_chars").cast("long"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(exact_dedup.normalized(F.col("text")).cast("binary"), 256)
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), extra={"text_sha256": digest})


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


#: The rules of the url contract.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (doc_id; source as host) and pages (page_id; url and markup) together. lang only teaches: it is no evidence."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    model = language_id.fit(docs)
    url = F.coalesce("url", F.lit(""))
    host = url_filters.host_of(url)
    markup = F.nullif(F.regexp_extract("html", r"(?i)<html[^>]*\slang\s*=\s*[\"']?([a-z]+)", 1), F.lit(""))
    suffix, folder = F.substring_index(host, ".", -1), F.regexp_extract(url_filters.path_of(url), r"^/([a-zA-Z]{2})(?:/|$)", 1)
    named = F.when(suffix.isin(model.languages or [""]), suffix).when(folder != "", folder)
    null = lambda kind: F.lit(None).cast(kind)
    a = docs.select("doc_id", null("long").alias("page_id"), "text", F.col("source").alias("host"), null("string").alias("declared"), null("string").alias("named"))
    b = pages.select(null("long").alias("doc_id"), "page_id", html_text.visible_text("html").alias("text"), host.alias("host"), markup.alias("declared"), named.alias("named"))
    return language_id.identify(a.unionByName(b), model, ["doc_id", "page_id"])


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_minhash_near_dedup, op2_chat_formatting, op3_exact_dedup, op4_html_extraction, op5_url_filter, op6_language_id, op7_exact_top_k, op8_license_scan, op9_source_mixing, op10_best_fit_packing)
}

ORACLES = {
    "op1_minhash_near_dedup": r"""
        WITH RECURSIVE w AS (SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
             s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                     ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] FOR i IN range(1, len(w) - 2)]) END AS s FROM w),
             n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
             x AS (SELECT doc_id, unnest(s) AS sh FROM s),
             c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM x a JOIN x b USING (sh) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
             l AS (SELECT u, v FROM c JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * shared >= 80 * (a.n + b.n - shared)),
             r AS (SELECT doc_id AS u, doc_id AS v FROM n UNION SELECT r.u, l.v FROM r JOIN l ON l.u = r.v),
             m AS (SELECT u AS doc_id, min(v) AS component_id FROM r GROUP BY u)
        SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN m USING (doc_id)""",
    "op2_chat_formatting": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
             s AS (SELECT *, '<s>' || replace(replace(replace(replace(role, '~', '~0'), '<', '~1'), '[', '~2'), chr(10), '~3') || chr(10)
                          || replace(replace(replace(text, '~', '~0'), '<', '~1'), '[', '~2') || '</s>' AS shown FROM c),
             k AS (SELECT *, (strlen(shown) + 3) // 4 AS tokens, row_number() OVER o - 1 AS pos FROM s WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)),
             y AS (SELECT conv_id, tokens AS sys, length(shown) AS sys_len FROM k WHERE pos = 0 AND role = 'system'),
             b AS (SELECT k.*, coalesce(sys, 0) AS sys, coalesce(sys_len, 0) AS sys_len, pos = 0 AND sys IS NOT NULL AS opens, greatest(1, 512 - coalesce(sys, 0)) AS room,
                     sum(tokens) OVER (PARTITION BY conv_id ORDER BY pos) - tokens - coalesce(sys, 0) AS before FROM k LEFT JOIN y USING (conv_id)),
             e AS (SELECT *, CASE WHEN opens THEN 0 ELSE before // room END AS cell, NOT opens AND (before + tokens - 1) // room > before // room AS cut FROM b),
             d AS (SELECT *, coalesce(sum(tokens) FILTER (NOT cut AND NOT opens) OVER (PARTITION BY conv_id, cell), 0) AS beside FROM e),
             w AS (SELECT *, 2 * cell + CASE WHEN cut AND beside > 0 AND beside + tokens > room THEN 1 ELSE 0 END AS win FROM d),
             p AS (SELECT conv_id, win, min(before) FILTER (NOT opens) AS begins, min(pos) AS first, 640 - max(sys) - coalesce(sum(tokens) FILTER (NOT opens), 0) AS room_left FROM w GROUP BY ALL),
             n AS (SELECT *, lead(begins) OVER o AS next_begins, lead(room_left) OVER o AS next_left FROM p WINDOW o AS (PARTITION BY conv_id ORDER BY win)),
             h AS (SELECT w.conv_id, sum(length(shown)) AS len FROM w JOIN n USING (conv_id, win) WHERE next_begins - before <= least(128, next_left) AND NOT opens GROUP BY ALL),
             g AS (SELECT n.conv_id, sum(y.sys_len) AS len FROM n JOIN y USING (conv_id) WHERE first > 0 GROUP BY ALL)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length(shown)) + coalesce(any_value(h.len), 0) + coalesce(any_value(g.len), 0) AS BIGINT) AS formatted_chars
        FROM w LEFT JOIN h USING (conv_id) LEFT JOIN g USING (conv_id) GROUP BY conv_id""",
    "op7_exact_top_k": """
        WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
             s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)]) AS BIGINT) AS score
                   FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
             r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op3_exact_dedup": """
        WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM n WINDOW w AS (PARTITION BY text_sha256)""",
}
