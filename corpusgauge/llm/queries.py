"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgauge.llm import byte_bpe, decontaminate, divergence, hmm_lm, license_scan, multi_index, orc_tokens, paragraph_dedup, simhash_vptree, spelling, toxicity, url_filter, warc
from corpusgauge.llm.common import documents, fresh_path, table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@dataclass(frozen=True)
class LlmQuery:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


#: The rules of the query: verdict, host, path.
URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "verdict string, host string, path string")
    pages = table(spark, folder, "pages").select("page_id", "url")
    return url_filter.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


_URL = "'(?s)^.*?://([^/?#]*)([^?#]*)'"
OP1_SQL = f"""
WITH parsed AS (
    SELECT page_id,
           translate(coalesce(regexp_extract(url, {_URL}, 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           coalesce(regexp_extract(url, {_URL}, 2), '') AS path,
           row_number() OVER () AS n
    FROM pages
), rules(verdict, rhost, rpath) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
fits AS (
    SELECT n, rhost || rpath AS rule, verdict,
           row_number() OVER (PARTITION BY n ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS place
    FROM parsed JOIN rules ON (host = rhost OR suffix(host, '.' || rhost)) AND prefix(path, rpath)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parsed LEFT JOIN (SELECT * FROM fits WHERE place = 1) USING (n)
"""


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    model = toxicity.fit(docs, table(spark, folder, "labels"), usable=toxicity.learnable())
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id",
        (~toxicity.learnable()).alias("held_out"),
        "score",
        F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def op3_paragraph_dedup(spark: SparkSession, folder: str) -> DataFrame:
    trimmed = paragraph_dedup.deduplicate(documents(spark, folder).select("doc_id", "text"))
    return trimmed.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op4_multi_index(spark: SparkSession, folder: str) -> DataFrame:
    return multi_index.nearest(table(spark, folder, "embeddings"), every=20, k=20)


WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2


def op5_orc_tokens(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "tokens-orc")
    orc_tokens.write_tokens(documents(spark, folder), path, WORD_BPE, END_ID)
    return orc_tokens.layout(spark, path)


def op6_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    coded = byte_bpe.decode_documents(byte_bpe.encode_documents(docs, RANKS).drop("token_ends"), RANKS)
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_simhash_vptree(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash_vptree.near_duplicates(documents(spark, folder), radius=2)
    return found.select("doc_id", simhash_vptree.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op8_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.matches(documents(spark, folder), table(spark, folder, "benchmark"))
    listed = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_PARTS = r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_WORDS = f"list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_PARTS}), lambda w: w <> '')"
OP8_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS n, doc_id, coalesce({_WORDS}, []) AS words FROM documents),
tests AS (SELECT item_id, {_WORDS} AS words FROM benchmark),
windows AS (
    SELECT DISTINCT item_id, k, array_to_string(words[i:i + k - 1], ' ') AS gram
    FROM (SELECT *, unnest(range(1, len(words) - k + 2)) AS i FROM (SELECT *, least(10, len(words)) AS k FROM tests WHERE len(words) > 0))
),
grams AS (
    SELECT n, k, i, array_to_string(words[i:i + k - 1], ' ') AS gram
    FROM (SELECT n, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM windows))
),
hits AS (SELECT n, item_id, i, k FROM grams JOIN windows USING (k, gram)),
covered AS (SELECT n, count(DISTINCT place) AS n_hit FROM (SELECT n, unnest(range(i, i + k)) AS place FROM hits) GROUP BY n),
items AS (SELECT n, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT n, item_id::VARCHAR AS item FROM hits) GROUP BY n)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (n) LEFT JOIN items USING (n)
"""


def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    templates = spark.createDataFrame(list(license_scan.TEMPLATES), "template string, text string")
    return license_scan.scan(documents(spark, folder), templates)


OP9_SQL = f"""
WITH raw(template, text) AS (VALUES {", ".join(str(t) for t in license_scan.TEMPLATES)}),
known AS (SELECT template, {_WORDS} AS words FROM raw),
classed AS (
    SELECT template, words, least(len(words), 5) AS width,
           CASE WHEN len(words) < 5 THEN len(words) ELSE pow(2, ceil(log2(len(words))))::BIGINT END AS class
    FROM known
),
spans AS (SELECT class, max(width) AS width, max(len(words)) AS longest FROM classed GROUP BY class),
shingled AS (
    SELECT template, class, width,
           list_distinct(list_transform(range(1, len(words) - width + 2), lambda i: array_to_string(words[i:i + width - 1], ' '))) AS shingles
    FROM classed
),
texts AS (SELECT doc_id, {_WORDS} AS words FROM documents),
windows AS (
    SELECT doc_id, class, width, start, words[start + 1:start + 2 * longest] AS words
    FROM (SELECT doc_id, words, class, width, longest, unnest(range(0, len(words), longest)) AS start FROM texts, spans)
),
cut AS (
    SELECT doc_id, class, start,
           list_distinct(list_transform(range(1, len(words) - width + 2), lambda i: array_to_string(words[i:i + width - 1], ' '))) AS shingles
    FROM windows WHERE len(words) >= width
),
shares AS (
    SELECT doc_id, template, start, len(list_intersect(s.shingles, c.shingles)) / len(s.shingles) AS share
    FROM cut c JOIN shingled s USING (class)
)
SELECT doc_id, template, max(share) AS containment, count(DISTINCT start) AS n_windows, min(start)::INTEGER AS first_word
FROM shares WHERE share >= {license_scan.CONTAINMENT} GROUP BY doc_id, template
"""


def op10_hmm_lm(spark: SparkSession, folder: str) -> DataFrame:
    return hmm_lm.score(documents(spark, folder))


def op11_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc.write_pages(table(spark, folder, "pages"), path)
    return warc.read_pages(spark, path, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP11_SQL = """
WITH held AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
sums AS (
    SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY sha1(payload)) AS last
    FROM held
),
bits AS (
    SELECT *, list_aggregate(list_transform(range(1, 41), lambda i: lpad(bin(instr('0123456789abcdef', hex[i]) - 1), 4, '0')), 'string_agg', '') AS b
    FROM sums
)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
           1 + list_sum(list_transform(range(1, 6), lambda j: b[5 * i + j]::INTEGER * (32 >> j::INTEGER)))::INTEGER]), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < last THEN last END AS refers_to
FROM bits
"""


def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.divergence(documents(spark, folder))


_TERM = r"'[^\x00-\x40\x5B-\x60\x7B-\x7F]+'"
OP12_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
words AS (
    SELECT d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_TERM})) AS term
    FROM docs
),
kept AS (SELECT lang, term FROM (SELECT DISTINCT d, lang, term FROM words) GROUP BY lang, term HAVING count(*) >= {divergence.MIN_DOCS}),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
dense AS (SELECT lang, source, term, coalesce(n, 0) AS n FROM groups JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
shares AS (
    SELECT lang, source, term, n,
           1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS p
    FROM dense
),
whole AS (
    SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q
    FROM (SELECT lang, term, sum(n)::BIGINT AS n FROM dense GROUP BY lang, term)
),
apart AS (
    SELECT lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
    FROM shares a JOIN shares b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL
),
found AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN apart ON apart.lang = a.lang AND apart.source = a.source AND apart.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, (p - q)::BIGINT FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
WHERE part = 'pair' OR rank <= {divergence.TOP_TERMS}
"""


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(spelling.frequent_words(documents(spark, folder)))


QUERIES = {
    "op1_url_filter": LlmQuery(op1_url_filter, OP1_SQL),
    "op2_toxicity": LlmQuery(op2_toxicity),
    "op3_paragraph_dedup": LlmQuery(op3_paragraph_dedup),
    "op4_multi_index": LlmQuery(op4_multi_index),
    "op5_orc_tokens": LlmQuery(op5_orc_tokens),
    "op6_byte_bpe": LlmQuery(op6_byte_bpe),
    "op7_simhash_vptree": LlmQuery(op7_simhash_vptree),
    "op8_decontaminate": LlmQuery(op8_decontaminate, OP8_SQL),
    "op9_license_scan": LlmQuery(op9_license_scan, OP9_SQL),
    "op10_hmm_lm": LlmQuery(op10_hmm_lm),
    "op11_warc": LlmQuery(op11_warc, OP11_SQL),
    "op12_source_divergence": LlmQuery(op12_source_divergence, OP12_SQL),
    "op13_spelling_variants": LlmQuery(op13_spelling_variants),
}
