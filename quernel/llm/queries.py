"""The queries op1 to op10 over the driver's tables, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, htmltext, mixing, near_text, near_vectors, quality, secrets, tokenfile, urlfilter, warc
from .shared import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.9)


#: The components by label propagation: a recursive query over all linked pairs.
ORACLE_SQL["op1_embedding_near_dedup"] = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT * FROM v WHERE e IS NOT NULL AND list_sum(list_transform(e, lambda x: CAST(x IS NULL OR NOT isfinite(x) AS INT))) = 0 AND list_sum(list_transform(e, lambda x: abs(x))) > 0),
pairs AS MATERIALIZED (SELECT a.r AS a, b.r AS b, b.vec_id AS other FROM g a JOIN g b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (SELECT r, r FROM v UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a),
comp AS (SELECT reach.a AS r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY reach.a),
deg AS (SELECT a AS r, count(*) AS n FROM pairs GROUP BY a)
SELECT v.vec_id, coalesce(deg.n, 0) AS n_links, comp.component_id, v.vec_id = comp.component_id AS kept
FROM v JOIN comp USING (r) LEFT JOIN deg USING (r)
"""


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(_table(spark, sf_dir, "pages"), least_bytes=0)
    index = materialize(spark, warc.merge_index(spark, manifest), "capture-index")
    return warc.read_captures(index, warc.folder_of(manifest)).drop("target")


#: base32 of a digest: eight groups of five hexadecimal digits, four characters each
_BASE32 = "array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr({0}, 1 + 5 * (i // 4), 5) AS INT) >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '')"
ORACLE_SQL["op3_warc"] = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages)
SELECT page_id, payload_bytes, {_BASE32.format("h")} AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM p
"""


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(_table(spark, sf_dir, "pages"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return quality.score_quality(docs, quality.quality_scorer(docs, labels), threshold=0.3)


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_text.near_duplicates(_table(spark, sf_dir, "documents"))


#: (verdict, host, path)
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
ORACLE_SQL["op7_url_filters"] = f"""
WITH rules(verdict, rhost, rpath) AS (VALUES {_RULES}),
u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages)
SELECT page_id, host, path,
  (SELECT rhost || rpath FROM rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) ORDER BY length(rhost || rpath) DESC LIMIT 1) AS rule,
  coalesce((SELECT verdict FROM rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) ORDER BY length(rhost || rpath) DESC LIMIT 1), 'allow') AS verdict
FROM u
"""


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokenfile.write_tokens(_table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1)
    return tokenfile.read_tokens(manifest)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)


_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _ASCII_LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL["op10_benchmark_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
pats AS (
  SELECT item_id, least(len(w), 10) AS m, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' '))) AS pat
  FROM b WHERE len(w) > 0),
ms AS (SELECT DISTINCT m FROM pats),
wins AS (
  SELECT doc_id, m, unnest(range(1, len(w) - m + 2)) AS i, w FROM d, ms WHERE len(w) >= m),
occ AS (
  SELECT DISTINCT doc_id, x.m, i, item_id FROM (SELECT doc_id, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS pat FROM wins) x JOIN pats p ON p.m = x.m AND p.pat = x.pat),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS pos FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

for _f in (op1_embedding_near_dedup, op2_secret_scans, op3_warc, op4_html_extraction, op5_quality_classifier, op6_minhash_near_dedup, op7_url_filters, op8_mixing, op9_token_binary, op10_benchmark_decontamination):
    QUERIES[_f.__name__] = _f
