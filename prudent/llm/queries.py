"""Registered queries of the training-data operators, with oracle SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prudent.llm import (
    conversation, embeddings, exact, langid, minhash, mixing, packing, pii, quality, resampling, tokenfile, unigram, urls)
from prudent.llm.common import read

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f
    return put


@_query("op3_near_duplicates")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate documents over two-word shingles, similarity 0.8."""
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), shingle_words=2)


_OP10_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, x -> CAST(x AS DOUBLE)) AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
     AND len(list_filter(e, x -> x IS NULL OR NOT isfinite(x))) = 0
     AND len(list_filter(e, x -> x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM ok a JOIN ok b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id AS node, vec_id AS root FROM v
  UNION
  SELECT l.w, r.root FROM reach r JOIN links l ON l.u = r.node
), comp AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node),
n AS (SELECT u, count(*) AS n_links FROM links GROUP BY u)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v LEFT JOIN n ON n.u = v.vec_id LEFT JOIN comp c ON c.node = v.vec_id
"""


@_query("op10_embedding_near_duplicates", _OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one label linked by cosine 0.93 or more."""
    return embeddings.near_duplicate_vectors(read(spark, sf_dir, "embeddings"))


@_query("op7_token_files")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-plane token files of all documents, written and read back."""
    return tokenfile.token_files(read(spark, sf_dir, "documents"))


@_query("op6_best_fit_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    return packing.pack_documents(read(spark, sf_dir, "documents"))


_OP1_SQL = r"""
WITH h AS (
  SELECT page_id, coalesce(url, '') AS url,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), r AS (
  SELECT *, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
         WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
         WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM h
), m AS (
  SELECT *, CASE
    WHEN rule IS NOT NULL THEN rule
    WHEN regexp_matches(low, '/casino/history([^a-z0-9%_.\-]|$)') THEN '/casino/history^'
    WHEN regexp_matches(low, '\.exe$') THEN '*.exe|'
    WHEN contains(low, '/casino/') THEN '/casino/'
    WHEN regexp_matches(low, '/poker([^a-z0-9%_.\-]|$)') THEN '/poker^'
    WHEN contains(low, '/wp-login.php') THEN '/wp-login.php'
    WHEN regexp_matches(low, '://ads\..*/banner([^a-z0-9%_.\-]|$)') THEN '://ads.*/banner^'
    WHEN regexp_matches(low, '[^a-z0-9%_.\-]sessionid=') THEN '^sessionid='
    WHEN regexp_matches(low, '^[a-z][a-z0-9+.\-]*://([^/?#]*\.)?spam-farm\.example\.net([^a-z0-9%_.\-]|$)') THEN '||spam-farm.example.net^'
    WHEN regexp_matches(low, '^[a-z][a-z0-9+.\-]*://([^/?#]*\.)?spam-farm\.example\.org([^a-z0-9%_.\-]|$)') THEN '||spam-farm.example.org^'
    END AS matched FROM r
)
SELECT page_id, host, path, rule, matched,
  CASE WHEN matched IS NULL OR matched IN ('com/', 'www.example.com/en/', '/casino/history^') THEN 'allow' ELSE 'block' END AS verdict
FROM m
"""


@_query("op1_url_filters", _OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the host and pattern rules on every page's URL."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, urls.DEFAULT_RULES).select("page_id", "host", "path", "rule", "verdict", "matched")


#: key of the registered query; a deployment passes its own
PII_KEY = "registered-query-key"


@_query("op2_pii_pseudonyms")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data under pseudonyms, and the kinds that were found."""
    parts = read(spark, sf_dir, "documents").select("doc_id", pii.parts_of(F.col("text")).alias("parts"))
    return parts.select("doc_id", pii.rendered(F.col("parts"), PII_KEY).alias("text"), pii.kinds_in(F.col("parts")).alias("kinds")) \
                .withColumn("n_found", F.size("kinds"))


@_query("op4_quality_rules")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the learned list's verdict on every document."""
    docs = read(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


@_query("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; the held-out fold is not learned from."""
    docs = read(spark, sf_dir, "documents")
    fold = langid.held_out(F.col("doc_id"))
    return (langid.identify(docs, langid.fit(docs.where(~fold)))
            .select("doc_id", fold.alias("held_out"), "lang_pred", "score"))


@_query("op8_source_mixing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raked weight, inclusion probability and draw of every document."""
    return mixing.mix(read(spark, sf_dir, "documents"), mixing.default_margins(), keep=mixing.KEEP)


@_query("op9_token_counts")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of every document."""
    return unigram.token_counts(read(spark, sf_dir, "documents"))


@_query("op11_importance_resampling")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents drawn towards the distribution of the benchmark texts."""
    return resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@_query("op12_exact_dedup")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of equal text, told by a stateful stream over the table's files."""
    return exact.deduplicate(spark, f"{sf_dir}/documents.parquet")


@_query("op13_conversation_repair")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after the planted damage."""
    return conversation.repair(conversation.damage(read(spark, sf_dir, "conversations")), F.col("lost"))
