"""Scalar / text queries (F family) over documents, conversations, pages,
events; each runs over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from prudent.functions import scalar as S
from prudent.operators import profile as Q
from prudent.plans.registry import Tables, query


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _redact_sql(col: str) -> str:
    out = f"regexp_replace({col}, {_sql_str(S.CONTROL_CHARS)}, '', 'g')"
    for p in S.INJECTION_PATTERNS:
        out = f"regexp_replace({out}, {_sql_str(p)}, {_sql_str(S.REDACTION)}, 'g')"
    return out


_ROLE_TEXT = "concat(role, ': ', text)"


@query("f09_redact", f"""
SELECT conv_id, turn, {_redact_sql(_ROLE_TEXT)} AS redacted
FROM conversations WHERE {_redact_sql(_ROLE_TEXT)} <> {_ROLE_TEXT}""")
def redact(spark, sf):
    c = Tables(spark, sf).conversations.withColumn("rt", F.concat("role", F.lit(": "), "text"))
    return c.where(S.redact_changed("rt")).select("conv_id", "turn", S.redact("rt").alias("redacted"))


@query("f08_strip_controls", f"""
SELECT count(*) AS n_docs,
       count_if(regexp_replace(text, {_sql_str(S.CONTROL_CHARS)}, '', 'g') <> text) AS n_changed,
       sum(length(regexp_replace(text, {_sql_str(S.CONTROL_CHARS)}, '', 'g'))) AS n_chars_kept
FROM documents""")
def strip_controls(spark, sf):
    d = Tables(spark, sf).documents
    s = S.strip_controls("text")
    return d.agg(F.count("*").alias("n_docs"), F.count_if(s != F.col("text")).alias("n_changed"),
                 F.sum(F.length(s)).alias("n_chars_kept"))


def _free_text_sql(table: str, cols: list[str]) -> str:
    parts = [f"SELECT '{c}' AS column_name, round(count_if(length({c}) > 40) / nullif(count({c}), 0), 6) AS long_share, "
             f"coalesce(count_if(length({c}) > 40) / nullif(count({c}), 0) >= 0.10, false) AS is_free_text FROM {table}"
             for c in cols]
    return " UNION ALL ".join(parts)


@query("f10_free_text_columns", _free_text_sql("documents", ["text", "lang", "source"]))
def free_text(spark, sf):
    return Q.free_text_columns(Tables(spark, sf).documents)


@query("f11_sanitize_counts", f"""
WITH c AS (SELECT conv_id, turn, role, {_ROLE_TEXT} AS rt FROM conversations)
SELECT 'rt' AS column_name, count_if(rt IS NOT NULL AND {_redact_sql('rt')} <> rt) AS n_changed FROM c""")
def sanitize_counts(spark, sf):
    c = Tables(spark, sf).conversations.select("conv_id", "turn", "role",
                                               F.concat("role", F.lit(": "), "text").alias("rt"))
    _clean, counts = Q.sanitize(c)
    return counts


@query("f12_norm_key", """
SELECT doc_id, left(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g')), 120)
       AS norm_key FROM documents""")
def norm_key(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", S.norm_key("text").alias("norm_key"))


@query("f20_slug", """
SELECT slug, count(*) AS n FROM (
  SELECT CASE WHEN s = '' THEN 'analysis' ELSE s END AS slug
  FROM (SELECT regexp_replace(regexp_replace(lower(trim(coalesce(source || ' / ' || lang, 'analysis'))),
                                             '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM documents))
GROUP BY slug""")
def slug(spark, sf):
    d = Tables(spark, sf).documents
    return d.groupBy(S.slug(F.concat("source", F.lit(" / "), "lang")).alias("slug")).agg(F.count("*").alias("n"))


def _norm_text_sql(col: str) -> str:
    return (f"translate(regexp_replace({col}, {_sql_str(S.ZERO_WIDTH)}, '', 'g'), "
            f"{_sql_str(S.FOLD_FROM)}, {_sql_str(S.FOLD_TO)})")


@query("f21_norm_text", f"""
SELECT doc_id, md5({_norm_text_sql('text')}) AS text_md5, length({_norm_text_sql('text')}) AS n_chars
FROM documents""")
def norm_text(spark, sf):
    d = Tables(spark, sf).documents
    n = S.norm_text("text")
    return d.select("doc_id", F.md5(n).alias("text_md5"), F.length(n).alias("n_chars"))


@query("f22_truncate", """
SELECT doc_id,
       md5(CASE WHEN length(text) <= 8000 THEN text
                ELSE left(text, 8000) || '... [truncated ' || CAST(length(text) - 8000 AS VARCHAR) || ' chars]' END)
         AS text_md5,
       length(text) > 8000 AS was_truncated
FROM documents""")
def truncate(spark, sf):
    d = Tables(spark, sf).documents
    return d.select("doc_id", F.md5(S.truncate("text", 8000)).alias("text_md5"),
                    (F.length("text") > 8000).alias("was_truncated"))


# Python's str.split() separators, spelled as a regex class for both engines
_PY_WS = (r"\t\n\x0b\x0c\r\x1c-\x1f \x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
          r"\x{202f}\x{205f}\x{3000}")


def tokens(col):
    """F23 over whole texts: whitespace words as Python splits them, x 1.3."""
    return F.floor(F.regexp_count(col, F.lit(f"[^{_PY_WS}]+")) * F.lit(1.3)).cast("bigint")


def _tokens_sql(col: str) -> str:
    return f"CAST(floor(len(regexp_extract_all({col}, '[^{_PY_WS}]+')) * 1.3) AS BIGINT)"


@query("f23_token_estimate", f"""
SELECT lang, count(*) AS n_docs, sum({_tokens_sql('text')}) AS tokens FROM documents GROUP BY lang""")
def token_estimate(spark, sf):
    d = Tables(spark, sf).documents
    return d.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(tokens(F.col("text"))).alias("tokens"))


@query("f24_surrogate_key", """
SELECT doc_id, CAST(CAST(('0x' || left(sha256(concat_ws('|', CAST(doc_id AS VARCHAR), lang, source)), 16)) AS UBIGINT)
                    AS DECIMAL(20, 0)) AS skey
FROM documents""")
def surrogate(spark, sf):
    d = Tables(spark, sf).documents
    return d.select("doc_id", S.surrogate_key("doc_id", "lang", "source").alias("skey"))


def _any_sql(col: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({col}), {_sql_str(w)})" for w in words) + ")"


@query("f25_keyword_flags", f"""
SELECT role, count_if({_any_sql('text', S.ANALYTICAL_SIGNALS)}) AS n_analytical,
       count_if({_any_sql('text', S.DAILY_GRAIN_SIGNALS)}) AS n_daily,
       count_if({_any_sql('text', S.DELIVERY_SIGNALS)}) AS n_delivery, count(*) AS n
FROM conversations GROUP BY role""")
def keyword_flags(spark, sf):
    c = Tables(spark, sf).conversations
    return c.groupBy("role").agg(F.count_if(S.has_any("text", S.ANALYTICAL_SIGNALS)).alias("n_analytical"),
                                 F.count_if(S.has_any("text", S.DAILY_GRAIN_SIGNALS)).alias("n_daily"),
                                 F.count_if(S.has_any("text", S.DELIVERY_SIGNALS)).alias("n_delivery"),
                                 F.count("*").alias("n"))


@query("f26_run_ts", """
WITH r AS (SELECT ts, strftime(ts, '%Y%m%dT%H%M%SZ') || '-' || CAST(event_id AS VARCHAR) AS run_id FROM events)
SELECT count(*) AS n, count_if(try_strptime(split_part(run_id, '-', 1), '%Y%m%dT%H%M%SZ') = date_trunc('second', ts))
       AS n_parsed, max(split_part(run_id, '-', 1)) AS latest_stamp
FROM r""")
def run_ts(spark, sf):
    e = Tables(spark, sf).events
    r = e.select("ts", F.concat(F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'"), F.lit("-"),
                                F.col("event_id").cast("string")).alias("run_id"))
    parsed = S.run_ts("run_id")
    return r.agg(F.count("*").alias("n"),
                 F.count_if(parsed.cast("timestamp_ntz") == F.date_trunc("SECOND", "ts")).alias("n_parsed"),
                 F.max(F.substring_index("run_id", "-", 1)).alias("latest_stamp"))


@query("f13_json_pick", """
SELECT event_type, sum(coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT),
                                CAST(json_extract_string(props, '$.key') AS BIGINT), -1)) AS sum_k,
       count_if(coalesce(json_extract_string(props, '$.k'), json_extract_string(props, '$.key')) IS NULL) AS n_missing
FROM events GROUP BY event_type""")
def json_pick(spark, sf):
    e = Tables(spark, sf).events
    v = F.try_parse_json("props")
    k = F.coalesce(F.try_variant_get(v, "$.k", "bigint"), F.try_variant_get(v, "$.key", "bigint"))
    return e.groupBy("event_type").agg(F.sum(F.coalesce(k, F.lit(-1))).alias("sum_k"),
                                       F.count_if(k.isNull()).alias("n_missing"))


def _first_word():
    return F.lower(F.regexp_extract("text", r"^(\S+)", 1))


@query("f14_norm_severity", """
WITH w AS (SELECT lower(regexp_extract(text, '^(\\S+)', 1)) AS sev FROM conversations)
SELECT CASE WHEN sev IS NULL THEN NULL WHEN sev IN ('low', 'medium', 'high') THEN sev
            WHEN sev IN ('critical', 'urgent', 'blocker', 'severe', 'blocking') THEN 'high'
            WHEN sev IN ('warning', 'warn', 'moderate') THEN 'medium'
            WHEN sev IN ('info', 'informational', 'minor', 'trivial', 'note') THEN 'low' ELSE 'medium' END AS severity,
       count(*) AS n
FROM w GROUP BY 1""")
def norm_severity(spark, sf):
    c = Tables(spark, sf).conversations
    return c.groupBy(S.norm_severity(_first_word()).alias("severity")).agg(F.count("*").alias("n"))


@query("f15_grade_letter", f"""
SELECT coalesce({", ".join(f"nullif(upper(regexp_extract(text, {_sql_str(p)}, 1)), '')" for p in S.GRADE_PATTERNS)})
       AS grade, count(*) AS n
FROM conversations GROUP BY 1""")
def grade_letter(spark, sf):
    c = Tables(spark, sf).conversations
    return c.groupBy(S.grade_letter("text").alias("grade")).agg(F.count("*").alias("n"))


@query("f19_norm_technique", """
SELECT CASE WHEN contains(lower(text), 'cluster') OR contains(lower(text), 'kmeans') OR contains(lower(text), 'k-means')
                 OR contains(lower(text), 'dbscan') OR contains(lower(text), 'hierarchical') THEN 'clustering'
            WHEN contains(lower(text), 'dimensionality') OR contains(lower(text), 'pca') OR contains(lower(text), 'umap')
                 OR contains(lower(text), 'tsne') OR contains(lower(text), 't-sne') THEN 'dimensionality_reduction'
            WHEN contains(lower(text), 'outlier') OR contains(lower(text), 'isolation')
                 OR contains(lower(text), 'mahalanobis') OR contains(lower(text), 'anomaly')
                 THEN 'outlier_characterization' END AS technique,
       count(*) AS n
FROM documents GROUP BY 1""")
def norm_technique(spark, sf):
    d = Tables(spark, sf).documents
    return d.groupBy(S.norm_technique("text").alias("technique")).agg(F.count("*").alias("n"))


# -- F27: usage cost from conversations x a literal price table -------------
# Prices per million tokens (a parameter table, not data): input, output and
# optional cache-read / cache-write prices; missing cache prices default to
# 0.1x and 1.25x the input price; unknown models cost 0.
PRICES = [("model-a", 3.0, 15.0, None, None), ("model-b", 0.8, 4.0, 0.08, 1.0)]


def usage(t: Tables):
    c = t.conversations.withColumn("tok", tokens(F.col("text")))
    u = c.groupBy("conv_id").agg(
        F.sum(F.when(F.col("role") == "user", F.col("tok")).otherwise(0)).alias("input_tokens"),
        F.sum(F.when(F.col("role") == "assistant", F.col("tok")).otherwise(0)).alias("output_tokens"),
        F.sum(F.when(F.col("role") == "system", F.col("tok")).otherwise(0)).alias("cache_read_tokens"),
        F.max(F.when(F.col("role") == "system", F.col("tok")).otherwise(0)).alias("cache_write_tokens"),
        F.count("*").alias("n_turns"))
    model = F.when(F.col("conv_id") % 3 == 0, "model-a").when(F.col("conv_id") % 3 == 1, "model-b").otherwise("model-x")
    return u.withColumn("model", model)


def usage_cost(u, prices):
    p = prices.select("model", "p_in", "p_out",
                      F.coalesce("p_cache_read", F.col("p_in") * 0.1).alias("p_cr"),
                      F.coalesce("p_cache_write", F.col("p_in") * 1.25).alias("p_cw"))
    j = u.join(F.broadcast(p), "model", "left")
    cost = (F.col("input_tokens") * F.col("p_in") + F.col("output_tokens") * F.col("p_out")
            + F.col("cache_read_tokens") * F.col("p_cr") + F.col("cache_write_tokens") * F.col("p_cw")) / 1e6
    return j.withColumn("cost_usd", F.coalesce(cost, F.lit(0.0))).drop("p_in", "p_out", "p_cr", "p_cw")


def price_table(spark):
    return spark.createDataFrame(PRICES, "model string, p_in double, p_out double, p_cache_read double, "
                                         "p_cache_write double")


USAGE_SQL = f"""u AS (
  SELECT conv_id,
         sum(CASE WHEN role = 'user' THEN tok ELSE 0 END) AS input_tokens,
         sum(CASE WHEN role = 'assistant' THEN tok ELSE 0 END) AS output_tokens,
         sum(CASE WHEN role = 'system' THEN tok ELSE 0 END) AS cache_read_tokens,
         max(CASE WHEN role = 'system' THEN tok ELSE 0 END) AS cache_write_tokens,
         count(*) AS n_turns,
         CASE WHEN conv_id % 3 = 0 THEN 'model-a' WHEN conv_id % 3 = 1 THEN 'model-b' ELSE 'model-x' END AS model
  FROM (SELECT *, {_tokens_sql('text')} AS tok FROM conversations) GROUP BY conv_id),
 p AS (SELECT * FROM (VALUES ('model-a', 3.0::DOUBLE, 15.0::DOUBLE, NULL::DOUBLE, NULL::DOUBLE),
                             ('model-b', 0.8::DOUBLE, 4.0::DOUBLE, 0.08::DOUBLE, 1.0::DOUBLE))
       t(model, p_in, p_out, p_cache_read, p_cache_write)),
 c AS (SELECT u.*, coalesce((input_tokens * p_in + output_tokens * p_out
                             + cache_read_tokens * coalesce(p_cache_read, p_in * 0.1)
                             + cache_write_tokens * coalesce(p_cache_write, p_in * 1.25)) / 1e6, 0.0) AS cost_usd
       FROM u LEFT JOIN p ON u.model = p.model)"""


@query("f27_usage_cost", f"""
WITH {USAGE_SQL}
SELECT conv_id, model, input_tokens, output_tokens, round(cost_usd, 8) AS cost_usd FROM c""")
def usage_cost_q(spark, sf):
    c = usage_cost(usage(Tables(spark, sf)), price_table(spark))
    return c.select("conv_id", "model", "input_tokens", "output_tokens", F.round("cost_usd", 8).alias("cost_usd"))
