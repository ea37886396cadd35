"""The queries op1_... to op10_... and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, licenses, mtree, packing, pii, quality, secrets, simhash, sql, suffixes, warc
from .common import table


def op1_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as a full response and, 1000 hours later, as a revisit with the page's validators."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.md5("html").alias("digest"))
    shared = [F.col("url"), F.lit(None).cast("string").alias("last_modified"), "digest"]
    at = lambda more: F.concat(F.lit("t"), (F.col("page_id") + more).cast("string"))
    response = pages.select(
        (F.col("page_id") * 2).alias("record_id"), (F.col("page_id") * 3600).alias("ts"), F.lit("response").alias("kind"), F.lit(200).alias("status"),
        F.concat(F.lit('W/"'), F.col("digest"), F.lit('"')).alias("etag"), *shared,
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("date"), at(0)).alias("headers"),
    )
    revisit = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), ((F.col("page_id") + 1000) * 3600).alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"),
        F.concat(F.lit('"'), F.col("digest"), F.lit('"')).alias("etag"), *shared,
        F.create_map(F.lit("date"), at(1000), F.lit("expires"), at(2000), F.lit("content-length"), F.lit("0")).alias("headers"),
    )
    out = warc.resolve_revisits(response.unionByName(revisit))
    pairs = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return out.select(
        F.expr("(record_id - 1) div 2").alias("page_id"), "canonical_url", "outcome", F.expr("matched_id div 2").alias("matched_page_id"), "digest",
        F.array_join(pairs, ";").alias("headers"),
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.with_findings(table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("text")))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.with_findings(table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("text")))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", mtree.whole_numbers(F.col("embedding")).alias("v"))
    return mtree.top_k(rows, rows.where("vec_id % 100 = 0"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeats(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select(F.col("row.doc_id").alias("doc_id"), quality.held_out(F.col("row.doc_id")).alias("held_out"), "score", "predicted")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_revisits, op2_decontamination, op3_pii, op4_simhash, op5_secrets, op6_top_k, op7_packing, op8_repeats, op9_quality, op10_licenses,
    )
}
SQL: dict[str, str] = dict(sql.SQL)

_CANONICAL = """SELECT *, CASE WHEN host <> '' THEN host || path || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END AS canonical_url
FROM (SELECT page_id, digest,
  regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)), '^.*@', ''), '^www\\.', ''), ':(80|443)$', '') AS host,
  regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/+$', '') AS path,
  list_sort(list_filter(string_split(regexp_extract(u, '\\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)'))) AS params
 FROM (SELECT page_id, md5(html) AS digest, regexp_replace(trim(url), '#.*$', '') AS u FROM pages))"""
SQL["op1_revisits"] = f"""WITH c AS ({_CANONICAL}),
m AS (SELECT p.page_id, p.canonical_url, p.digest, max(q.page_id) AS matched FROM c p LEFT JOIN c q ON p.canonical_url = q.canonical_url AND q.page_id < p.page_id + 1000 GROUP BY ALL)
SELECT m.page_id, m.canonical_url, CASE WHEN matched IS NULL THEN 'no_response' WHEN q.digest = m.digest THEN 'resolved' ELSE 'mismatch' END AS outcome,
 matched AS matched_page_id, m.digest,
 CASE WHEN q.digest = m.digest THEN 'content-type=text/html;' ELSE 'content-length=0;' END || 'date=t' || (m.page_id + 1000) || ';expires=t' || (m.page_id + 2000) AS headers
FROM m LEFT JOIN c q ON q.page_id = m.matched"""
_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_SHINGLES = "SELECT DISTINCT {id}, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT {id}, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM (SELECT {id}, " + _WORDS + " AS w FROM {table}))"
SQL["op2_decontamination"] = f"""WITH d AS ({_SHINGLES.format(id="doc_id", table="documents")}), b AS ({_SHINGLES.format(id="item_id", table="benchmark")}),
n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id),
j AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN b USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment FROM j JOIN n USING (item_id) WHERE n_shared >= 0.8 * n_item"""
SQL["op6_top_k"] = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda t: t[1] * t[2])) AS BIGINT) AS score
 FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
SELECT query_id, CAST(r AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 10"""
