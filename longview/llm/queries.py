"""The registered queries of the training-data operators, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longview.llm import bpe, language, mixing, pii, sharding, toxicity, urls
from longview.llm.embeddings import near_duplicates
from longview.llm.exact import exact_duplicates
from longview.llm.ngram import jaccard_groups

#: Shares of expected tokens by quality label that mixing aims at.
TARGETS = {"1": 0.9, "0": 0.1}
#: Tokens after mixing, against tokens before.
BUDGET = 1.1


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "embeddings"), threshold=0.9)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    tagger = toxicity.train(docs, _read(spark, sf_dir, "labels"))
    return toxicity.score(docs, tagger).select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("spans").cast("int").alias("n_spans"),
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_read(spark, sf_dir, "documents")).drop("text_hash")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return urls.filter_urls(pages, listed=urls.drawn_list(pages)).select("page_id", "host", "path", "rule", "verdict")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_read(spark, sf_dir, "documents"), shards=8).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_read(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(_read(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), TARGETS, budget=BUDGET)
    return found.select("doc_id", "n_tokens", F.round(F.col("posteriors")[1], 6).alias("p_high"), "rate", "copies", F.round("off_target", 6).alias("off_target"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(_read(spark, sf_dir, "documents"), width=4, percent=85)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs)).select(
        "doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected"
    )


ORACLE_EXACT = """
WITH a AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS s
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY s) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       s AS text_sha256
FROM a WINDOW w AS (PARTITION BY s ORDER BY n DESC, doc_id)
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE_URLS = rf"""
WITH a AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
b AS (
  SELECT *, '.' || host AS h,
         CASE WHEN ends_with('.' || host, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
              WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
              WHEN ends_with('.' || host, '.net') AND starts_with(path, '/es/') THEN 'net/es/'
              WHEN ends_with('.' || host, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
              WHEN ends_with('.' || host, '.com') AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM a)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
            WHEN rule IS NOT NULL THEN 'block'
            WHEN substr(md5(regexp_extract(host, '[^.]+\.[^.]+\.[^.]+$', 0)), 1, 1) IN ('0', '1')
              AND regexp_extract(host, '[^.]+\.[^.]+\.[^.]+$', 0) <> '' THEN 'block'
            ELSE 'allow' END AS verdict
FROM b
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_embedding_near_dedup, op2_toxicity, op3_exact_dedup, op4_url_filters, op5_sharding, op6_bpe, op7_pii,
        op8_mixing, op9_ngram_jaccard, op10_language_id,
    )}


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": ORACLE_EXACT, "op4_url_filters": ORACLE_URLS}
