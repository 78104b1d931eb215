"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import prepare, table
from . import bpe, decontam, exactdedup, htmlextract, lm, quality, sharding, simhash, tokencount, urlfilter


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(prepare(spark), sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(prepare(spark), sf_dir, "pages")
    return urlfilter.look_up(pages, urlfilter.overused(pages))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(prepare(spark), sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(prepare(spark), sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(prepare(spark), sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(prepare(spark), sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.owners(table(prepare(spark), sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(prepare(spark), sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlextract.extract(table(prepare(spark), sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_url_filter": op2_url_filter,
    "op3_bpe": op3_bpe,
    "op4_simhash": op4_simhash,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_token_counts": op6_token_counts,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_sharding": op8_sharding,
    "op9_quality": op9_quality,
    "op10_html_extraction": op10_html_extraction,
}

ORACLE_SQL: dict[str, str] = {
    "op2_url_filter": r"""
        WITH parts AS (
            SELECT page_id, url, trim(url) AS u,
                regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)(?::\d*)?([^?#]*)(?:\?([^#]*))?', ['h', 'p', 'q']) AS m,
                regexp_matches(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//') AS whole
            FROM pages
        ), named AS (
            SELECT *, CASE WHEN whole THEN regexp_replace(rtrim(lower(m.h), '.'), '^(www\d?|m)\.([^.]+\.)', '\2') WHEN url IS NOT NULL THEN '' END AS host FROM parts
        ), keyed AS (
            SELECT page_id, url, host, CASE WHEN NOT whole THEN u
                ELSE host || rtrim(m.p, '/') || CASE WHEN coalesce(m.q, '') = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(m.q, '&')), '&') END END AS url_key
            FROM named
        ), hosts AS (
            SELECT host FROM keyed WHERE host <> '' GROUP BY host HAVING count(*) > 0.05 * (SELECT count(url) FROM keyed)
        ), urls AS (SELECT url_key FROM keyed WHERE url IS NOT NULL GROUP BY url_key HAVING count(*) > 1)
        SELECT page_id, url_key, host, CASE WHEN url IS NULL THEN NULL
            WHEN EXISTS (SELECT 1 FROM hosts h WHERE k.host = h.host OR ends_with(k.host, '.' || h.host)) THEN 'host'
            WHEN url_key IN (SELECT url_key FROM urls) THEN 'url' ELSE 'none' END AS verdict
        FROM keyed k""",
    "op7_exact_dedup": """
        SELECT doc_id, CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY text) END AS owner_id
        FROM documents""",
}
