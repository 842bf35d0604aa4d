"""The text operators' queries over whole tables, one for each operator, with the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of at most 4096 tokens."""
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every whole text for quality."""
    from .quality import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and compression bands of every whole text."""
    from .compression import judge

    return judge(table(spark, sf_dir, "documents"))


def op4_mpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store every whole text as MPEG audio and read it back."""
    from .mpeg import audio_columns

    return audio_columns(table(spark, sf_dir, "documents"), with_media=False)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text with the byte-level vocabulary."""
    from .bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), digests=True)


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every page's url by rules, and by a list of hosts.

    No list is given, so a rule makes one that SQL can state too: hosts whose MD5 begins with a zero or a one.
    """
    from pyspark.sql import functions as F

    from .urls import host_of, judge

    pages = table(spark, sf_dir, "pages")
    hosts = pages.select(host_of(F.col("url")).alias("key")).distinct()
    listed = hosts.where((F.col("key") != "") & F.substring(F.md5(F.col("key").cast("binary")), 1, 1).isin("0", "1"))
    return judge(pages, listed)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every whole text for toxicity."""
    from .toxicity import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove words in windows of 35 words that also start elsewhere."""
    from .anchors import deduplicate

    return deduplicate(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Find personal data in every whole text."""
    from .pii import scan

    return scan(table(spark, sf_dir, "documents"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked at a Jaccard similarity of 0.85 or more."""
    from .jaccard import join_components

    return join_components(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_quality, op3_compression, op4_mpeg, op5_bpe, op6_urls, op7_toxicity, op8_substrings, op9_pii, op10_jaccard)}

OP6 = """
WITH rows AS (
    SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages
), listed_keys AS (SELECT DISTINCT host AS key FROM rows WHERE host <> '' AND substr(md5(host), 1, 1) IN ('0', '1')),
blocked AS (
    SELECT DISTINCT h.host FROM (SELECT DISTINCT host FROM rows WHERE host <> '') h
    JOIN listed_keys k ON h.host = k.key OR ends_with(h.host, '.' || k.key)
), ruled AS (
    SELECT rows.*, blocked.host IS NOT NULL AS listed,
        CASE WHEN (rows.host = 'example.com' OR ends_with(rows.host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
             WHEN (rows.host = 'example.net' OR ends_with(rows.host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
             WHEN (rows.host = 'org' OR ends_with(rows.host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
             WHEN (rows.host = 'net' OR ends_with(rows.host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
    FROM rows LEFT JOIN blocked ON rows.host = blocked.host
)
SELECT page_id, host, path, rule,
    CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM ruled
"""
ORACLES: dict[str, str] = {"op6_urls": OP6}
