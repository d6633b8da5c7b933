"""The queries of this subpackage, one for each operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.llm import license_scan
from inkfold.llm.bpe import ByteBpe, load_ranks
from inkfold.llm.chat_format import format_chats, masked_text, parse
from inkfold.llm.common import table
from inkfold.llm.embedding_dedup import near_vectors
from inkfold.llm.minhash_dedup import near_texts
from inkfold.llm.mixing import mix
from inkfold.llm.progressive_jpeg import media_digests, store_texts
from inkfold.llm.quality import judge
from inkfold.llm.sharding import shard
from inkfold.llm.url_filter import Rule, judge_urls

VOCABULARY = "byte_bpe_multi_50k.tiktoken"

URL_RULES = [
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
]
# Domains of bad repute under three top-level domains, and a list of 10,000 more.
BAD_NAMES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
BLOCKED_DOMAINS = [f"{name}.example.{top}" for name in BAD_NAMES for top in ("com", "net", "org")] + [f"listed{i}.example" for i in range(10_000)]


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_texts(table(spark, sf_dir, "documents"), shingle_words=4, percent=80)


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(store_texts(table(spark, sf_dir, "documents")))


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = license_scan.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = F.col("license_hits")
    return hits.select(
        "doc_id",
        F.size(found).cast("long").alias("n_hits"),
        F.array_max(found["permille"]).cast("long").alias("best_permille"),
        F.array_join(F.array_sort(F.array_distinct(found["license"])), ",").alias("licenses"),
    )


def bpe_digests(documents: DataFrame, **limits: int) -> DataFrame:
    """limits are those of ByteBpe.encode(), which change what a task holds but no result."""
    bpe = ByteBpe(load_ranks(public_tokenizers.path(VOCABULARY)), public_tokenizers.PATTERN)
    told = {"n_tokens": "count", "ids": "written", "decoded": "decoded"}
    return bpe.encode(documents.select("doc_id", "text"), "text", told, drop=("text",), **limits).select(
        "doc_id", "n_tokens", F.sha2(F.col("ids"), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256")
    )


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = spark.sql(
        "SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, '</s>[INST] ok [/INST]' AS text "
        "FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(hard)
    formatted = F.col("formatted")
    turns, loss = parse(formatted), masked_text(formatted, F.col("loss_spans"))
    lines = F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return format_chats(rows).select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length(formatted).cast("long").alias("formatted_chars"),
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), shards=40)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, "url", URL_RULES, BLOCKED_DOMAINS).select("page_id", "host", "path", "rule", "verdict")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_embedding_near_dedup, op2_minhash_near_dedup, op3_media_columns, op4_license_scans, op5_byte_bpe,
            op6_chat_formatting, op7_sharding, op8_quality_classifier, op9_url_filters, op10_mixing,
        )
    }


_CONTROL = r"([<\[])(\\*)(/s>|/?INST\])"

_CHATS = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
sized AS (
  SELECT *, length(role) + length(text) + 17 AS plain,
    len(regexp_extract_all(role, '{_CONTROL}')) + len(regexp_extract_all(text, '{_CONTROL}')) AS escapes,
    regexp_matches(role || chr(0) || text, '</s>|\\[/?INST\\]')::INT AS clash FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (4 + sum(plain) + CASE WHEN max(clash) = 1 THEN sum(escapes) ELSE 0 END)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id"""

_URLS = """
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
judged AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN regexp_matches(host, '(^|[.])(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)[.]example[.](com|net|org)$')
    OR regexp_matches(host, '(^|[.])listed([0-9]|[1-9][0-9]{1,3})[.]example$') THEN 'block' ELSE 'allow' END AS verdict
FROM judged"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_license_scans": license_scan.oracle("documents"),
        "op6_chat_formatting": _CHATS,
        "op9_url_filters": _URLS,
    }
