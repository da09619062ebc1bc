"""The operators' registered queries, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Bpe, decode_texts, encode_texts
from .chat import link_tool_calls, messages
from .decontam import decontaminate
from .dedup import near_duplicates
from .html_text import extract_text
from .licenses import scan_licenses
from .lm import score_texts
from .mixing import mix
from .phrases import mine_phrases
from .quality import quality_rules
from .repair import damaged, repair
from .sharding import shard
from .sql import SQL
from .url_filter import judge_urls, seed_urls

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"), clean=False)
    stats = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines", "removed_chars"]
    return out.select("doc_id", *[F.col(f"quality.{c}").alias(c) for c in stats])


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge_urls(table(spark, sf_dir, "pages"), seed_urls(spark))
    return out.select("page_id", *[F.col(f"url_filter.{c}").alias(c) for c in ("host", "path", "rule", "verdict", "score")])


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "leak.*")


def op7_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.col("mix.copies")).alias("taken"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_tool_calls(messages(table(spark, sf_dir, "conversations")))


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.array_join("licence.sentence_ids", ",").alias("sentence_ids"), F.array_join("licence.licences", ",").alias("licences"), F.col("licence.licence").alias("licence"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents")).select("doc_id", "shard.*")


def op11_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    bpe = Bpe(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    out = decode_texts(encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), bpe), bpe)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_quality_rules, op2_minhash_near_dedup, op3_url_filters, op4_html_extraction, op5_lm_scoring, op6_benchmark_decontamination,
    op7_mixing_sources, op8_chat_formatting, op9_license_scans, op10_sharding, op11_byte_level_bpe, op12_phrase_collocations, op13_conversation_repair,
)}
__all__ = ["QUERIES", "SQL"]
