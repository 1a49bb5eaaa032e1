"""Registered queries of the operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from homespell.llm import decontamination, line_index, near_dedup, ngram_model, packing, personal_data, preferences, prefix_trie, quality_classifier, quality_rules, spelling, token_records, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences.replaced_preferences(table(spark, sf_dir, "conversations"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality_rules.STATISTICS, "base_failed", "kept", "anomaly")


def op5_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_model.score(table(spark, sf_dir, "documents"), least_count=1)


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and the benchmark item it holds."""
    found = decontamination.passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start_word", "n_words", "similarity", F.lit(True).alias("contaminated"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_spans(table(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_index.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query for query in (
        op1_quality_classifier, op2_best_fit_packing, op3_chat_formatting, op4_quality_rules, op5_elias_fano_lm,
        op6_benchmark_decontamination, op7_warc, op8_binary_records, op9_pii, op10_minhash_near_dedup, op11_conversation_trie, op12_spelling_variants,
        op13_line_dedup,
    )
}

ORACLE_SQL: dict[str, str] = {"op3_chat_formatting": preferences.REPLACED_SQL, "op11_conversation_trie": prefix_trie.TRIE_SQL,
                               "op12_spelling_variants": spelling.VARIANTS_SQL, "op13_line_dedup": line_index.LINES_SQL}
