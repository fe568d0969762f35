"""Registered queries of this package: one ``opN_<name>`` per operator, production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe_transducer, decontaminate, gated_lm, prefix_trie, quotation, simhash_index, sketches
from tessera.llm import topk_scan, toxicity, url_filter, warc, word_runs
from tessera.llm.common import table
from tessera.llm.token_counts import count_tokens

Query = Callable[[SparkSession, str], DataFrame]


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.edited_neighbours(table(spark, sf_dir, "documents"))


def op2_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_transducer.round_trip(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), limit=1024)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.Decontaminator(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.report().withColumnRenamed("id", "doc_id")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op6_simhash_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_index.near_duplicates(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.pages_through_lists(spark, sf_dir)


def op8_quotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotation.linked_conversations(spark, sf_dir)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_gated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated_lm.scored(table(spark, sf_dir, "documents"))


def op11_topk_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_scan.nearest_vectors(table(spark, sf_dir, "embeddings"))


def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_runs.run_report(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Query] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_bpe_transducer": op2_bpe_transducer,
    "op3_token_counts": op3_token_counts,
    "op4_decontaminate": op4_decontaminate,
    "op5_warc": op5_warc,
    "op6_simhash_index": op6_simhash_index,
    "op7_url_filter": op7_url_filter,
    "op8_quotation": op8_quotation,
    "op9_toxicity": op9_toxicity,
    "op10_gated_lm": op10_gated_lm,
    "op11_topk_scan": op11_topk_scan,
    "op12_word_runs": op12_word_runs,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE: dict[str, str] = {
    "op4_decontaminate": decontaminate.ORACLE,
    "op5_warc": warc.ORACLE,
    "op7_url_filter": url_filter.ORACLE,
    "op11_topk_scan": topk_scan.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
}
