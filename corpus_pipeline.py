"""Corpus pipeline over ``documents``: toxicity, near-duplicates, benchmark decontamination, BPE encoding.

Each stage takes (spark, docs, sf_dir) and works on everything the stage before
kept. A stage's result is written as Parquet and read back as the next one's
``docs``, so a lost executor repeats part of one stage and no more. All stages
but the last return the columns of ``docs``.

Near-duplicates are what operator 6 links: fingerprints of three-word shingles
within two bits. Stages cannot be stated in SQL (a fitted classifier, components, a tokenizer),
so there is no ``ORACLE_SQL``; tests hold every stage against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe_transducer, decontaminate, simhash_index, toxicity
from tessera.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows predicted toxic go. Labels of the given documents train the score."""
    return toxicity.acceptable(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by SimHash fingerprints the document with the smallest id stays."""
    return simhash_index.one_per_component(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, as digests, beside the digest of the decoded text."""
    import public_tokenizers

    return bpe_transducer.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
