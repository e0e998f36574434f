"""The corpus pipeline: toxic and poor documents go, one of each near-duplicate group stays, the rest is packed."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillmark.llm import jaccard, packing, quality, store, toxicity
from quillmark.sources.tables import table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model learned from all labels does not call toxic."""
    model = toxicity.trained(docs, table(spark, sf_dir, "labels"), "toxic")
    return toxicity.filtered(docs, model)


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the risk-controlled cutoffs of their language."""
    return quality.filtered(docs, table(spark, sf_dir, "labels"), "quality", "lang")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group linked by shared 5-word shingles."""
    return jaccard.deduplicated(docs)


def in_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, packed into sequences of at most 2048 tokens."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", without_toxic), ("quality_rules", of_quality), ("ngram_jaccard_join", without_copies), ("packing", in_windows)]

#: Fitted weights, certified cutoffs and subword merges have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store.saved(stage(spark, docs, sf_dir), name)
    return docs
