"""The corpus pipeline: each stage takes the documents that its predecessor kept and applies one operator to all."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strandmill.llm import langid, neardup, packing, pii, toxicity
from strandmill.llm.queries import KEY
from strandmill.llm.shared import table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents that it rejects go (no letters, null texts among them, or like no known language); repeated rows are judged each."""
    return langid.keep_identified(docs, langid.learn(docs))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents predicted toxic go. Null and empty texts are scored like others."""
    return toxicity.keep_clean(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: the smallest doc_id of each group of near duplicates stays, with all its rows; so do null doc_ids and texts without words."""
    return neardup.keep_first(docs, words=5, percent=80)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: surrogates in the place of personal data; n_chars follows. Null and empty texts stay."""
    return pii.redacted(docs, KEY)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: (doc_id, start, length, ids, doc_tokens, sequence_id, offset) of every piece."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), window=2048, end=1)


STAGES = [("language", language), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("pii", private), ("packing", packed)]

#: The stages rest on fitted models and a tokenizer, which SQL cannot express; tests/llm/test_pipeline.py holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each one's result written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
