"""The corpus pipeline: from raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. Every stage works on all rows that its predecessor kept,
and judges them one by one unless it says otherwise; an empty table gives an empty result in every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from attestra.llm import decontaminate, language_id, ngram_join, packing, quality
from attestra.llm.queries import trusted_ids
from attestra.llm.work import forget, scratch
from attestra.session import table


def recognised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model recognises, a null lang being replaced by the predicted one.

    Null, empty and letterless texts go, and texts of which the model knows too few words or whose language is doubtful.
    """
    return language_id.with_language(docs)


def readable(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's threshold; null and empty texts go. Without a trusted text, all others stay."""
    return quality.accepted(docs, trusted_ids(spark, sf_dir))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group that near-duplicate links join; of its repeated rows one.

    Rows with null doc_id and texts without words are in no group and stay.
    """
    return ngram_join.deduplicated(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark; null texts stay. Without items nothing is contaminated."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens; a null text is one token, the closing id."""
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", recognised), ("quality", readable), ("ngram_dedup", distinct), ("decontamination", uncontaminated), ("packing", packed)]
#: SQL can't express the first three stages; tests compare the pipeline with a plain version on a small fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents. A stage's tables go when its result is written, and its input when the next one's is."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            forget(before)
        before = docs
    return docs
