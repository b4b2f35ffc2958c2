"""A corpus pipeline over ``documents``: five stages, each on all that its predecessor kept.

1. language identification: documents without letters, or without a language that makes up half of their words, go;
2. exact de-duplication: of texts that are equal but for white space, the longest stays;
3. near de-duplication: five-word shingles, similarity 0.8; one document of each component of links stays;
4. mixing: documents are repeated, as rows, until every source has its share of the words;
5. encoding: byte-level BPE, with a round trip through decoding.

All stages but the last return the columns of documents. Rows that mixing repeats are encoded as often as they come.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veraframe.llm import bpe, exact_dedup, jaccard_join, language_id, mixing
from veraframe.llm.common import materialise

SHINGLE_WORDS = 5
SIMILARITY = (80, 100)


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs)


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.drop_near_copies(docs, "doc_id", "text", SHINGLE_WORDS, *SIMILARITY)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language_id", identify), ("exact_dedup", dedup_exact), ("near_dedup", dedup_near), ("mixing", mix), ("byte_bpe", encode)]

#: Mixture inference and BPE are not SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
