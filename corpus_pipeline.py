"""A training corpus in five stages; each takes (spark, docs, sf_dir) and returns the next one's documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from entitylens.llm.common import written
from entitylens.llm.mixing import mixed_documents
from entitylens.llm.packing import pack_documents
from entitylens.llm.quality import filter_documents
from entitylens.llm.simhash import one_of_each_group
from entitylens.llm.span_dedup import remove_repeated_sentences


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that fail the base rule or any rule of the cascade go."""
    return filter_documents(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of each group of near copies (five-word shingles, similarity 0.8 or more) the smallest doc_id stays."""
    return one_of_each_group(docs, shingle_words=3, distance=8, similarity_words=5, least_similarity=0.8)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: sentences covered by a repeated span go, and documents of which no word is left."""
    return remove_repeated_sentences(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3 with its production budget (all tokens), target entropy and repetition limit."""
    return mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: one row for each piece of a document, with its sequence and place."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, size=4096)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: Sentence spans, token ids and the packers' order have no SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
