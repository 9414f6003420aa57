"""From raw documents to packed training sequences, a stage at a time.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept,
and gives the documents that stay, with their columns; the last gives where each
piece of a document goes.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from netlat.llm import exact, near, packing, quality_lm, rules
from netlat.session import settle

TOKENIZER, END_ID, SIZE = "word_bpe_49k.json", 1, 4096


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is not above their language's threshold."""
    return quality_lm.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the current policy."""
    return rules.keep(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest identifier."""
    return exact.dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the document with the smallest identifier."""
    return near.dedup(docs)


def pattern_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, each with its sequence and offset."""
    _, placed = packing.pack(docs, public_tokenizers.path(TOKENIZER), END_ID, SIZE)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("pattern packing", pattern_packing),
]

#: Perplexities, sketches and packing are beyond SQL; tests hold the stages against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's documents are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
