"""Token counts kept under the digests of content and tokenizer.

Counts are looked up by the digest of the whole text and that of the tokenizer; of
the texts without a count each different one is encoded once, and the new counts are
added to the store, a Parquet folder for each tokenizer that only grows.
"""

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlat.llm.common import text_of
from netlat.llm.pieces import encoder

STORE = "digest binary, version string, n_tokens long"


def version_of(tokenizer: str) -> str:
    """Digest of the tokenizer's file and the library that reads it."""
    import tokenizers

    return hashlib.sha256(Path(tokenizer).read_bytes() + tokenizers.__version__.encode()).hexdigest()


def stored_counts(spark: SparkSession, store: str, version: str, wanted: DataFrame) -> DataFrame:
    """digest and n_tokens of the wanted digests that one tokenizer's part of the store
    has; none where there is no store yet. Two runs at once may add a digest twice, so
    those found are made distinct."""
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    rows = spark.read.schema(STORE).parquet(store).where(F.col("version") == version).join(wanted, "digest", "left_semi")
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _count(tokenizer: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in batches:
            counts = [len(coder.one(t.as_py())) // 4 for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return count


def count_tokens(docs: DataFrame, store: str, tokenizer: str, id_col: str = "doc_id") -> DataFrame:
    """One row a row: the identifier, digest, n_bytes, n_tokens.

    A null text counts as empty. Rows with the same text share one count, whatever
    their identifiers. Other columns are ignored; an empty table adds nothing.
    """
    spark, version = docs.sparkSession, version_of(tokenizer)
    text = text_of()
    digest = F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")
    rows = docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), digest)
    wanted = rows.select("digest").distinct()
    known = stored_counts(spark, store, version, wanted)
    # Copies are reduced where they are read, so a large group sends a row a task.
    texts = docs.select(digest, text.alias("text")).join(known, "digest", "left_anti")
    misses = texts.groupBy("digest").agg(F.first("text").alias("text"))
    fresh = misses.mapInArrow(_count(tokenizer), "digest binary, n_tokens long")
    fresh.select("digest", F.lit(version).alias("version"), "n_tokens").write.mode("append").partitionBy("version").parquet(store)
    return rows.join(stored_counts(spark, store, version, wanted), "digest").select(id_col, "digest", "n_bytes", "n_tokens")
