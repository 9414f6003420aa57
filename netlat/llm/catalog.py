"""The registered query of each operator, over its whole table, and its plain SQL
where SQL can say it."""

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlat.llm import bpe, exact, frames, language, lexical, licenses, near, negatives, packing, quality_lm, rules, token_cache, urls
from netlat.session import scratch_path, shared_path

QUERIES = {}
ORACLE = {}
BYTES_50K, WORDS_49K = "byte_bpe_50k.json", "word_bpe_49k.json"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(spark, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query()
def op1_kneser_ney(spark, sf):
    return quality_lm.classify(table(spark, sf, "documents"), table(spark, sf, "labels")).drop("row_hash")


@query()
def op2_token_frames(spark, sf):
    folder = scratch_path(spark, "token-frames")
    manifest = frames.write_token_files(table(spark, sf, "documents"), folder, public_tokenizers.path(BYTES_50K), end_id=2)
    back = frames.read_token_files(spark, folder, manifest)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query()
def op3_pattern_packing(spark, sf):
    _, placed = packing.pack(table(spark, sf, "documents"), public_tokenizers.path(WORDS_49K), end_id=1, size=4096)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query(licenses.sql())
def op4_license_join(spark, sf):
    return licenses.labels(licenses.scan(table(spark, sf, "documents")))


@query(rules.sql())
def op5_rule_ledger(spark, sf):
    return rules.apply_policy(rules.ledger(table(spark, sf, "documents")))


@query()
def op6_token_counts(spark, sf):
    counts = token_cache.count_tokens(table(spark, sf, "documents"), shared_path(spark, "token-counts"), public_tokenizers.path(BYTES_50K))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


@query()
def op7_prob_minhash(spark, sf):
    return near.classes(table(spark, sf, "documents")).drop("row_hash")


@query()
def op8_backtrack_bpe(spark, sf):
    path = public_tokenizers.path(BYTES_50K)
    both = bpe.decode(bpe.encode(table(spark, sf, "documents"), path), path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("""SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
sha256(coalesce(text, '')) AS text_sha256 FROM documents""")
def op9_content_sort(spark, sf):
    return exact.content_groups(table(spark, sf, "documents"), keep="largest")


@query()
def op10_url_trees(spark, sf):
    return urls.judge(table(spark, sf, "pages"))


@query(lexical.sql())
def op11_lexical_search(spark, sf):
    return lexical.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"), most=20)


@query(negatives.sql())
def op12_hard_negatives(spark, sf):
    rows = table(spark, sf, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


@query()
def op13_string_kernel(spark, sf):
    return language.languages(table(spark, sf, "documents"))
