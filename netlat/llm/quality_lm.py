"""Quality by the perplexity of a language model trained on trusted text.

The model is interpolated modified Kneser-Ney over the characters of each language,
of order N. Tables are cut by n-gram: counts, contexts and lower orders meet in joins
on (language, n-gram). Texts are not moved: documents are read in blocks of rows of
their files; each block gives its different n-grams with their trusted counts, gets
back their probabilities as a file of its own in the shared folder, and a second
reading of the documents looks them up. All n-grams of all documents take part.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netlat.llm.common import file_system, free_worker, qualified, rows_that_stay, text_of
from netlat.session import scratch_path, settle

#: Characters in an n-gram.
N = 4
#: Rows of a file that make up a block.
BLOCK = 8192
#: One trusted document in so many is left out of the counts, to set thresholds by.
HELD = 5
#: A document is rejected when its perplexity is above this quantile of the trusted
#: documents of its language, times a margin for texts unlike them: the one with the
#: least sum of the shares of held-out trusted documents rejected and of a fifth of those
#: labelled of bad quality kept, out of those from 0.9 to 1.4 (README).
QUANTILE, MARGIN = 0.95, 1.05
#: Perplexities are counted in steps of a thousandth of their logarithm.
STEPS = 1000

_BEGIN, _END = "\x02", "\x03"
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
#: Characters that are looked at together.
_CHARS = 1_000_000


def _hash(langs: np.ndarray, column: Callable[[int], np.ndarray], n: int) -> np.ndarray:
    """langs: a number of the language of each n-gram; column: their k-th characters."""
    h = langs * _FACTORS[-1]
    for k in range(n):
        h = (h ^ (h >> np.uint64(29))) * _FACTORS[0] + column(k) * _FACTORS[1 + k % 4]
    return h ^ (h >> np.uint64(32))


def _lang_number(lang: str) -> int:
    n = 0
    for b in lang.encode():
        n = (n * 1000003 ^ (b + 1)) % 2**61
    return n


def _grams(texts: list[str], langs: list[str], n: int) -> tuple[np.ndarray, ...]:
    """All windows of n characters (a view), where those inside a text begin, their
    hashes, and how many each text has: one a character and one for the end."""
    padded = "".join(f"{_BEGIN * (n - 1)}{t}{_END}" for t in texts)
    codes = np.frombuffer(padded.encode("utf-32-le"), "<u4").astype(np.uint64)
    sizes = np.array([len(t) + 1 for t in texts])
    inside = np.ones(len(codes), bool)
    ends = np.cumsum(sizes + n - 1)
    for k in range(1, n):
        inside[ends - k] = False
    windows = np.lib.stride_tricks.sliding_window_view(codes, n)
    starts = np.flatnonzero(inside[: len(windows)])
    numbers = np.repeat(np.array([_lang_number(x) for x in langs], np.uint64), sizes)
    return windows, starts, _hash(numbers, lambda k: codes[starts + k], n), sizes


def _some(texts: list, *more: list) -> Iterator[tuple]:
    """Parts of the lists with about _CHARS characters or one text each."""
    begin, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t)
        if held >= _CHARS or k == len(texts) - 1:
            yield (texts[begin : k + 1], *(m[begin : k + 1] for m in more))
            begin, held = k + 1, 0


def in_blocks(docs: DataFrame, id_col: str) -> DataFrame:
    """id, row_hash, lang, text, block and row: the row's place in its block. A table that is not
    read from files, or whose columns hide where, is written first."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    wanted = [F.col(id_col).cast("long").alias("id"), F.xxhash64(text_of()).alias("row_hash"), lang.alias("lang"), text_of().alias("text")]
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    try:
        if "_metadata" in docs.columns:
            raise AnalysisException("a column of the table hides the metadata")
        rows = docs.select(*wanted, *place)
    except AnalysisException:
        rows = settle(docs.select(*wanted), "documents").select("id", "row_hash", "lang", "text", *place)
    block = F.concat(F.substring(F.sha2("_file", 256), 1, 16), F.lit("-"), F.floor(F.col("_row") / BLOCK).cast("string"))
    return rows.select("id", "row_hash", "lang", "text", block.alias("block"), (F.col("_row") % BLOCK).cast("int").alias("row"))


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Identifiers labelled as of good quality and not toxic, each once."""
    each = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id"))
    good = each.agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    return good.where("q = 1 AND t = 0").select("id")


def held_out() -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(HELD)) == 0


def block_grams(rows: DataFrame, trusted: DataFrame, n: int) -> DataFrame:
    """block, lang, gram and count: the different n-grams of each block, and how often
    trusted documents have them. rows: of in_blocks; trusted: ids."""
    spark = rows.sparkSession
    # Only identifiers are joined; what a block must know is a list of its rows.
    flags = rows.select("id", "block", "row").join(trusted, "id").groupBy("block").agg(F.collect_set("row").alias("rows"))
    notes = scratch_path(spark, "trusted-rows")
    flags.repartition("block").write.partitionBy("block").parquet(notes)
    base = qualified(spark, notes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        fs, path = file_system(base)
        at, good, found = None, None, None
        for block, texts, langs, places in _by_block(batches, "row"):
            if block != at:
                if at is not None:
                    yield _different(at, found, n)
                known = _side(fs, path, block)
                at, found, good = block, ([], [], [], []), np.zeros(BLOCK, bool)
                for r in known.column("rows").to_pylist() if known is not None else ():
                    good[r] = True
            for some, some_langs, some_rows in _some(texts, langs, places):
                windows, starts, h, sizes = _grams(some, some_langs, n)
                codes, different = pd.factorize(h)
                first = np.empty(len(different), np.int64)
                first[codes[::-1]] = np.arange(len(h))[::-1]
                counted = np.bincount(codes, np.repeat(good[some_rows], sizes), len(different))
                owner = np.searchsorted(np.cumsum(sizes), first, "right")
                for into, value in zip(found, (different, counted, windows[starts[first]].astype("<u4"), np.array(some_langs, object)[owner]), strict=True):
                    into.append(value)
        if at is not None:
            yield _different(at, found, n)

    grams = rows.select("lang", "text", "block", "row").mapInArrow(run, "block string, lang string, gram string, count long")
    return settle(grams, "block-grams")


def _different(block: str, found: tuple[list, ...], n: int) -> pa.RecordBatch:
    """The n-grams of a block's parts (hashes, counts, characters, languages), each once."""
    h, counted, grams, langs = (np.concatenate(f) for f in found)
    codes, different = pd.factorize(h)
    first = np.empty(len(different), np.int64)
    first[codes[::-1]] = np.arange(len(h))[::-1]
    total = np.bincount(codes, counted, len(different)).astype(np.int64)
    flat = grams[first].tobytes().decode("utf-32-le")
    strings = [flat[k : k + n] for k in range(0, len(flat), n)]
    return pa.RecordBatch.from_arrays(
        [pa.array([block] * len(first), pa.string()), pa.array(langs[first].tolist(), pa.string()), pa.array(strings, pa.string()), pa.array(total)],
        names=["block", "lang", "gram", "count"],
    )


def _by_block(batches: Iterator[pa.RecordBatch], *more: str) -> Iterator[tuple]:
    """block, its texts, languages and further columns, as rows come. A block may come
    in parts, where a batch or a split of the file ends."""
    for batch in batches:
        blocks = batch.column("block").to_pylist()
        columns = [batch.column(c).to_pylist() for c in ("text", "lang", *more)]
        begin = 0
        for k in range(1, len(blocks) + 1):
            if k == len(blocks) or blocks[k] != blocks[begin]:
                yield (blocks[begin], *(c[begin:k] for c in columns))
                begin = k


def _side(fs, path: str, block: str) -> pa.Table | None:
    from pyarrow.fs import FileSelector

    files = [f.path for f in fs.get_file_info(FileSelector(f"{path}/block={block}", allow_not_found=True)) if f.path.endswith(".parquet")]
    tables = [pq.ParquetFile(fs.open_input_file(f)).read() for f in files]
    return pa.concat_tables(tables) if tables else None


def probabilities(grams: DataFrame, n: int) -> DataFrame:
    """lang, gram, p for each different n-gram of the table: interpolated modified
    Kneser-Ney from the counts. A lower order counts in how many longer n-grams it was
    seen; its discounts come from its counts of counts, by language."""
    tables = [settle(grams.groupBy("lang", "gram").agg(F.sum("count").alias("c")), f"order-{n}")]
    for k in range(n - 1, 0, -1):
        longer = tables[-1]
        shorter = longer.groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.sum((F.col("c") > 0).cast("long")).alias("c"))
        tables.append(settle(shorter, f"order-{k}"))
    below = None
    for k, table in enumerate(reversed(tables), 1):
        seen = table.where("c > 0")
        of = lambda v: F.sum((F.col("c") == v).cast("double"))
        counts = seen.groupBy("lang").agg(*[of(v).alias(f"n{v}") for v in (1, 2, 3, 4)], F.count("*").alias("kinds"))
        y = F.coalesce(F.try_divide("n1", F.col("n1") + 2 * F.col("n2")), F.lit(0.5))
        d = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(v - 0.05), F.coalesce(v - (v + 1) * y * F.try_divide(f"n{v + 1}", f"n{v}"), F.lit(v / 2))))
        # Written, so that its size is known and Spark can choose how to join it.
        discounts = settle(counts.select("lang", "kinds", *[d(v).alias(f"d{v}") for v in (1, 2, 3)]), f"discounts-{k}")
        less = F.when(F.col("c") >= 3, F.col("d3")).when(F.col("c") == 2, F.col("d2")).when(F.col("c") == 1, F.col("d1")).otherwise(0.0)
        context = F.substring("gram", 1, k - 1)
        held = seen.join(discounts, "lang").groupBy("lang", context.alias("context"))
        contexts = held.agg(F.sum("c").alias("total"), (F.sum(less) / F.sum("c")).alias("left"))
        rows = table.withColumn("context", context).join(discounts, "lang", "left").join(contexts, ["lang", "context"], "left")
        if below is None:
            # Below single characters all are as likely, one unknown among them.
            rows = rows.withColumn("q", 1.0 / (F.col("kinds") + 1))
        else:
            rows = rows.withColumn("shorter", F.substring("gram", 2, k - 1))
            rows = rows.join(below.select("lang", F.col("gram").alias("shorter"), F.col("p").alias("q")), ["lang", "shorter"])
        p = F.when(F.col("total").isNull(), F.col("q")).otherwise((F.col("c") - less) / F.col("total") + F.col("left") * F.col("q"))
        below = rows.select("lang", "gram", p.alias("p"))
    # Languages without trusted text have no probabilities.
    return settle(below.where("p IS NOT NULL"), "probabilities")


def score(rows: DataFrame, grams: DataFrame, probs: DataFrame, n: int) -> DataFrame:
    """id, row_hash, lang, n_grams, perplexity of each row; null where the language has no model."""
    spark = rows.sparkSession
    path = scratch_path(spark, "block-probabilities")
    found = grams.select("block", "lang", "gram").join(probs, ["lang", "gram"]).select("block", "lang", "gram", F.log("p").alias("log_p"))
    found.repartition("block").write.partitionBy("block").parquet(path)
    base = qualified(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        fs, folder = file_system(base)
        at, index, values, have = None, None, None, set()
        for block, texts, langs, ids, marks in _by_block(batches, "id", "row_hash"):
            if block != at:
                at, known = block, _side(fs, folder, block)
                index, values, have = None, None, set()
                if known is not None:
                    names = known.column("lang").combine_chunks()
                    flat = "".join(known.column("gram").to_pylist()).encode("utf-32-le")
                    codes = np.frombuffer(flat, "<u4").astype(np.uint64).reshape(-1, n)
                    coded = names.dictionary_encode() if not isinstance(names, pa.DictionaryArray) else names
                    have = set(coded.dictionary.to_pylist())
                    numbers = np.array([_lang_number(x) for x in coded.dictionary.to_pylist()], np.uint64)[coded.indices.to_numpy()]
                    # Two splits of a file may each have a part of the block.
                    h, first = np.unique(_hash(numbers, lambda k: codes[:, k], n), return_index=True)
                    index, values = pd.Index(h), known.column("log_p").to_numpy()[first]
            out = []
            for some, some_langs, some_ids, some_marks in _some(texts, langs, ids, marks):
                _, _, h, sizes = _grams(some, some_langs, n)
                if index is None:
                    sums = np.zeros(len(sizes))
                else:
                    # A language's n-grams are all there or, without a model, none is.
                    where = index.get_indexer(h)
                    sums = np.add.reduceat(np.where(where >= 0, values[where], 0.0), np.append(0, np.cumsum(sizes)[:-1]))
                for i, mark, lang, s, size in zip(some_ids, some_marks, some_langs, sums.tolist(), sizes.tolist(), strict=True):
                    out.append((i, mark, lang, size, float(np.exp(-s / size)) if lang in have else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.float64()), strict=True)], names=["id", "row_hash", "lang", "n_grams", "perplexity"])

    return settle(rows.select("id", "row_hash", "lang", "text", "block").mapInArrow(run, "id long, row_hash long, lang string, n_grams long, perplexity double"), "perplexities")


def thresholds(scored: DataFrame, trusted: DataFrame, quantile: float, margin: float) -> DataFrame:
    """lang and threshold from the trusted documents that were left out of the counts,
    or, where a language has none, from all its trusted ones. Counted by steps of the
    logarithm, so the quantile is exact up to one step and always the same."""
    known = scored.where("perplexity IS NOT NULL").join(trusted, "id").withColumn("step", F.floor(F.log("perplexity") * STEPS))
    steps = known.groupBy("lang", "step").agg(F.sum(held_out().cast("long")).alias("held"), F.count("*").alias("every"))
    total = Window.partitionBy("lang")
    steps = steps.withColumn("n", F.when(F.sum("held").over(total) > 0, F.col("held")).otherwise(F.col("every")))
    upto = F.sum("n").over(total.orderBy("step"))
    reached = steps.withColumns({"upto": upto, "total": F.sum("n").over(total)}).where(F.col("upto") >= quantile * F.col("total"))
    return reached.groupBy("lang").agg((F.exp((F.min("step") + 1) / STEPS) * margin).alias("threshold"))


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", n: int = N, quantile: float = QUANTILE, margin: float = MARGIN
) -> DataFrame:
    """One row a row: the identifier, row_hash (of the text), lang, n_grams, perplexity,
    threshold, kept.

    labels: identifier, quality (1: trusted) and toxic (1: not trusted). A null
    language is one of its own, a null text is empty. Documents of a language without
    trusted text cannot be judged: perplexity and threshold are null and they are kept.
    Labels of the same document must agree, else it is not trusted. Rows that repeat are
    judged each; an empty table gives an empty table. Other columns are ignored.
    """
    rows, trusted = in_blocks(docs, id_col), settle(trusted_ids(labels, id_col), "trusted")
    grams = block_grams(rows, trusted.where(~held_out()), n)
    scored = score(rows, grams, probabilities(grams, n), n)
    limits = settle(thresholds(scored, trusted, quantile, margin), "thresholds")
    kept = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    judged = scored.join(limits, "lang", "left").withColumn("kept", kept)
    return judged.select(F.col("id").alias(id_col), "row_hash", "lang", "n_grams", "perplexity", "threshold", "kept")


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents that are not rejected, with their columns as they were."""
    stay = classify(docs, labels, id_col).where("kept").select(F.col(id_col).alias("id"), F.col("row_hash").alias("mark"))
    return rows_that_stay(docs, stay, F.xxhash64(text_of()), id_col)
