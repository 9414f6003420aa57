"""Exact duplicates by sorting the content.

Sampled splitters cut the order of (first bytes, digest, identifier) into ranges,
so one range may begin and end inside a large group of copies; each range is sorted
outside memory, where equal texts are neighbours and are compared in full. Only the
first and last group of a range can go on in the next range, so two rows a range
are compared again, in full, and joined back.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlat.llm.common import rows_that_stay, text_of
from netlat.session import settle

#: Splitters hold so many first characters; the digest and the identifier follow.
HEAD = 24

_RUNS = "id long, keep_id long, group_size long, kept boolean, text_sha256 string, range int, edge int, edge_text string"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted range with the group they stand in. edge: 1 for the range's
    first group, 2 for its last, else 0. Of a group that goes on only the identifiers
    are held, in the slices they came in, and go out slice by slice when it ends."""
    at = TaskContext.get().partitionId()
    first, text, digest, held = True, None, None, []

    def shown(ids: pa.Array, keep: pa.Array, sizes: np.ndarray, begins: np.ndarray, hashes: pa.Array, edge: int, edge_text: str | None = None) -> pa.RecordBatch:
        kept = np.zeros(len(ids), bool)
        kept[begins] = True
        said = np.full(len(ids), None, object)
        said[begins] = edge_text
        columns = [ids, keep, pa.array(sizes, pa.int64()), pa.array(kept), hashes, pa.array(np.full(len(ids), at), pa.int32())]
        columns += [pa.array(np.full(len(ids), edge), pa.int32()), pa.array(said, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["id", "keep_id", "group_size", "kept", "text_sha256", "range", "edge", "edge_text"])

    def ended(edge: int) -> Iterator[pa.RecordBatch]:
        size, keep = sum(map(len, held)), held[0][:1]
        for k, ids in enumerate(held):
            same = lambda one: one.take(pa.array(np.zeros(len(ids), np.int64)))
            begins = np.zeros(0 if k else 1, np.int64)
            yield shown(ids, same(keep), np.full(len(ids), size), begins, same(pa.array([digest], pa.string())), edge, text if edge else None)

    for batch in batches:
        if not batch.num_rows:
            continue
        ids, hashes, texts = batch.column("id"), batch.column("text_sha256"), batch.column("text")
        other = np.ones(batch.num_rows, bool)
        other[1:] = pc.not_equal(texts.slice(1), texts.slice(0, len(texts) - 1)).to_numpy(zero_copy_only=False)
        other[0] = not held or texts[0].as_py() != text
        starts = np.flatnonzero(other)
        begin = int(starts[0]) if len(starts) else batch.num_rows
        if begin:
            held.append(ids.slice(0, begin))
        if not len(starts):
            continue
        if held:
            yield from ended(int(first))
            first = False
        last = int(starts[-1])
        if first and last > begin:
            # The range's first group begins and ends in this batch.
            held, text, digest, begin = [ids.slice(0, int(starts[1]))], texts[0].as_py(), hashes[0].as_py(), int(starts[1])
            yield from ended(1)
            first = False
        if last > begin:
            inner = starts[(starts >= begin) & (starts < last)] - begin
            sizes = np.diff(np.append(inner, last - begin))
            keep = ids.slice(begin, last - begin).take(pa.array(np.repeat(inner, sizes)))
            yield shown(ids.slice(begin, last - begin), keep, np.repeat(sizes, sizes), inner, hashes.slice(begin, last - begin), 0)
        held, text, digest = [ids.slice(last)], texts[last].as_py(), hashes[last].as_py()
    if held:
        yield from ended(1 if first else 2)


def content_groups(docs: DataFrame, id_col: str = "doc_id", text: Column | None = None, keep: str = "smallest") -> DataFrame:
    """One row for each row: the identifier, keep_id (that of the row that stays),
    group_size, kept, text_sha256.

    text: the normalised text, by default the column text as it is, null as empty.
    Exactly one row of a group is kept, also when rows repeat with their identifier;
    a null identifier comes after all others. Other columns are ignored, an empty
    table gives an empty table.
    """
    order = F.col("id").asc_nulls_last() if keep == "smallest" else F.col("id").desc_nulls_last()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (text_of() if text is None else F.coalesce(text, F.lit(""))).alias("text"))
    rows = rows.withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256)).withColumn("head", F.substring("text", 1, HEAD))
    ranges = rows.repartitionByRange("head", "text_sha256", order).sortWithinPartitions("head", "text_sha256", "text", order)
    runs = settle(ranges.select("id", "text", "text_sha256").mapInArrow(_runs, _RUNS), "content-sort")

    ends = runs.where("edge > 0 AND kept").select("range", "edge", "edge_text", "keep_id", "group_size")
    at = F.struct("range", "edge")
    whole = ends.groupBy("edge_text").agg(
        F.min_by("keep_id", at).alias("whole_keep"),
        F.sum("group_size").alias("whole_size"),
        F.min(at).alias("whole_first"),
        F.collect_list(at).alias("parts"),
    )
    # A group has at most two rows a range, so the list is as long as its ranges.
    whole = whole.select("whole_keep", "whole_size", "whole_first", F.explode("parts").alias("part"))
    whole = whole.select("whole_keep", "whole_size", "whole_first", F.col("part.range").alias("range"), F.col("part.edge").alias("edge"))
    edge = runs.where("edge > 0").drop("keep_id", "group_size").join(whole, ["range", "edge"])
    edge = edge.select(
        "id",
        F.col("whole_keep").alias("keep_id"),
        F.col("whole_size").alias("group_size"),
        (F.col("kept") & (F.struct("range", "edge") == F.col("whole_first"))).alias("kept"),
        "text_sha256",
    )
    inner = runs.where("edge = 0").select("id", "keep_id", "group_size", "kept", "text_sha256")
    return inner.unionByName(edge).withColumnRenamed("id", id_col)


def dedup(docs: DataFrame, id_col: str = "doc_id", keep: str = "smallest") -> DataFrame:
    """The rows that stay, with all their columns. Rows that share an identifier are
    told apart by their text; of such rows with the same text one stays."""
    stay = content_groups(docs, id_col, keep=keep).where("kept").select(F.col(id_col).alias("id"), F.col("text_sha256").alias("mark"))
    return rows_that_stay(docs, stay, F.sha2(text_of().cast("binary"), 256), id_col, once=True)
