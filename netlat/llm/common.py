"""Small helpers of this package's operators."""

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def text_of(column: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def rows_that_stay(docs: DataFrame, stay: DataFrame, mark: Column, id_col: str = "doc_id", once: bool = False) -> DataFrame:
    """The rows of docs that stay names by id and mark, with their columns as they were;
    with once, one row of those that repeat. mark tells texts apart: identifiers may
    be null or not unique."""
    names = ["_netlat_key", "_netlat_mark"]
    key = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-(2**63)))
    stay = stay.select(key("id").alias(names[0]), F.col("mark").alias(names[1]))
    rows = docs.withColumns({names[0]: key(id_col), names[1]: mark}).join(stay, names, "left_semi")
    # Both steps need the rows by the same keys, so they are shuffled once.
    return (rows.dropDuplicates(names) if once else rows).drop(*names)


def parts(batch: pa.RecordBatch, columns: list[str], size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in slices with about so many bytes in their text columns, or one row."""
    held = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy().astype(np.int64) + 1 for c in columns)
    which = np.cumsum(held) // size if batch.num_rows else held
    starts = np.flatnonzero(np.append(True, which[1:] != which[:-1])) if batch.num_rows else []
    for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def worker_state() -> dict:
    """A dictionary that lives as long as the Python worker. Task functions are
    shipped by value, so their module's own globals are new in each task."""
    name = "_netlat_worker_state"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
        sys.modules[name].state = {}
    return sys.modules[name].state


def free_worker() -> None:
    """Drops what other operators' tasks kept in this worker (tables of token pieces), for
    a task that needs the memory itself; they fill them again."""
    worker_state().clear()
    pa.default_memory_pool().release_unused()


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, as executors see it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def file_system(uri: str):
    """pyarrow's file system and path for a qualified path."""
    from pyarrow import fs

    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


