"""Text sources: raw run logs and tab-separated connection logs."""

import logging
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlat.functions.text import strip_ansi

log = logging.getLogger(__name__)

LINES_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("block", T.LongType()),
        T.StructField("line_no", T.LongType()),
        T.StructField("value", T.StringType()),
    ]
)


def _missing(error: AnalysisException) -> bool:
    return (error.getCondition() or "").startswith("PATH_NOT_FOUND")


def require(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a path that must exist."""
    try:
        return spark.read.text(path)
    except AnalysisException as error:
        if _missing(error):
            raise FileNotFoundError(f"required input is missing: {path}") from error
        raise


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or pattern names any file."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p))


def optional(spark: SparkSession, path: str, schema: T.StructType, read=None) -> DataFrame:
    """What `read` makes of a path, or an empty table of the schema if the path
    is missing."""
    try:
        return (read or (lambda p: spark.read.schema(schema).parquet(p)))(path)
    except FileNotFoundError:
        pass
    except AnalysisException as error:
        if not _missing(error):
            raise
    log.warning("%s is missing, its part is skipped", path)
    return spark.createDataFrame([], schema)


def read_lines(spark: SparkSession, path: str, clean: bool = True) -> DataFrame:
    """Lines of many run directories in file order.

    `run_id` is the name of the directory. Files are split, so a line's place is
    (`block`, `line_no`): the byte offset of its split, then an id that grows
    inside the split.
    """
    parts = F.split("_metadata.file_path", "/")
    lines = require(spark, path).select(
        F.try_element_at(parts, F.lit(-2)).alias("run_id"),
        F.try_element_at(parts, F.lit(-1)).alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_no"),
        F.col("value"),
    )
    return lines.withColumn("value", strip_ansi("value")) if clean else lines


def read_optional_lines(spark: SparkSession, path: str, clean: bool = True) -> DataFrame:
    return optional(spark, path, LINES_SCHEMA, lambda p: read_lines(spark, p, clean))


def read_zeek(spark: SparkSession, path: str, fields: Sequence[str], schema: T.StructType) -> DataFrame:
    """Named fields of tab-separated connection logs, one `day` per directory.

    Each file follows its own `#fields` line, or without one the declared schema,
    whatever the other files are like. `-` and unreadable values are null.
    """
    parts = F.split("_metadata.file_path", "/")
    raw = require(spark, path).select(
        F.try_element_at(parts, F.lit(-2)).alias("day"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("value"),
    )
    heads = raw.where(F.col("value").startswith("#fields")).groupBy("_file").agg(F.first("value").alias("_head"))
    rows = raw.where(~F.col("value").startswith("#") & (F.col("value") != ""))
    # The first word of a header is no field, so its places are those of the cells.
    own = F.expr("slice(split(_head, '\t'), 2, size(split(_head, '\t')))")
    layout = F.coalesce(own, F.array(*[F.lit(n) for n in schema.fieldNames()]))
    rows = rows.join(heads, "_file", "left").withColumns({"_fields": layout, "_cells": F.split("value", "\t")})

    def cell(name):
        place = F.nullif(F.array_position("_fields", name), F.lit(0)).cast("int")
        text = F.try_element_at("_cells", place)
        return F.nullif(text, F.lit("-")).try_cast(schema[name].dataType).alias(name.replace(".", "_"))

    return rows.select("day", *[cell(n) for n in fields])
