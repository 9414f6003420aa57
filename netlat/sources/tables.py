"""Table sources and sinks: feature tables, memory samples, training sets."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlat.functions.text import has_clock, stamped
from netlat.schemas import FEATURES, LABEL

# Fixed value: the header of the memory log.
MEM_COLUMNS = ["total_MB", "used_MB", "free_MB", "shared_MB", "buff_cache_MB", "available_MB"]


def _read_named(spark: SparkSession, path: str, columns: dict[str, str], other: dict[str, str]) -> DataFrame:
    """CSV files read by the names in their headers, whatever the order; each file by
    its own. `columns` maps names to types, `other` further spellings to names. Adds
    `_file`, `block` and `line_no`. A column that a file lacks is an error when the
    file is read."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_no"),
        F.col("value"),
    )
    first = F.min_by(F.struct("line_no", "value"), F.struct("block", "line_no"))
    heads = lines.where("block = 0").groupBy("_file").agg(first.alias("_head"))
    cells = lambda c: F.transform(F.split(c, ","), lambda x: F.btrim(x, F.lit(' "\r')))
    rows = lines.join(heads, "_file").where((F.col("block") > 0) | (F.col("line_no") > F.col("_head.line_no")))
    rows = rows.where("trim(value) != ''").withColumns({"_names": cells(F.col("_head.value")), "_cells": cells(F.col("value"))})

    def named(name, kind):
        spellings = [name, *[s for s, n in other.items() if n == name]]
        place = F.coalesce(*[F.nullif(F.array_position("_names", s), F.lit(0)) for s in spellings])
        absent = F.raise_error(F.concat(F.lit(f"no column {name} in "), F.col("_file"))).cast("int")
        return F.try_element_at("_cells", F.coalesce(place.cast("int"), absent)).try_cast(kind).alias(name)

    return rows.select("_file", "block", "line_no", *[named(n, k) for n, k in columns.items()])


def read_feature_csv(spark: SparkSession, path: str) -> DataFrame:
    """Feature tables as CSV files; the file name becomes `run_id`.

    `time` stays text; (`block`, `line_no`) is the order of the rows in their
    file. Columns are found by their names, in any order, and both spellings of the
    queue columns are read: Recv-Q_Bytes_max and Recv_Q_Bytes_max. Values hold no commas.
    """
    other = {c.replace("_Q_", "-Q_"): c for c in FEATURES if "_Q_" in c}
    kinds = {"time": "string", **dict.fromkeys([*FEATURES, LABEL], "double")}
    name = F.regexp_extract("_file", r"([^/]+?)(?:\.csv)?$", 1)
    return _read_named(spark, path, kinds, other).select(name.alias("run_id"), "block", "line_no", *kinds)


def parse_mem_usage(spark: SparkSession, path: str) -> DataFrame:
    """Used and available memory per second; rows without a clock are dropped."""
    kinds = {"timestamp": "string", **dict.fromkeys(MEM_COLUMNS, "bigint")}
    rows = _read_named(spark, path, kinds, {})
    return mem_usage(rows.select(F.try_element_at(F.split("_file", "/"), F.lit(-2)).alias("run_id"), *kinds))


def mem_usage(rows: DataFrame) -> DataFrame:
    """Last memory sample of each second."""
    last = F.max_by(F.struct("used_MB", "available_MB"), "timestamp")
    return (
        stamped(rows.where(has_clock("timestamp")), F.col("timestamp"))
        .groupBy("run_id", "time")
        .agg(last.alias("_m"))
        .select("run_id", "time", "_m.used_MB", "_m.available_MB")
    )


def _replacing(df: DataFrame, *by: str):
    """A writer that replaces the partitions it has rows for and leaves the others."""
    return df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by)


def write_features(df: DataFrame, path: str, format: str = "parquet") -> None:
    """One partition per run; runs that are written again are replaced, others stay.
    Rows of a run are not gathered in one task: rows are spread by run and hour, so a run
    has at most one file for each of its hours."""
    placed = df.repartition("run_id", F.date_trunc("hour", F.col("time").cast("timestamp")))
    writer = _replacing(placed.sortWithinPartitions("run_id", "time"), "run_id")
    writer.option("header", True).format(format).save(path)


#: Points of an augmented series in one file.
FILE_POINTS = 1_000_000


def write_augmented(df: DataFrame, path: str, points: int = FILE_POINTS) -> None:
    """One partition per source series and variation, those written again replaced; each
    with a file for every so many points."""
    placed = df.repartition("run_id", "variation", F.floor(F.col("k") / points))
    _replacing(placed.sortWithinPartitions("run_id", "variation", "k"), "run_id", "variation").parquet(path)


def write_dataset(df: DataFrame, scaler: DataFrame, path: str) -> None:
    """Sequences split into train and test, and the one-row scaler."""
    df.write.mode("overwrite").partitionBy("split").parquet(f"{path}/sequences")
    scaler.coalesce(1).write.mode("overwrite").parquet(f"{path}/scaler")


def read_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/sequences"), spark.read.parquet(f"{path}/scaler")


def write_chunks(chunks: DataFrame, scaler: DataFrame, path: str) -> None:
    """A training set as chunks of rows, which a reader makes its windows of, and the
    one-row scaler."""
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    scaler.coalesce(1).write.mode("overwrite").parquet(f"{path}/scaler")


def read_chunks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/scaler")


def write_report(sections: dict[str, DataFrame], path: str) -> None:
    """One table per report section. Those by day are partitioned by it, and the days of
    this report replace theirs: a report grows by its new days, without a look at the
    old ones."""
    for name, df in sections.items():
        if "day" in df.columns:
            _replacing(df, "day").parquet(f"{path}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{path}/{name}")
