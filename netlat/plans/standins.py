"""The given tables in the roles of connection logs, run logs and snapshots.

Every table made here holds all rows of its source. An event type stands for a
run, a user for a host, an hour for a second.
"""

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlat.schemas import COUNTERS

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its zone-free times are read as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes])


def events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("hour", F.date_trunc("hour", "ts"))


def hourly(spark, sf_dir) -> DataFrame:
    """Rows per type and hour: count, sum, mean and largest value."""
    return (
        events(spark, sf_dir)
        .groupBy(F.col("event_type").alias("run_id"), F.col("hour").alias("time"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("value").alias("total"),
            F.avg("value").alias("mean"),
            F.max("value").alias("peak"),
        )
    )


def hourly_by_type(spark, sf_dir) -> DataFrame:
    """One row per hour with a count per event type; ten days make a run."""
    other = F.raise_error(F.concat(F.lit("unknown event type: "), F.coalesce("event_type", F.lit("null")))).cast("string")
    kind = F.when(F.col("event_type").isin(EVENT_TYPES), F.col("event_type")).otherwise(other)
    per_type = [F.count_if(kind == t).alias(t) for t in EVENT_TYPES]
    run = F.concat(F.lit("block"), F.floor(F.dayofyear("time") / 10).cast("string")).alias("run_id")
    hours = events(spark, sf_dir).groupBy(F.col("hour").alias("time")).agg(*per_type)
    return hours.select(run, "time", *EVENT_TYPES)


def profile(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).groupBy(
        F.date_format("ts", "yyyy-MM-dd").alias("day"), F.hour("ts").cast("bigint").alias("hour")
    ).agg(F.count(F.lit(1)).alias("traffic"))


def as_snapshots(df: DataFrame, *more: str) -> DataFrame:
    """Events as counter snapshots of one host per user. The counters grow with
    the event id; the retransmits start again now and then."""
    grows = {c: F.col("event_id") * (i + 1) for i, c in enumerate(COUNTERS)}
    grows["ebpf_retrans_count"] = F.col("event_id") % 5000
    return df.select(
        F.col("user_id").cast("string").alias("host"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("value").alias("tcp_rtt_sum"),
        F.lit(16000.0).alias("mem_total_mb"),
        (F.col("value") + 8000).alias("mem_avail_mb"),
        (F.col("value") / 10).alias("sched_run_queue"),
        (F.col("event_id") % 3).alias("tcp_rtt_count"),
        (F.col("event_id") % 100).alias("tcp_recv_q_max"),
        (F.col("event_id") % 50).alias("tcp_send_q_max"),
        (F.col("event_id") % 10).alias("tcp_cwnd_min"),
        (F.col("event_id") % 7).alias("tcp_ssthresh_min"),
        *[e.alias(c) for c, e in grows.items()],
        *more,
    )


def order_files(spark: SparkSession, folder: str, seconds: Callable[[str], int]) -> None:
    """Set the times of a partitioned table's files by the names of their folders, so that
    a stream reads them in that order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    start = int(time.time()) * 1000
    for part in fs.listStatus(path):
        if "=" in part.getPath().getName():
            for file in fs.listStatus(part.getPath()):
                fs.setTimes(file.getPath(), start + 1000 * seconds(part.getPath().getName()), -1)


def log_lines(df: DataFrame, file: str, values: list, header: str) -> DataFrame:
    """A text log per event type: a header for each hour, then the lines made of
    its events. Half an hour makes a block, so headers carry over blocks.

    `values` are (text, condition) pairs, `header` a date pattern.
    """
    at = F.unix_micros("ts")
    width = len(values) + 1
    run, block = F.col("event_type").alias("run_id"), F.floor(at / 1_800_000_000).alias("block")
    lines = None
    for i, (text, keep) in enumerate(values):
        part = df.where(keep).select(
            run, F.lit(file).alias("file"), block, (at * width + i + 1).alias("line_no"), text.alias("value")
        )
        lines = part if lines is None else lines.unionAll(part)
    start = F.unix_micros("hour")
    heads = df.select("event_type", "hour").distinct().select(
        run,
        F.lit(file).alias("file"),
        F.floor(start / 1_800_000_000).alias("block"),
        (start * width).alias("line_no"),
        F.date_format("hour", header).alias("value"),
    )
    return heads.unionAll(lines)


def connection_files(rows: DataFrame, folder: str) -> None:
    """Rows (day, values) as tab-separated logs with a header, `folder/<day>/conn.log`."""
    spark, columns = rows.sparkSession, [c for c in rows.columns if c != "day"]
    head = F.concat_ws("\t", F.lit("#fields"), *[F.lit(c) for c in columns])
    lines = rows.select("day", F.lit(1).alias("at"), F.concat_ws("\t", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("-")) for c in columns]).alias("value"))
    lines = rows.select("day").distinct().select("day", F.lit(0).alias("at"), head.alias("value")).unionAll(lines)
    placed = lines.repartition("day").sortWithinPartitions("day", "at").select("day", "value")
    placed.write.partitionBy("day").text(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    at = lambda name: spark._jvm.org.apache.hadoop.fs.Path(name)
    for part in fs.listStatus(path):
        name = part.getPath().getName()
        if name.startswith("day="):
            day = f"{folder}/{name.removeprefix('day=')}"
            fs.mkdirs(at(day))
            for file in fs.listStatus(part.getPath()):
                fs.rename(file.getPath(), at(f"{day}/conn.log"))
