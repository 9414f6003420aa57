"""Connection-log summaries: counts, rankings, profiles, transfer sizes."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netlat.functions.numbers import bar, human_bytes, mb_bucket, number_or_zero
from netlat.operators.series import names


def top_counts(df: DataFrame, keys, n: int | None = None, by=None, name: str = "count") -> DataFrame:
    """Rows per key, most frequent first; equal counts in descending text order.

    With `n` only the first n, and with `by` the first n of each group. Counting
    is combined before the shuffle, so a hot key moves one row per task.
    """
    keys, by = names(keys), names(by or [])
    counts = df.groupBy(*by, *[k for k in keys if k not in by]).agg(F.count(F.lit(1)).alias(name))
    ranking = [F.desc(name), *[F.col(k).cast("string").desc() for k in keys]]
    if by:
        w = Window.partitionBy(*by).orderBy(*ranking)
        ranked = counts.withColumn("rank", F.row_number().over(w))
        return ranked.where(F.col("rank") <= n) if n else ranked
    ordered = counts.orderBy(*ranking)
    return ordered.limit(n) if n else ordered


def hour_profile(df: DataFrame, ts: str, tz: str = "UTC", per: int = 1000, by=None) -> DataFrame:
    """Rows per hour of the day in a time zone, with a text bar.

    `ts` is a timestamp, or seconds since 1970.
    """
    by = names(by or [])
    at = F.col(ts)
    if dict(df.dtypes)[ts] in ("double", "bigint", "int", "float"):
        at = F.timestamp_seconds(at)
    # The wall clock of the zone, whatever the session's own zone is.
    local = F.convert_timezone(None, F.lit(tz), at.cast("timestamp").cast("timestamp_ntz"))
    counts = df.groupBy(*by, F.hour(local).cast("bigint").alias("hour")).agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("bar", bar("count", per)).orderBy(*by, "hour")


def state_ranking(df: DataFrame, col: str = "conn_state", normal: str = "SF", by=None) -> DataFrame:
    """Rows per state, states whose name holds the normal close left out."""
    kept = df.where(~F.coalesce(F.col(col).contains(normal), F.lit(False)))
    return top_counts(kept, col, by=by)


def top_transfers(
    df: DataFrame, n: int = 10, host: str = "id_resp_h", sent: str = "orig_bytes", received: str = "resp_bytes",
    ts: str = "ts", by=None,
) -> DataFrame:
    """Largest transfers by total bytes, with readable sizes; unset bytes are 0."""
    by = names(by or [])
    orig, resp = number_or_zero(sent, "bigint"), number_or_zero(received, "bigint")
    rows = df.select(
        *by,
        (orig + resp).alias("total_bytes"),
        F.col(host).alias("host"),
        orig.alias("_orig"),
        resp.alias("_resp"),
        F.col(ts).alias("ts"),
    )
    # Equal totals follow the descending text of the line.
    ranking = [F.desc("total_bytes"), F.col("host").cast("string").desc(), F.desc("_orig"), F.desc("ts")]
    if by:
        w = Window.partitionBy(*by).orderBy(*ranking)
        top = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    else:
        top = rows.orderBy(*ranking).limit(n)
    shown = [*by, "rank"] if by else []
    return top.select(
        *shown,
        "total_bytes",
        human_bytes("total_bytes").alias("total_size"),
        "host",
        human_bytes("_orig").alias("client_tx"),
        human_bytes("_resp").alias("server_tx"),
        "ts",
    )


def size_histogram(df: DataFrame, col: str, n: int | None = 10, by=None) -> DataFrame:
    """Rows per size in whole MB, most frequent first."""
    by = names(by or [])
    sized = df.select(*by, mb_bucket(number_or_zero(col)).alias("size"))
    return top_counts(sized, "size", n, by=by)


def mean_unset_zero(df: DataFrame, col: str, by=None, name: str = "mean") -> DataFrame:
    """Mean where an unset value counts as 0 in the sum and as one in the count."""
    return df.groupBy(*names(by or [])).agg(F.avg(number_or_zero(col)).alias(name))
