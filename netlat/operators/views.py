"""Recent-history views over a table of samples or predictions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlat.operators.series import last_n, names


def latest_row(df: DataFrame, by, order: str) -> DataFrame:
    """Newest row of each series, by an aggregate that combines before the shuffle."""
    by = names(by)
    rest = [c for c in df.columns if c not in by]
    newest = df.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return newest.select(*[F.col(c) if c in by else F.col(f"_r.{c}").alias(c) for c in df.columns])


def latest(df: DataFrame, by, order, n: int = 5) -> DataFrame:
    """Newest n rows of each series, newest first."""
    return last_n(df, by, order, n).orderBy(*names(by), "ago")


def _long(df: DataFrame, cols, by, order, n) -> DataFrame:
    recent = last_n(df, by, order, n).select(*names(by), "ago", *[F.col(c).cast("double").alias(c) for c in names(cols)])
    return recent.unpivot([*names(by), "ago"], names(cols), "metric", "value")


def recent_values(df: DataFrame, cols, by, order, n: int = 4) -> DataFrame:
    """One row per series and metric: its value now and 1 .. n-1 samples ago."""
    rows = _long(df, cols, by, order, n)
    ago = [F.max(F.when(F.col("ago") == i, F.col("value"))).alias(f"ago_{i}") for i in range(n)]
    return rows.groupBy(*names(by), "metric").agg(*ago)


def history_pivot(df: DataFrame, cols, by, order, n: int = 30, fill: float | None = None) -> DataFrame:
    """One row per series and metric with the last n values, oldest first; short
    histories have nulls at the front, or `fill`."""
    rows = _long(df, cols, by, order, n)
    ago = [F.max(F.when(F.col("ago") == i, F.col("value"))).alias(f"ago_{i}") for i in range(n - 1, -1, -1)]
    out = rows.groupBy(*names(by), "metric").agg(*ago)
    return out if fill is None else out.fillna(fill)


def chart_history(df: DataFrame, by, order: str, back: int = 991) -> DataFrame:
    """The newest `back` samples of each series for the chart, with their age."""
    return last_n(df, by, order, back)


def chart_points(df: DataFrame, by, order: str, actual: str, forecast: str, back: int = 991, horizon: int = 10) -> DataFrame:
    """The chart of each series: its newest `back` samples with the value measured and the
    one forecast for it `horizon` samples before, and `horizon` points to come, with a
    forecast only. `ago` counts samples back from the newest; points to come are below 0."""
    by = names(by)
    rows = last_n(df.select(*by, order, actual, forecast), by, order, back + horizon)
    none = F.lit(None).cast("double")
    now = rows.where(F.col("ago") < back).select(*by, "ago", F.col(actual).cast("double").alias("actual"), none.alias("forecast"))
    due = rows.select(*by, F.col("ago") - horizon, none, F.col(forecast).cast("double"))
    return now.unionAll(due).groupBy(*by, "ago").agg(F.max("actual").alias("actual"), F.max("forecast").alias("forecast"))


def alerts(predictions: DataFrame, threshold: float | DataFrame = 800.0) -> DataFrame:
    """Predictions above the threshold, a number or a one-row table."""
    limit = threshold.scalar() if isinstance(threshold, DataFrame) else F.lit(float(threshold))
    return predictions.where(F.col("prediction") > limit)


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as a JSON text, nulls kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(name))
