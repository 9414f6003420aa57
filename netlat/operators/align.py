"""Joins that bring series of different shape onto one time line."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlat.operators.series import interval_ends, names, with_position


def conform(df: DataFrame, columns: list[str], fill=0) -> DataFrame:
    """Exactly these columns in this order; absent ones are added, nulls filled."""
    made = df.select(*[F.col(c) if c in df.columns else F.lit(fill).alias(c) for c in columns])
    return made.fillna(fill, columns)


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """These columns in this order; an absent one is an error."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {', '.join(absent)}")
    return df.select(*columns)


def align(series: dict[str, DataFrame], keys, fill: float | None = 0) -> DataFrame:
    """Full outer equi-join of any number of series, missing values filled.

    The series are stacked and folded by one aggregation, so the number of
    shuffles does not grow with the number of series. Each series has one row per
    key; of repeated keys the largest value stays.
    """
    keys = names(keys)
    values = {}
    for name, df in series.items():
        for c in df.columns:
            if c not in keys:
                values[c] = dict(df.dtypes)[c]
    stacked = None
    for df in series.values():
        have = set(df.columns)
        part = df.select(
            *keys, *[F.col(c) if c in have else F.lit(None).cast(kind).alias(c) for c, kind in values.items()]
        )
        stacked = part if stacked is None else stacked.unionAll(part)
    out = stacked.groupBy(*keys).agg(*[F.max(c).alias(c) for c in values])
    return out if fill is None else out.fillna(fill, list(values))


def zip_positional(
    base: DataFrame, series: DataFrame, run="run_id", order="time", series_order=None, pos: str | None = None,
    span: float = 3600,
) -> DataFrame:
    """n-th sample of the series to the n-th row of the base, within each run.

    Samples beyond the base are cut, rows beyond the samples get 0. Samples from
    a split file are ordered by (block, line_no). `pos` names an existing position
    column of the base, which stays.
    """
    run = names(run)
    left = base.withColumn("_nth", F.col(pos)) if pos else with_position(base, run, order, name="_nth", span=span)
    if series_order is None:
        right = with_position(series, run, ["block", "line_no"], name="_nth", bucket=F.col("block"))
        right = right.drop("block", "line_no")
    else:
        used = [c for c in names(series_order) if c not in run]
        right = with_position(series, run, series_order, name="_nth", span=span).drop(*used)
    added = [c for c in right.columns if c not in [*run, "_nth"]]
    return left.join(right, [*run, "_nth"], "left").fillna(0, added).drop("_nth")


def label_phases(
    df: DataFrame, phases: DataFrame, run="run_id", time: str = "time", name: str = "Label", span: int = 3600
) -> DataFrame:
    """Label of the phase a row falls in: [start, next start), the last phase
    until 23:59:59 of its day, outside 0.

    Phases are cut into pieces of `span` seconds, which makes the range join an
    equi-join on run and piece: a run with very many rows spreads over tasks, and
    neither side has to fit in one.
    """
    run = names(run)
    stop = F.date_trunc("day", F.col("start")) + F.expr("INTERVAL '23:59:59' HOUR TO SECOND")
    closed = interval_ends(phases.select(*run, "start", "label"), run, "start", "_end", stop)

    def piece(c):
        return F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (span * 1_000_000))

    pieces = closed.where(F.col("_end") > F.col("start")).withColumn(
        "_piece", F.explode(F.sequence(piece("start"), piece("_end")))
    )
    left = df.withColumn("_piece", piece(time)).alias("l")
    right = pieces.alias("r")
    same = F.col("l._piece") == F.col("r._piece")
    for c in run:
        same = same & (F.col(f"l.{c}") == F.col(f"r.{c}"))
    inside = (F.col(f"l.{time}") >= F.col("r.start")) & (F.col(f"l.{time}") < F.col("r._end"))
    kept = [F.col(f"l.{c}") for c in df.columns if c != name]
    return left.join(right, same & inside, "left").select(
        *kept, F.coalesce(F.col("r.label"), F.lit(0)).cast("int").alias(name)
    )


def align_forecast(
    predictions: DataFrame,
    actuals: DataFrame,
    horizon: str = "10 seconds",
    by="host",
    prediction: str = "prediction",
    actual: str = "actual",
    unit: str | None = None,
) -> DataFrame:
    """Each prediction at the time it is for, next to the value measured then.

    With `unit` ("second") both times are cut to it and the last value of each is
    used, since clocks that drift never meet to the microsecond.
    """
    by = names(by)
    due = F.col("time") + F.expr(f"INTERVAL {horizon}")
    if unit is None:
        made = predictions.select(*by, F.col("time").alias("made_at"), due.alias("time"), prediction)
        return made.join(actuals.select(*by, "time", actual), [*by, "time"])
    last = lambda df, at, value: (
        df.groupBy(*by, F.date_trunc(unit, at).alias("time")).agg(F.max_by(F.struct("time", value), "time").alias("_last"))
    )
    made = last(predictions, due, prediction).select(*by, F.col("_last.time").alias("made_at"), "time", f"_last.{prediction}")
    seen = last(actuals, F.col("time"), actual).select(*by, "time", f"_last.{actual}")
    return made.join(seen, [*by, "time"])


def last_per_key(df: DataFrame, keys, order) -> DataFrame:
    """Last row of each key."""
    keys = names(keys)
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*names(order)) if len(names(order)) > 1 else F.col(names(order)[0]))
    return df.groupBy(*keys).agg(last.alias("_last")).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def merge_counters(events: DataFrame, host="host", name: str = "name", seq: str = "seq", value: str = "value",
                   counters: list[str] | None = None) -> DataFrame:
    """Latest value of each named counter, one row per host. A counter that is not in
    a given list is an error."""
    host = names(host)
    if counters is not None:
        unknown = F.raise_error(F.concat(F.lit("unknown counter: "), F.coalesce(name, F.lit("null")))).cast("string")
        events = events.withColumn(name, F.when(F.col(name).isin(counters), F.col(name)).otherwise(unknown))
    latest = events.groupBy(*host, name).agg(F.max_by(value, seq).alias("_v"))
    return latest.groupBy(*host).pivot(name, counters).agg(F.first("_v")).fillna(0)
