"""Training sets: scaling, series length, split by position."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netlat.session import settle
from netlat.operators.series import names, with_position
from netlat.operators.spread import spread_join


def fit_minmax(df: DataFrame, cols) -> DataFrame:
    """One row with the smallest and largest value of each column."""
    cols = names(cols)
    return df.agg(
        *[F.min(c).cast("double").alias(f"min_{c}") for c in cols],
        *[F.max(c).cast("double").alias(f"max_{c}") for c in cols],
    )


def _attach(df: DataFrame, mm: DataFrame) -> DataFrame:
    """The one scaler row as a scalar subquery, next to each row."""
    return df.withColumn("_mm", mm.select(F.struct(*mm.columns)).scalar())


def _width(col: str) -> Column:
    width = F.col(f"_mm.max_{col}") - F.col(f"_mm.min_{col}")
    return F.when(width == 0, F.lit(1.0)).otherwise(width)


def scale(df: DataFrame, mm: DataFrame, cols) -> DataFrame:
    """Columns mapped to 0..1; a constant column becomes 0."""
    cols = names(cols)
    at = _attach(df, mm)
    return at.select(
        *[((F.col(c) - F.col(f"_mm.min_{c}")) / _width(c)).alias(c) if c in cols else F.col(c) for c in df.columns]
    )


def unscale(df: DataFrame, mm: DataFrame, cols, like: str) -> DataFrame:
    """Inverse of scale for columns that are on the scale of column `like`."""
    cols = names(cols)
    at = _attach(df, mm)
    back = lambda c: F.col(c) * _width(like) + F.col(f"_mm.min_{like}")
    return at.select(*[back(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def scale_steps(df: DataFrame, mm: DataFrame, cols, features: str = "features", also: str | None = None) -> DataFrame:
    """Scale a flat step-by-step array in place, each value by the column its
    index falls on, and one more column besides."""
    cols = names(cols)
    n = len(cols)
    low, width = (lambda c: F.col(f"_mm.min_{c}")), _width
    # The arrays are made in the scaler's own row, once, not anew for each value of a window.
    row = mm.select(F.struct(*mm.columns).alias("_mm"))
    ends = {"low": F.array(*[low(c) for c in cols]), "width": F.array(*[width(c) for c in cols])}
    ends |= {"low_also": low(also), "width_also": width(also)} if also else {}
    at = df.withColumn("_ends", row.select(F.struct(*[c.alias(k) for k, c in ends.items()])).scalar())
    made = {features: F.transform(features, lambda x, i: (x - F.get("_ends.low", i % n)) / F.get("_ends.width", i % n))}
    if also:
        made[also] = (F.col(also) - F.col("_ends.low_also")) / F.col("_ends.width_also")
    return at.select(*[made[c].alias(c) if c in made else F.col(c) for c in df.columns])


def fit_steps(df: DataFrame, cols, features: str = "features", also: str | None = None) -> DataFrame:
    """fit_minmax over the values held in flat step-by-step arrays."""
    cols = names(cols)
    n = len(cols)
    column = lambda j: F.filter(features, lambda x, i: i % n == j)
    ends = df.select(
        *[F.array_min(column(j)).alias(f"lo_{c}") for j, c in enumerate(cols)],
        *[F.array_max(column(j)).alias(f"hi_{c}") for j, c in enumerate(cols)],
        *([F.col(also).alias(f"lo_{also}"), F.col(also).alias(f"hi_{also}")] if also else []),
    )
    every = [*cols, also] if also else cols
    return ends.agg(
        *[F.min(f"lo_{c}").alias(f"min_{c}") for c in every], *[F.max(f"hi_{c}").alias(f"max_{c}") for c in every]
    )


def long_enough(df: DataFrame, run, min_rows: int = 61) -> DataFrame:
    """Series of at least `min_rows` rows.

    Lengths are one row per series; a hot series is joined with its length in pieces.
    """
    run = names(run)
    sizes = df.groupBy(*run).agg(F.count(F.lit(1)).alias("_n"))
    long = sizes.where(F.col("_n") >= min_rows).drop("_n")
    return spread_join(df, long, run, F.struct(*df.columns), "left_semi", sizes)


def position_split(
    df: DataFrame,
    run: str,
    order,
    train: float = 0.8,
    folds: int = 3,
    gap: int = 0,
    span: float = 3600,
    in_run: str | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """First `train` share of all rows by series name and order is `train`, the
    rest `test`; training rows also get one of `folds` contiguous blocks.

    `gap` rows before the test rows are labelled `gap`, so that windows of the
    two sides need not overlap. Adds `pos`, `split` and `fold`.

    Positions over all series come from counts per series, in ranges of their names.
    Only the table of ranges, one row for each, meets in one task. `in_run` names
    an existing position in the series, counted from 0. `counted` is a cheaper
    table with as many rows per series, if there is one.
    """
    order = names(order)
    if in_run:
        placed = df.withColumn("_in_run", F.col(in_run))
    else:
        placed = with_position(df, run, order, name="_in_run", span=span)
    counts = (df if counted is None else counted).groupBy(run).agg(F.count(F.lit(1)).alias("_n"))
    # One row per series, in ranges of names; written, so that the ranges stay as they are.
    runs = settle(counts.repartitionByRange(run).withColumn("_range", F.spark_partition_id()), "series")
    ranges = runs.groupBy("_range").agg(F.sum("_n").alias("_rn")).withColumn("_all", F.lit(0))
    over = Window.partitionBy("_all")
    before = (F.sum("_rn").over(over.orderBy("_range")) - F.col("_rn")).alias("_before")
    ranges = ranges.select("_range", before, F.sum("_rn").over(over).alias("_total"))
    in_range = F.sum("_n").over(Window.partitionBy("_range").orderBy(run)) - F.col("_n")
    starts = runs.withColumn("_in_range", in_range).join(ranges, "_range")
    starts = starts.select(run, (F.col("_before") + F.col("_in_range")).alias("_start"), "_total")
    at = placed.join(starts, run)
    at = at.withColumn("pos", F.col("_start") + F.col("_in_run"))
    at = at.withColumn("_cut", F.floor(F.col("_total") * F.lit(train)) - gap)
    split = (
        F.when(F.col("pos") < F.col("_cut"), "train").when(F.col("pos") < F.col("_cut") + gap, "gap").otherwise("test")
    )
    # The first (cut mod folds) blocks are one row longer.
    fold = F.expr(
        f"CASE WHEN pos < (_cut % {folds}) * (_cut div {folds} + 1) THEN pos div (_cut div {folds} + 1) "
        f"ELSE _cut % {folds} + (pos - (_cut % {folds}) * (_cut div {folds} + 1)) div greatest(_cut div {folds}, 1) END"
    )
    at = at.withColumn("split", split).withColumn("fold", F.when(F.col("pos") < F.col("_cut"), fold.cast("int")))
    return at.select(*df.columns, "pos", "split", "fold") if "pos" not in df.columns else at.select(
        *[c for c in df.columns if c != "pos"], "pos", "split", "fold"
    )
