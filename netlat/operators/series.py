"""Ordered work on long series.

A series (one run, one host) may hold a third of all rows, so no window here
runs over a whole series. Rows are numbered in two steps: a count per series
and time span, whose running sum gives the first number of each span, and a row
number inside the span. Windows with a bounded frame then run on chunks of the
numbered series; the few rows next to a chunk edge are copied to the neighbour
that needs them and dropped again after the window.
"""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CHUNK_ROWS = 50_000
# Rows of a series in one stored chunk.
STORED_ROWS = 512
# Column types whose values are bucketed as seconds.
_TIME_TYPES = {"timestamp", "timestamp_ntz", "date"}


def names(c) -> list[str]:
    return [c] if isinstance(c, str) else list(c)


def time_span(df: DataFrame, order: str, span: float) -> Column:
    """Number of the span a row falls in: seconds for times, units for numbers."""
    kind = dict(df.dtypes)[order]
    c = F.col(order)
    if kind in _TIME_TYPES:
        c = F.unix_micros(c.cast("timestamp")) / 1_000_000
    elif kind == "string":
        raise ValueError(f"order by a time or a number, not by the text {order}")
    # Nulls sort first, so their span comes first too.
    return F.coalesce(F.floor(c / span), F.lit(-(1 << 62)))


def with_position(
    df: DataFrame,
    by: str | Sequence[str],
    order: str | Sequence[str],
    name: str = "pos",
    span: float = 3600,
    bucket: Column | None = None,
    size: str | None = None,
) -> DataFrame:
    """Number the rows of each series from 0 in the given order.

    The first order column (or `bucket`, an expression that never decreases in
    that order) cuts a series into spans. Only one span of one series meets in
    a task, so choose `span` such that one holds at most some million rows.
    `size` names a column for the length of the series.
    """
    by, order = names(by), names(order)
    cut = df.withColumn("_span", bucket if bucket is not None else time_span(df, order[0], span))
    # One row per series and span: far smaller than the data, bounded by time.
    starts = cut.groupBy(*by, "_span").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*by)
    starts = starts.withColumn("_start", F.sum("_n").over(whole.orderBy("_span")) - F.col("_n"))
    if size:
        starts = starts.withColumn(size, F.sum("_n").over(whole))
    inside = F.row_number().over(Window.partitionBy(*by, "_span").orderBy(*order))
    return (
        cut.withColumn("_row", inside)
        .join(starts.drop("_n"), [*by, "_span"])
        .withColumn(name, F.col("_start") + F.col("_row") - 1)
        .drop("_span", "_row", "_start")
    )


def over_series(
    df: DataFrame,
    by: str | Sequence[str],
    order: str | Sequence[str],
    columns: dict[str, Callable[[WindowSpec], Column]] | list[dict[str, Callable[[WindowSpec], Column]]],
    back: int = 0,
    ahead: int = 0,
    pos: str | None = None,
    span: float = 3600,
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add window columns that look at most `back` rows back and `ahead` forward.

    Each entry of `columns` gets the chunk's window and returns an expression on
    it. A list of such dicts is worked off in turn on the same chunks, where later
    ones may use the columns of earlier ones; `back` and `ahead` then cover the
    whole reach. `pos` names an existing position column, else positions are made
    and dropped again.
    """
    if rows <= back + ahead:
        raise ValueError("a chunk must be longer than the frame")
    by = names(by)
    placed = df if pos else with_position(df, by, order, name="_pos", span=span)
    at = F.col(pos or "_pos")
    first = F.expr(f"greatest(0, ({pos or '_pos'} - {int(ahead)}) div {int(rows)})")
    last = F.expr(f"({pos or '_pos'} + {int(back)}) div {int(rows)}")
    chunks = placed.withColumn("_chunk", F.explode(F.sequence(first, last)))
    w = Window.partitionBy(*by, "_chunk").orderBy(at)
    out = chunks
    for stage in [columns] if isinstance(columns, dict) else columns:
        out = out.select("*", *[make(w).alias(name) for name, make in stage.items()])
    out = out.where(F.col("_chunk") == F.expr(f"{pos or '_pos'} div {int(rows)}")).drop("_chunk")
    return out if pos else out.drop("_pos")


def replace_columns(df: DataFrame, made: DataFrame, prefix: str, cols: Sequence[str]) -> DataFrame:
    """Put `prefix + c` in the place of every c."""
    return made.select(*[F.col(prefix + c).alias(c) if c in cols else F.col(c) for c in df.columns])


def rolling_mean(
    df, cols, run, order, back: int, ahead: int = 0, pos: str | None = None, span: float = 3600, rows: int = CHUNK_ROWS
) -> DataFrame:
    """Mean over the rows -back..ahead, over fewer at the ends of a series."""
    cols = names(cols)

    def mean(c):
        return lambda w: F.avg(c).over(w.rowsBetween(-back, ahead))

    made = over_series(df, run, order, {f"_m_{c}": mean(c) for c in cols}, back, ahead, pos, span, rows)
    return replace_columns(df, made, "_m_", cols)


def counter_delta(
    df, cols, run, order, suffix: str = "_per_sec", clip: bool = True, pos: str | None = None, span: float = 3600,
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Difference to the row before, 0 in the first row; falls count as 0 unless
    `clip` is off."""
    cols = names(cols)

    def delta(c):
        def make(w):
            d = F.coalesce(F.col(c) - F.lag(c, 1).over(w), F.lit(0))
            return F.greatest(d, F.lit(0)) if clip else d

        return make

    return over_series(df, run, order, {c + suffix: delta(c) for c in cols}, back=1, pos=pos, span=span, rows=rows)


def future_max(
    df, col: str, run, order, horizon: int = 10, name: str = "y_target", pos: str | None = None, span: float = 3600,
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Largest value of the next `horizon` rows, null unless all of them exist
    and hold a value."""

    def make(w):
        frame = w.rowsBetween(1, horizon)
        return F.when(F.count(col).over(frame) == horizon, F.max(col).over(frame))

    return over_series(df, run, order, {name: make}, ahead=horizon, pos=pos, span=span, rows=rows)


def sequences(
    df,
    cols,
    run,
    order,
    steps: int = 60,
    pad: bool = False,
    keep_last: bool = False,
    name: str = "features",
    pos: str | None = None,
    span: float = 3600,
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """The last `steps` rows of `cols` as one flat array, oldest step first.

    Without `pad` only full windows stay, and the last one of a series is left
    out unless `keep_last`. With `pad` every row stays and the first row of the
    series fills the front of short windows. `pos` names an existing position
    column, else one is added under that name. Call this late: a row grows to
    steps * cols doubles.
    """
    cols = names(cols)
    step = F.array(*[F.col(c).cast("double") for c in cols])
    placed = df if pos else with_position(df, run, order, span=span)
    pos = pos or "pos"
    made = over_series(
        placed,
        run,
        order,
        {
            "_steps": lambda w: F.collect_list(step).over(w.rowsBetween(1 - steps, 0)),
            "_more": lambda w: F.lead(F.lit(1), 1).over(w).isNotNull(),
        },
        back=steps - 1,
        ahead=1,
        pos=pos,
        rows=rows,
    )
    if pad:
        front = F.array_repeat(F.element_at("_steps", 1), (F.lit(steps) - F.size("_steps")).cast("int"))
        made = made.withColumn(name, F.flatten(F.concat(front, F.col("_steps"))))
    else:
        full = F.col(pos) >= steps - 1
        made = made.where(full if keep_last else full & F.col("_more"))
        made = made.withColumn(name, F.flatten("_steps"))
    return made.drop("_steps", "_more")


def sequence_chunks(
    df, cols, run, steps: int, keep, ends: Column, pos: str = "pos", rows: int = STORED_ROWS
) -> DataFrame:
    """Series cut into chunks, each with all windows of `steps` rows that end in it.

    One row a chunk: the series, `chunk`, `held` (`cols` of the chunk's rows in their
    order, after those of the steps - 1 rows before it) and `ends` (of each row for which
    the condition `ends` holds its place in `held` and the columns `keep`). A row is stored
    1 + (steps - 1) / rows times instead of the `steps` times of `sequences`. `pos` numbers
    the rows of a series from 0. Chunks without an end are left out.
    """
    run = names(run)
    step = F.array(*[F.col(c).cast("double") for c in names(cols)])
    kept = F.when(ends, F.struct(*keep))
    upto = F.sequence(F.expr(f"{pos} div {rows}"), F.expr(f"({pos} + {steps - 1}) div {rows}"))
    copies = df.select(*run, F.col(pos).alias("_pos"), step.alias("_step"), kept.alias("_kept"), F.explode(upto).alias("chunk"))
    own = F.when(F.expr(f"_pos div {rows}") == F.col("chunk"), F.col("_kept"))
    # A chunk has at most rows + steps - 1 rows.
    held = F.array_sort(F.collect_list(F.struct("_pos", "_step", own.alias("_kept"))))
    chunks = copies.groupBy(*run, "chunk").agg(held.alias("_rows"))
    placed = F.transform("_rows", lambda x, i: F.struct(i.alias("at"), x["_kept"].alias("kept")))
    return chunks.select(
        *run,
        "chunk",
        F.transform("_rows", lambda x: x["_step"]).alias("held"),
        F.filter(placed, lambda x: x["kept"].isNotNull()).alias("ends"),
    ).where(F.size("ends") > 0)


def chunk_windows(chunks: DataFrame, run, steps: int, name: str = "features") -> DataFrame:
    """The windows of sequence_chunks: the series, the columns that were kept, and the
    window as one flat array, oldest step first. They are made as chunks are read, so
    call this late."""
    run = names(run)
    window = lambda e: F.flatten(F.slice("held", e["at"] - (steps - 2), steps))
    made = F.transform("ends", lambda e: F.struct(e["kept"].alias("kept"), window(e).alias(name)))
    return chunks.select(*run, F.explode(made).alias("_w")).select(*run, "_w.kept.*", f"_w.{name}")


def interval_ends(phases: DataFrame, by, start: str, end: str = "end", last: Column | None = None) -> DataFrame:
    """End of each interval: the next start of the same series, else `last`.

    Interval tables hold a handful of rows per series, so this window is over
    the whole series.
    """
    following = F.lead(start).over(Window.partitionBy(*names(by)).orderBy(start))
    return phases.withColumn(end, following if last is None else F.coalesce(following, last))


def cumulative(weights: DataFrame, by, order, weight: str = "weight", name: str = "hi") -> DataFrame:
    """Running sum of the weights of a category table, in order."""
    w = Window.partitionBy(*names(by)).orderBy(*names(order)).rowsBetween(Window.unboundedPreceding, 0)
    return weights.withColumn(name, F.sum(weight).over(w))


def last_n(df: DataFrame, by, order, n: int = 30, rank: str = "ago") -> DataFrame:
    """The newest n rows of each series, `rank` 0 being the newest.

    Spark limits each series to n rows before the shuffle, so a long series
    costs no more than a short one.
    """
    newest = Window.partitionBy(*names(by)).orderBy(*[F.desc(o) for o in names(order)])
    return df.withColumn(rank, F.row_number().over(newest)).where(F.col(rank) <= n).withColumn(rank, F.col(rank) - 1)
