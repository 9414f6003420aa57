"""Lines that belong to the header above them."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netlat.functions.text import BACK, before_start, clock, clocked, once
from netlat.session import settle

FILE = ["run_id", "file"]


def carry_section(lines: DataFrame, header: Column | str | None = None, text: Column | None = None) -> DataFrame:
    """Give each line the last header at or above it in its file.

    `header` tells which lines are headers: a condition, a pattern, or by default
    any line with a clock. Adds `section` (the header's place) and `head` (its
    text, or `text` of it); lines above the first header are dropped.

    A file may be large, so the fill runs inside one split of a file at a time.
    What a split inherits from the splits before it comes from a table with one
    row per split.
    """
    if header is None:
        header = clock("value").isNotNull()
    elif isinstance(header, str):
        header = F.col("value").rlike(header)
    value = text if text is not None else F.col("value")
    marked = lines.withColumns({"_at": F.when(header, F.col("line_no")), "_text": F.when(header, value)})
    split = [*FILE, "block"]
    latest = marked.groupBy(*split).agg(F.max("_at").alias("_at"), F.max_by("_text", "_at").alias("_text"))
    head = F.when(F.col("_at").isNotNull(), F.struct("block", "_at", "_text"))
    before = Window.partitionBy(*FILE).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inherited = latest.select(*split, F.last(head, ignorenulls=True).over(before).alias("_inherited"))
    inside = Window.partitionBy(*split).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return (
        marked.withColumn("_here", F.last(head, ignorenulls=True).over(inside))
        .join(inherited, split, "left")
        .withColumn("_head", F.coalesce("_here", "_inherited"))
        .where(F.col("_head").isNotNull())
        .withColumn("section", F.struct("_head.block", F.col("_head._at").alias("line_no")))
        .withColumn("head", F.col("_head._text"))
        .drop("_head", "_here", "_inherited", "_at", "_text")
    )


def narrow_lines(lines: DataFrame, head: Column, values: dict[str, Column]) -> DataFrame:
    """What is read out of lines: their place, `_head` (text with a clock, null on lines
    that are no headers) and values; lines with none of them are left out."""
    read = once(lines, {"_head": head, **{f"_of_{n}": c for n, c in values.items()}})
    read = read.select(*FILE, "block", "line_no", "_head", *[F.col(f"_of_{n}").alias(n) for n in values])
    return read.where(" OR ".join(f"{c} IS NOT NULL" for c in ["_head", *values]))


def timed_sections(lines: DataFrame, header: Column, values: dict[str, Column]) -> DataFrame:
    """timed_rows of the lines of one log; `header` tells which are headers."""
    return timed_rows(narrow_lines(lines, F.when(header, F.col("value")), values), list(values))


def timed_logs(logs: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """timed_rows of several logs (of narrow_lines) in one pass for all of them."""
    every = None
    for name, read in logs.items():
        part = read.withColumns({"_log": F.lit(name), "file": F.concat(F.lit(f"{name}/"), F.col("file"))})
        every = part if every is None else every.unionByName(part, allowMissingColumns=True)
    values = [c for c in every.columns if c not in (*FILE, "block", "line_no", "_head", "_log")]
    rows = settle(timed_rows(every, [*values, "_log"]), "timed-logs")
    own = lambda read: [c for c in read.columns if c not in (*FILE, "block", "line_no", "_head")]
    return {n: rows.where(F.col("_log") == n).select(*FILE, "block", "line_no", "time", "section", *own(read)) for n, read in logs.items()}


def timed_rows(read: DataFrame, values: list[str]) -> DataFrame:
    """The values that stand in lines, with the `time` and `section` (the place) of the
    header at or above each: run_id, file, block, line_no, time, section and the values.

    A scan by segments in one reading of the text, of which `read` is what narrow_lines
    took out: inside each split of a file the last header is carried on and the clocks
    that fell by more than an hour, each a new day, are counted. That narrow table is
    written. One row a split then sums up what the splits after it inherit, and those
    rows are scanned by file and joined. Headers are rows too, with the values of
    their own line; lines above a file's first header are dropped.
    """
    split = [*FILE, "block"]
    clocks = clocked(read, F.col("_head")).drop("_head")
    inside = Window.partitionBy(*split).orderBy("line_no")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    before = F.last("_bare", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    falls = clocks.withColumn("_fell", (F.col("_bare") < before - BACK).cast("int"))
    falls = falls.withColumn("_falls", F.coalesce(F.sum("_fell").over(upto), F.lit(0)))
    bare = F.col("_bare").isNotNull()
    own = F.struct(F.col("line_no").alias("at"), F.col("_here").alias("time"), bare.alias("bare"), F.col("_falls").alias("falls"))
    head = F.last(F.when(F.col("_here").isNotNull(), own), ignorenulls=True).over(upto)
    folded = settle(falls.withColumn("_top", head).select(*split, "line_no", "_top", "_start", "_bare", "_fell", *values), "folded")

    ends = folded.groupBy(*split).agg(
        F.max_by("_top", "line_no").alias("_top"),
        F.first("_start").alias("_start"),
        F.min_by("_bare", F.when(bare, F.col("line_no"))).alias("_first"),
        F.max_by("_bare", F.when(bare, F.col("line_no"))).alias("_last"),
        F.coalesce(F.sum("_fell"), F.lit(0)).alias("_n"),
    )
    order = Window.partitionBy(*FILE).orderBy("block")
    earlier_rows = order.rowsBetween(Window.unboundedPreceding, -1)
    last = F.last("_last", ignorenulls=True).over(earlier_rows)
    cross = F.when(F.col("_first").isNull(), 0).when(last.isNull(), before_start("_first")).otherwise((F.col("_first") < last - BACK).cast("int"))
    ends = ends.withColumn("_cross", cross)
    ends = ends.withColumn("_days", F.sum(F.col("_cross") + F.col("_n")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
    ends = ends.withColumn("_end", F.when(F.col("_top").isNotNull(), F.struct("block", F.col("_top.at").alias("line_no"), _moved("_days").alias("time"))))
    inherited = F.last("_end", ignorenulls=True).over(earlier_rows)
    known = ends.select(*split, "_days", inherited.alias("_inherited"))

    rows = folded.join(known, split)
    mine = F.struct("block", F.col("_top.at").alias("line_no"))
    return rows.where("_top IS NOT NULL OR _inherited IS NOT NULL").select(
        *split,
        "line_no",
        F.when(F.col("_top").isNotNull(), _moved("_days")).otherwise(F.col("_inherited.time")).alias("time"),
        F.when(F.col("_top").isNotNull(), mine).otherwise(F.struct(F.col("_inherited.block").alias("block"), F.col("_inherited.line_no").alias("line_no"))).alias("section"),
        *values,
    )


def _moved(days: str) -> Column:
    """The time of a split's header, `days` later and a day more for each fall before it."""
    more = F.when(F.col("_top.bare"), F.col(days) + F.col("_top.falls")).otherwise(0)
    return F.col("_top.time") + F.make_dt_interval(more.cast("int"))


def skip_head(lines: DataFrame, n: int) -> DataFrame:
    """Leave out the first n lines of each file."""
    first = lines.where(F.col("block") == 0).groupBy(*FILE).agg(F.min("line_no").alias("_first"))
    return (
        lines.join(first.withColumn("block", F.lit(0).cast("bigint")), [*FILE, "block"], "left")
        .where(F.col("_first").isNull() | (F.col("line_no") >= F.col("_first") + n))
        .drop("_first")
    )


def line_class(lines: DataFrame, *substrings: str) -> DataFrame:
    """Lines that hold all of the texts."""
    for part in substrings:
        lines = lines.where(F.col("value").contains(part))
    return lines


def states(df: DataFrame, keep: list[str], col: str = "state") -> DataFrame:
    return df.where(F.col(col).isin(keep))


def drop_containing(df: DataFrame, col: str, text: str) -> DataFrame:
    """Rows whose column does not hold the text; null counts as not holding it."""
    return df.where(~F.coalesce(F.col(col).contains(text), F.lit(False)))
