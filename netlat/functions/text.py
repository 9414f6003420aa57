"""Column expressions that take values out of log lines."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Patterns of the raw log formats.
ANSI_ESCAPE = r"\x1B(?:[@-Z\\-_]|\[[0-?]*[ -/]*[@-~])"
CLOCK = r"(\d{2}:\d{2}:\d{2})"
DAY = r"(\d{4}-\d{2}-\d{2})"
FRACTION_HEADER = r"={5,}\s+\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d+\s+={5,}"
RUN_STAMP = r"(\d{8}_\d{6})"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns that are worked out once a row, whatever uses them: Spark copies
    no expression through a generator, neither into later columns nor into filters."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def found(c, pattern: str, group: int = 1) -> Column:
    """First match of a pattern, null when there is none."""
    return F.nullif(F.regexp_extract(_col(c), pattern, group), F.lit(""))


def strip_ansi(c) -> Column:
    """Drop terminal escape sequences, then surrounding white space."""
    # Few lines hold an escape, and looking for one is much cheaper than a pattern.
    plain = F.when(_col(c).contains("\x1b"), F.regexp_replace(_col(c), ANSI_ESCAPE, "")).otherwise(_col(c))
    return F.btrim(plain, F.lit(" \t\r\n\x0b\x0c"))


def clock(c) -> Column:
    """First HH:MM:SS in the text."""
    return found(c, CLOCK)


def stamped(df: DataFrame, text: Column, name: str = "time") -> DataFrame:
    """Add the timestamp of a line: its own date if it has one, else the run's.

    The run id carries the start of the run. A bare clock is on the day of the start,
    or on the next if it is earlier than an hour before the start. Where df has the
    place of a line (file, block, line_no), a day is added each time the bare clocks
    of a file fall by more than an hour, so a run may be of any length. The steps are
    columns of their own, since Spark would copy them into every place that uses them.
    """
    here = clocked(df, text)
    if {"file", "block", "line_no"} <= set(df.columns):
        here = _days(here)
    else:
        here = here.withColumn("_days", before_start("_bare"))
    moved = F.col("_here") + F.make_dt_interval(F.coalesce("_days", F.lit(0)).cast("int"))
    return here.withColumn(name, moved).drop("_start", "_here", "_bare", "_days")


def clocked(df: DataFrame, text: Column) -> DataFrame:
    """Add `_start` (of the run), `_here` (the time a text names, on the run's first day
    where it names none) and `_bare` (its seconds if it names no day)."""
    start = F.try_to_timestamp(F.nullif(F.regexp_extract("run_id", RUN_STAMP, 1), F.lit("")), F.lit("yyyyMMdd_HHmmss"))
    parts = df.withColumns(
        {
            "_day": F.regexp_extract(text, DAY, 1),
            "_clock": F.regexp_extract(text, CLOCK, 1),
            "_start": F.coalesce(start, F.lit("1970-01-01 00:00:00").cast("timestamp")),
        }
    )
    day = F.when(F.col("_day") == "", F.date_format("_start", "yyyy-MM-dd")).otherwise(F.col("_day"))
    here = parts.withColumn("_here", F.try_to_timestamp(F.concat(day, F.lit(" "), F.col("_clock"))))
    return here.withColumn("_bare", F.when(F.col("_day") == "", F.unix_seconds("_here"))).drop("_day", "_clock")


#: Seconds by which a clock may fall without a new day.
BACK = 3600


def before_start(c: str) -> Column:
    """The day that a clock before the run's start is on."""
    return F.when(F.col(c) < F.unix_seconds("_start") - BACK, 1).otherwise(0)


def _days(df: DataFrame) -> DataFrame:
    """Days to add to the bare clocks, by their falls in the file so far: those in the
    split of the file, and those before it, from a table with one row per split."""
    split = ["run_id", "file", "block"]
    inside = Window.partitionBy(*split).orderBy("line_no")
    last = F.last("_bare", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    falls = df.withColumn("_fell", (F.col("_bare") < last - BACK).cast("int"))
    falls = falls.withColumn("_falls", F.sum("_fell").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    bare = falls.where("_bare IS NOT NULL").groupBy(*split)
    ends = bare.agg(
        F.min_by("_bare", "line_no").alias("_first"),
        F.max_by("_bare", "line_no").alias("_last"),
        F.sum("_fell").alias("_n"),
        F.first("_start").alias("_start"),
    )
    order = Window.partitionBy("run_id", "file").orderBy("block")
    across = F.col("_first") < F.lag("_last").over(order) - BACK
    ends = ends.withColumn("_cross", F.coalesce(across.cast("int"), before_start("_first")))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    earlier = F.sum(F.col("_cross") + F.coalesce("_n", F.lit(0))).over(upto) - F.coalesce("_n", F.lit(0))
    before = ends.select(*split, earlier.alias("_earlier"))
    joined = falls.join(before, split, "left")
    days = F.when(F.col("_bare").isNotNull(), F.coalesce("_falls", F.lit(0)) + F.col("_earlier"))
    return joined.withColumn("_days", days).drop("_fell", "_falls", "_earlier")


def has_clock(c) -> Column:
    return _col(c).rlike(CLOCK)


def counter_value(c, rule: str = "trailing") -> Column:
    """Counter of an `@name: n` line.

    `trailing` reads the number that ends the line. `first_colon` reads the
    number after the first colon, which on a line that starts with a clock is
    the minute; it exists to reproduce tables made that way.
    """
    if rule == "trailing":
        return F.regexp_extract(_col(c), r"@.*:\s*(\d+)\s*$", 1).try_cast("bigint")
    if rule == "first_colon":
        return F.regexp_extract(_col(c), r":\s*(\d+)", 1).try_cast("bigint")
    raise ValueError(f"unknown rule {rule!r}")


def words(c, sep: str = r"\s+") -> Column:
    return F.split(F.btrim(_col(c), F.lit(" \t\r\n")), sep)


def token(c, i: int, sep: str = r"\s+", type: str = "double") -> Column:
    """Token by position, from the left (0, 1, ..) or the right (-1, -2, ..).

    Null when the token is missing or not of the type.
    """
    picked = F.try_element_at(words(c, sep), F.lit(i + 1 if i >= 0 else i))
    return picked if type == "string" else picked.try_cast(type)


def kv(c, key: str, all: bool = False, number: str = r"\d+", lead: str = "", type: str = "bigint") -> Column:
    """Number after `key:`; with `all` every such number as an array."""
    pattern = f"{lead}{key}:({number})"
    if not all:
        return F.regexp_extract(_col(c), pattern, 1).try_cast(type)
    return F.transform(F.regexp_extract_all(_col(c), F.lit(pattern), F.lit(1)), lambda x: x.try_cast(type))


def int_sum(c, whole_tokens: bool = False) -> Column:
    """Sum of the integers of a line: every digit run, or only the tokens after
    the first that consist of digits."""
    if whole_tokens:
        parts = F.filter(words(c), lambda x, i: (i > 0) & x.rlike(r"^\d+$"))
    else:
        parts = F.regexp_extract_all(_col(c), F.lit(r"(\d+)"), F.lit(1))
    return F.aggregate(parts, F.lit(0).cast("bigint"), lambda total, x: total + F.coalesce(x.try_cast("bigint"), F.lit(0)))


def contains_any(c, *parts: str) -> Column:
    test = F.lit(False)
    for part in parts:
        test = test | _col(c).contains(part)
    return test
