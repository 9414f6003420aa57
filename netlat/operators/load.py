"""Load plans from hourly profiles, and request mixes from weighted categories."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netlat.operators.series import cumulative, names
from netlat.operators.spread import pieces, spread_join

# Connections per stress hour, from_hour <= hour < to_hour. Two days
# have their own ladder, all others the default.
DEFAULT_LADDER = [(12, 16, 500), (16, 20, 700), (20, 24, 1000)]
DAY_LADDERS = {
    "0803": [(12, 16, 500), (16, 21, 1000), (21, 24, 700)],
    "0805": [(12, 17, 500), (17, 21, 1000), (21, 24, 700)],
}
# Percent of requests that close their connection, and percent that
# upload.
CLOSE_PCT = {
    "0730": 50,
    "0731": 40,
    "0801": 36,
    "0802": 45,
    "0803": 40,
    "0804": 36,
    "0805": 36,
    "0806": 62,
    "generic": 70,
}
NORMAL_UNTIL = 12


def load_targets(profile: DataFrame, base: int = 100, floor: int = 5) -> DataFrame:
    """Connections of the normal hours: traffic as a share of the day's peak.

    A profile has 24 rows a day, so the window is small.
    """
    peak = F.max("traffic").over(Window.partitionBy("day"))
    target = F.greatest(F.lit(floor).cast("bigint"), F.floor(F.try_divide(F.col("traffic") * base, peak)))
    return profile.withColumn("peak", peak).withColumn("connections", target)


def _step(ladder) -> Column:
    out = None
    for lo, hi, connections in ladder:
        test = (F.col("hour") >= lo) & (F.col("hour") < hi)
        out = F.when(test, connections) if out is None else out.when(test, connections)
    return out


def stress_ladder(
    profile: DataFrame, ladder=DEFAULT_LADDER, from_hour: int = NORMAL_UNTIL, day_ladders: dict | None = None
) -> DataFrame:
    """Connections and phase per hour: load targets before `from_hour`, the
    ladder from then on. A ladder is a handful of fixed steps, so it is part of
    the expression; `day_ladders` replaces it on named days."""
    steps = _step(ladder)
    for day, own in (day_ladders or {}).items():
        steps = F.when(F.col("day") == day, _step(own)).otherwise(steps)
    normal = F.col("hour") < from_hour
    return load_targets(profile).select(
        "day",
        "hour",
        "traffic",
        F.when(normal, "normal").otherwise("stress").alias("phase"),
        F.when(normal, F.col("connections")).otherwise(steps.cast("bigint")).alias("connections"),
    )


def category_weights(df: DataFrame, col: str, n: int, by=None, other: str = "other") -> DataFrame:
    """The n most frequent names of each group with their counts, and one row for
    all others. `place` keeps their order."""
    by = names(by or [])
    counts = df.groupBy(*by, F.col(col).alias("name")).agg(F.count(F.lit(1)).alias("weight"))
    group = by or ["_all"]
    counts = counts if by else counts.withColumn("_all", F.lit(0))
    w = Window.partitionBy(*group).orderBy(F.desc("weight"), F.desc("name"))
    # The limit reaches the tasks before the shuffle. What the top names leave of
    # the total is one aggregation, so the counts are shuffled once and reused.
    top = counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
    left = counts.select(*group, "weight").unionAll(top.select(*group, -F.col("weight")))
    rest = left.groupBy(*group).agg(F.sum("weight").alias("weight")).where(F.col("weight") > 0)
    rest = rest.select(*group, F.lit(other).alias("name"), "weight", F.lit(n + 1).alias("place"))
    return top.select(*group, "name", "weight", "place").unionByName(rest).select(*by, "name", "weight", "place")


def closed_share(df: DataFrame, col: str, closed: list[str], by=None) -> DataFrame:
    """Percent of the connections that ended in one of the given states."""
    share = F.avg(F.when(F.col(col).isin(closed), 100.0).otherwise(0.0))
    return df.groupBy(*names(by or [])).agg(share.alias("close_pct"))


def weighted_pick(
    df: DataFrame, weights: DataFrame, draw: str, default: str, by: str, order="place", name: str = "name"
) -> DataFrame:
    """Category whose running weight first reaches the draw, else the default.

    The running weights of a group are cut into pieces of equal width, about one a
    category and at least as many as the group's rows call for; a category is listed in
    each piece it reaches into. So the pick is an equi-join on group and piece, on
    which a hot group spreads by its draws; at uniform draws a row meets two
    categories on average, however many there are.
    """
    summed = cumulative(weights, by, order, name="_hi").withColumn("_lo", F.col("_hi") - F.col("weight"))
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    many = pieces(sizes, by)
    groups = summed.groupBy(by).agg(F.max("_hi").alias("_sum"), F.count(F.lit(1)).alias("_k")).join(many, by, "left")
    width = F.ceil(F.col("_sum") / F.greatest("_k", F.coalesce("_pieces", F.lit(1))))
    groups = groups.select(by, F.greatest(width, F.lit(1)).cast("bigint").alias("_width"))
    index = summed.where("weight > 0").join(groups, by)
    index = index.withColumn("_at", F.explode(F.sequence(F.expr("_lo div _width"), F.expr("(_hi - 1) div _width"))))
    index = index.select(by, "_at", "_lo", "_hi", F.col("name").alias("_name"))
    at = spread_join(df, groups, by, F.struct(*df.columns), "left", sizes)
    # The first category takes draws below 1 too.
    at = at.withColumn("_draw_at", F.when(F.col(draw).isNotNull(), F.greatest(F.ceil(F.col(draw)).cast("bigint"), F.lit(1))))
    at = at.withColumn("_at", F.expr("(_draw_at - 1) div _width"))
    x, y = at.alias("x"), index.alias("y")
    met = (F.col(f"x.{by}") == F.col(f"y.{by}")) & (F.col("x._at") == F.col("y._at"))
    met = met & (F.col("y._lo") < F.col("x._draw_at")) & (F.col("x._draw_at") <= F.col("y._hi"))
    picked = x.join(y, met, "left")
    return picked.select(*[F.col(f"x.{c}") for c in df.columns], F.coalesce("y._name", F.lit(default)).alias(name))


def uniform_draw(n, *keys) -> Column:
    """Whole number 1..n that depends on the keys only."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.pmod(F.xxhash64(*keys), n) + 1


def request_mix(
    requests: DataFrame,
    weights: DataFrame,
    by: str,
    key: str,
    default: str,
    close_pct: int | str,
    special_pct: int | list[tuple[int, str]] = 5,
    seed: int = 0,
) -> DataFrame:
    """Host, connection header and kind of each request.

    `special_pct` is the share of uploads, or a list of (upper bound, kind) for a
    mix of several kinds; what is above the last bound is a plain read. `close_pct` is
    one share for all, or names the column of the requests that holds it (the share of
    the day, as closed_share gives it).
    """
    total = weights.groupBy(by).agg(F.sum("weight").alias("_sum"))
    at = spread_join(requests, total, by, F.col(key))
    at = at.withColumn("_draw", uniform_draw(F.col("_sum"), F.lit("host"), F.col(key), F.lit(seed)))
    picked = weighted_pick(at, weights, "_draw", default, by, name="host")
    closes = uniform_draw(100, F.lit("close"), F.col(key), F.lit(seed)) <= (F.col(close_pct) if isinstance(close_pct, str) else close_pct)
    kind_draw = uniform_draw(100, F.lit("kind"), F.col(key), F.lit(seed))
    kinds = [(special_pct, "upload")] if isinstance(special_pct, int) else list(special_pct)
    kind = None
    for bound, label in kinds:
        kind = F.when(kind_draw <= bound, label) if kind is None else kind.when(kind_draw <= bound, label)
    return picked.select(
        *requests.columns,
        "host",
        F.when(closes, "close").otherwise("keep-alive").alias("connection"),
        kind.otherwise("read").alias("request"),
    )
