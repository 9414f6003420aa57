"""Smoothing, resampling and noise for training series."""

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlat.operators.series import CHUNK_ROWS, names, over_series, with_position
from netlat.operators.spread import spread_join


def exempt(col: str) -> bool:
    """Columns that take no noise."""
    return "time" in col.lower() or "label" in col.lower()


def gauss(*keys, second: bool = False) -> Column:
    """Standard normal draw that depends on the keys only, so a task that runs
    again makes the same draw. The same keys give a `second` independent draw."""
    bits = F.xxhash64(*keys)
    scale = float(1 << 32)
    # Two uniforms from the two halves of the hash; the first stays above 0.
    u = (F.shiftrightunsigned(bits, 32).cast("double") + 1) / (scale + 1)
    v = bits.bitwiseAND(F.lit((1 << 32) - 1)).cast("double") * (2 * math.pi / scale)
    return F.sqrt(F.log(u) * -2) * (F.sin(v) if second else F.cos(v))


def replicate(df: DataFrame, n: int, name: str = "variation") -> DataFrame:
    """Each row n times, numbered from 1."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(1), F.lit(n))))


def _neighbours(df, run, order, num, text, back: int, span, rows) -> DataFrame:
    """Each old row i with its series' length `_size` and the rows around it.

    The columns of `num`, after a trailing mean over `back` more rows, become one
    array for each of the rows i-1, i, i+1 and i+2, so that values at and next to
    any grid point need no further window. At the ends the nearest row stands in.
    """
    placed = with_position(df, run, order, name="_i", span=span, size="_size")

    def mean(c):
        return lambda w: F.avg(c).over(w.rowsBetween(-back, 0))

    at = F.array(*[F.col(f"_mean_{c}") for c in num])
    stages = [
        {f"_mean_{c}": mean(c) for c in num},
        {
            "_before": lambda w: F.coalesce(F.lag(at, 1).over(w), at),
            "_here": lambda w: at,
            "_next": lambda w: F.coalesce(F.lead(at, 1).over(w), at),
            "_after": lambda w: F.coalesce(F.lead(at, 2).over(w), F.lead(at, 1).over(w), at),
            **{f"_next_{c}": (lambda c: lambda w: F.lead(c, 1).over(w))(c) for c in text},
        },
    ]
    made = over_series(placed, run, "_i", stages, back=back + 1, ahead=2, pos="_i", rows=rows)
    return made.select(*run, "_i", "_size", "_before", "_here", "_next", "_after", *text, *[f"_next_{c}" for c in text])


def _ranges(made: DataFrame, factor: int) -> DataFrame:
    """Grid points `_from` .. `_until` - 1 that lie at or after each old row."""
    # In whole numbers that cannot overflow.
    first = "(({i}) * {f} + (({i}) * ({f} - 1) + greatest(_size - 2, 0)) div greatest(_size - 1, 1))"
    n = F.col("_size")
    return made.withColumns(
        {
            "_from": F.expr(first.format(i="_i", f=factor)),
            "_until": F.when(F.col("_i") == n - 1, n * factor).otherwise(F.expr(first.format(i="_i + 1", f=factor))),
        }
    )


def _points(made: DataFrame, factor: int) -> DataFrame:
    """One row per grid point `k`, with its share `_f` of the way to the next row."""
    points = _ranges(made, factor).withColumn("k", F.explode(F.sequence(F.col("_from"), F.col("_until") - 1)))
    return points.withColumn("_f", _place(F.col("k"), factor) - F.col("_i"))


def _place(k: Column, factor: int) -> Column:
    """Place of grid point k on the old index; the grid has factor * size points
    from the first to the last old row."""
    n = F.col("_size")
    return F.when(n > 1, k.cast("double") * (n - 1) / (n * factor - 1)).otherwise(F.lit(0.0))


def _value(j: int) -> Column:
    """Linear value of the j-th column at the grid point."""
    x = F.get("_here", F.lit(j))
    return x + (F.get("_next", F.lit(j)) - x) * F.col("_f")


def _deviations(smooth: DataFrame, run, num, noisy, factor: int) -> DataFrame:
    """Population deviation of each noisy column over the grid points, one row
    per series, from sums over each old row's points instead of the points."""
    r = _ranges(smooth, factor)
    m, n = F.col("_until") - F.col("_from"), F.col("_size")
    # The shares f run evenly from f0 with step d over the m points of a row.
    d = F.when(n > 1, (n - 1).cast("double") / (n * factor - 1)).otherwise(F.lit(0.0))
    f0 = F.when(n > 1, _place(F.col("_from"), factor) - F.col("_i")).otherwise(F.lit(0.0))
    t1, t2 = m * (m - 1) / 2, (m - 1) * m * (2 * m - 1) / 6
    r = r.withColumns({"_m": m, "_s1": m * f0 + d * t1, "_s2": m * f0 * f0 + 2 * f0 * d * t1 + d * d * t2})
    # Sums of squares lose a small spread of large values, so values are taken from
    # the series' mean: one row per series, joined back by series, a hot one in pieces.
    means = smooth.groupBy(*run).agg(F.count(F.lit(1)).alias("_n"), F.array(*[F.avg(F.get("_here", F.lit(j))) for j in range(len(num))]).alias("_mean"))
    r = spread_join(r, means.drop("_n"), run, F.col("_i"), sizes=means.select(*run, "_n"))
    sums = []
    for j, c in enumerate(num):
        if c in noisy:
            x = F.get("_here", F.lit(j)) - F.get("_mean", F.lit(j))
            y = F.get("_next", F.lit(j)) - F.get("_here", F.lit(j))
            sums += [
                F.sum(x * F.col("_m") + y * F.col("_s1")).alias(f"_a_{c}"),
                F.sum(x * x * F.col("_m") + 2 * x * y * F.col("_s1") + y * y * F.col("_s2")).alias(f"_b_{c}"),
                (F.max(x) == F.min(x)).alias(f"_flat_{c}"),
            ]
    total = r.groupBy(*run).agg(F.sum("_m").alias("_points"), *sums)

    def deviation(c):
        mean = F.col(f"_a_{c}") / F.col("_points")
        variance = F.col(f"_b_{c}") / F.col("_points") - mean * mean
        return F.when(F.col(f"_flat_{c}"), F.lit(0.0)).otherwise(F.sqrt(F.greatest(variance, F.lit(0.0))))

    return total.select(*run, F.array(*[deviation(c) for c in noisy]).alias("_sd"))


def _mix(z: np.ndarray) -> np.ndarray:
    """Scramble 64-bit keys (the finaliser of the public SplitMix64 generator)."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _normals(keys: np.ndarray, columns: int) -> np.ndarray:
    """One row of standard normal draws per key."""
    step = np.arange(1, columns + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bits = _mix(_mix(keys)[:, None] + step[None, :])
    u = ((bits >> np.uint64(32)).astype(float) + 1) / (2.0**32 + 1)
    v = (bits & np.uint64(0xFFFFFFFF)).astype(float) * (2 * np.pi / 2.0**32)
    return np.sqrt(-2 * np.log(u)) * np.cos(v)


def _point_batches(run, num, text, noisy, factor, level, most: int = 100_000):
    """A function from batches of old rows to batches of their grid points."""
    columns = len(num)
    taken = np.array([c in noisy for c in num])
    rounded = np.array(["label" in c.lower() for c in num])

    def matrix(batch, name, width):
        return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)

    def points(batch: pa.RecordBatch) -> pa.RecordBatch:
        whole = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("_i", "_size", "_from", "_until")}
        near = [matrix(batch, c, columns) for c in ("_before", "_here", "_next", "_after")]
        row = np.repeat(np.arange(batch.num_rows), whole["_until"] - whole["_from"])
        i, n, low, high = (whole[c][row] for c in ("_i", "_size", "_from", "_until"))
        k = np.arange(len(row)) - np.searchsorted(row, row) + low
        last = n * factor - 1

        def place(at):
            return np.where(n > 1, at * (n - 1) / np.maximum(last, 1), 0.0)

        value = near[1][row] + (near[2] - near[1])[row] * (place(k) - i)[:, None]
        value = np.where(n[:, None] > 1, value, near[1][row])
        weights = np.zeros((4, len(row)))
        noise = np.zeros((len(row), len(noisy)))
        count = np.zeros(len(row))
        for s in (-1, 0, 1):
            at = k + s
            has = (at >= 0) & (at <= last)
            step = np.where(at < low, -1, np.where((at >= high) & (i < n - 1), 1, 0))
            f = np.where(n > 1, place(at) - (i + step), 0.0)
            for o in (-1, 0, 1, 2):
                weights[o + 1] += has * (np.where(step == o, 1 - f, 0.0) + np.where(step + 1 == o, f, 0.0))
            count += has
            if level:
                series = batch.column("_series").to_numpy(zero_copy_only=False)[row].astype(np.uint64)
                noise += has[:, None] * _normals(series + at.astype(np.uint64) * np.uint64(0xD1342543DE82EF95), len(noisy))
        smooth = sum(w[:, None] * x[row] for w, x in zip(weights, near)) / count[:, None]
        if level:
            sigma = matrix(batch, "_sd", len(noisy)) * level
            sigma = np.where(sigma == 0, 0.0001, sigma)
            smooth[:, taken] += sigma[row] * noise / count[:, None]
        out = np.where(taken, np.maximum(smooth, 0), np.where(rounded, np.rint(value), value))
        nearest = np.rint(place(k)) > i
        made = {c: batch.column(c).take(pa.array(row)) for c in [*run, "variation"]}
        made["k"] = pa.array(k)
        made |= {c: pa.array(np.ascontiguousarray(out[:, j])) for j, c in enumerate(num)}
        for c in text:
            made[c] = pc.if_else(pa.array(nearest), batch.column(f"_next_{c}").take(pa.array(row)), batch.column(c).take(pa.array(row)))
        return pa.RecordBatch.from_pydict(made)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, most // (factor + 1))
            for at in range(0, batch.num_rows, step):
                yield points(batch.slice(at, step))

    return convert


def _text(c: str, factor: int) -> Column:
    """Text of the nearest old row; halfway goes to the even row."""
    nearest = F.rint(_place(F.col("k"), factor))
    return F.when(nearest > F.col("_i"), F.col(f"_next_{c}")).otherwise(F.col(c))


def upsample(
    df: DataFrame, num, text, run, order, factor: int = 10, span: float = 3600, rows: int = CHUNK_ROWS
) -> DataFrame:
    """Linear resampling to `factor` times as many points, numbered `k`, spread
    evenly from the first to the last row of each series. Columns of `text` take
    the nearest row."""
    run, num, text = names(run), names(num), names(text)
    points = _points(_neighbours(df, run, order, num, text, 0, span, rows), factor)
    return points.select(
        *run, "k", *[_value(j).alias(c) for j, c in enumerate(num)], *[_text(c, factor).alias(c) for c in text]
    )


def add_noise(
    df: DataFrame, run, cols, level: float = 0.02, seed: int = 0, key: str = "k"
) -> DataFrame:
    """Add normal noise of `level` times the column's deviation in its series, at
    least 0.0001. Columns with time or label in their name stay.

    The deviations are one row per series; a hot series is joined with its own in pieces.
    """
    run, cols = names(run), [c for c in names(cols) if not exempt(c)]
    each = df.groupBy(*run).agg(F.count(F.lit(1)).alias("_n"), *[F.stddev_pop(c).alias(f"_sd_{c}") for c in cols])
    noisy = spread_join(df, each.drop("_n"), run, F.col(key), sizes=each.select(*run, "_n"))

    def value(c):
        sigma = F.col(f"_sd_{c}") * level
        sigma = F.when(sigma == 0, F.lit(0.0001)).otherwise(sigma)
        return F.col(c) + sigma * gauss(*[F.col(r) for r in run], F.lit(c), F.col(key), F.lit(seed))

    return noisy.select(*[value(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def augment_series(
    df: DataFrame,
    num,
    text,
    run,
    order,
    factor: int = 10,
    level: float = 0.02,
    variations: int = 1,
    seed: int = 0,
    span: float = 3600,
    rows: int = CHUNK_ROWS,
    store: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Smooth, resample and vary each series.

    Trailing mean of 4, linear resampling, then per variation noise, centred mean
    of 3 and a floor of 0; columns named like a time or label take none of the
    last three, and labels are rounded. The centred mean is worked out from the
    old rows around each point, so the resampled rows, `factor` times as many,
    are never shuffled. The points are made by numpy on whole batches: as column
    expressions, 60 draws a row for 20 columns took four times as long. `level=0` adds no noise; with noise the smoothed rows are
    read twice, and `store` may write them to a table first.
    """
    run, num, text = names(run), names(num), names(text)
    noisy = [c for c in num if not exempt(c)]
    smooth = _neighbours(df, run, order, num, text, 3, span, rows)
    smooth = store(smooth) if store else smooth
    old = replicate(_ranges(smooth, factor), variations)
    if level:
        old = spread_join(old, _deviations(smooth, run, num, noisy, factor), run, F.col("_i"), sizes=smooth.groupBy(*run).agg(F.count(F.lit(1)).alias("_n")))
        old = old.withColumn("_series", F.xxhash64(*[F.col(r) for r in run], F.col("variation"), F.lit(seed)))
    schema = T.StructType(
        [smooth.schema[r] for r in run]
        + [T.StructField("variation", T.IntegerType()), T.StructField("k", T.LongType())]
        + [T.StructField(c, T.DoubleType()) for c in num]
        + [smooth.schema[c] for c in text]
    )
    return old.mapInArrow(_point_batches(run, num, text, noisy, factor, level), schema)
