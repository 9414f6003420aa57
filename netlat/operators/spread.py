"""Joins of rows with a small table by series, where one series may be hot.

A series with more than its share of all rows is cut into pieces, and its row of the
small table is copied for each; the other series are joined as they are. How many
pieces comes from the counted rows.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlat.operators.series import CHUNK_ROWS, names

#: A series is hot with more than one in SHARE of all rows, so fewer are hot, and more
#: than LEAST rows; a piece of it has about as many rows as that.
SHARE, LEAST = 1_000, CHUNK_ROWS


def pieces(sizes: DataFrame, by, rows: str = "_n", share: int = SHARE) -> DataFrame:
    """by and `_pieces` of the hot series, of a table of series with their rows; it has
    fewer than `share` rows, whatever the data."""
    limit = F.greatest(F.lit(float(LEAST)), sizes.agg((F.sum(rows) / F.lit(share)).alias("limit")).scalar())
    hot = sizes.where(F.col(rows) > limit)
    return hot.select(*names(by), F.ceil(F.col(rows) / limit).cast("int").alias("_pieces"))


def spread_join(df: DataFrame, small: DataFrame, by, key: Column, how: str = "inner", sizes: DataFrame | None = None, rows: str = "_n",
                share: int = SHARE) -> DataFrame:
    """df joined with a table of at most one row per series. `key` tells rows of a hot
    series apart; `sizes` (by, and `rows`: how many) saves counting them."""
    by = names(by)
    if sizes is None:
        sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias(rows))
    hot = pieces(sizes, by, rows, share)
    # The hot series are fewer than `share`, so their table is small on any data.
    at = df.join(F.broadcast(hot), by, "left")
    at = at.withColumn("_piece", F.pmod(F.xxhash64(key), F.coalesce("_pieces", F.lit(1))).cast("int")).drop("_pieces")
    copies = small.join(F.broadcast(hot), by, "left")
    copies = copies.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1))).drop("_pieces")
    return at.join(copies, [*by, "_piece"], how).drop("_piece")
