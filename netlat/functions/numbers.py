"""Numeric, unit and display expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

KB, MB, GB = 1024, 1024**2, 1024**3


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip0(c) -> Column:
    """Negative values become 0, null stays null."""
    c = _col(c)
    return F.when(c < 0, F.lit(0)).otherwise(c)


def ratio(n, d, scale: float = 1.0) -> Column:
    """n / d * scale, 0 when d is not above 0."""
    n, d = _col(n), _col(d)
    return F.when(d > 0, F.try_divide(n.cast("double"), d.cast("double")) * F.lit(float(scale))).otherwise(F.lit(0.0))


def link_pct(bytes_, bps: int = 10**9) -> Column:
    """Bytes in one second as percent of the link speed."""
    return _col(bytes_).cast("double") * 8 / F.lit(float(bps)) * 100


def kb_to_mb(c) -> Column:
    return _col(c).cast("double") / KB


def number_or_zero(c, type: str = "double") -> Column:
    """Unset (`-`) and unreadable values count as 0."""
    return F.coalesce(_col(c).try_cast(type), F.lit(0).cast(type))


def human_bytes(c) -> Column:
    """Bytes as GB, MB or KB with two decimals (halves to even), or whole bytes."""
    c = _col(c)
    return (
        F.when(c >= GB, F.format_string("%.2fGB", F.bround(c / GB, 2)))
        .when(c >= MB, F.format_string("%.2fMB", F.bround(c / MB, 2)))
        .when(c >= KB, F.format_string("%.2fKB", F.bround(c / KB, 2)))
        .otherwise(F.format_string("%dB", c.cast("bigint")))
    )


def mb_bucket(c) -> Column:
    """Size cut to whole MB, as text."""
    return F.concat((_col(c) / MB).cast("bigint").cast("string"), F.lit("MB"))


def bar(c, per: int = 1000) -> Column:
    """One star per `per` counted rows, at least one when the count is above 0."""
    c = _col(c).cast("bigint")
    stars = F.when(c > 0, F.greatest(F.lit(1), F.floor(c / per))).otherwise(F.lit(0))
    return F.repeat(F.lit("*"), stars.cast("int"))
