"""Evaluation tables: error measures, ranking of models, importance, samples."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlat.functions.numbers import clip0
from netlat.operators.series import names, with_position

EPSILON = 1e-10


def positive(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col) > 0)


def evaluation_rows(df: DataFrame, actual: str, preds: list[str]) -> DataFrame:
    """Rows with a positive actual value; predictions below 0 count as 0."""
    kept = positive(df, actual)
    return kept.withColumns({p: clip0(p) for p in preds})


def regression_metrics(df: DataFrame, actual: str, preds: list[str]) -> DataFrame:
    """One row per model with mae, rmse, mape (percent) and r2, from one pass."""
    y = F.col(actual)

    def measures(p):
        error = y - F.col(p)
        # The sum of squares around the mean is count * var_pop, of the rows that have
        # a prediction.
        r2 = 1 - F.sum(error * error) / F.sum(F.when(F.col(p).isNotNull(), F.lit(1))) / F.nullif(F.var_pop(F.when(F.col(p).isNotNull(), y)), F.lit(0.0))
        return F.struct(
            F.lit(p).alias("model"),
            F.round(F.avg(F.abs(error)), 4).alias("mae"),
            F.round(F.sqrt(F.avg(error * error)), 4).alias("rmse"),
            F.round(F.avg(F.abs(error / (y + EPSILON))) * 100, 2).alias("mape"),
            F.round(r2, 4).alias("r2"),
        )

    return df.agg(F.array(*[measures(p) for p in preds]).alias("m")).select(F.inline("m"))


def best_model(metrics: DataFrame) -> DataFrame:
    """The model with the largest r2."""
    best = F.max_by(F.struct("model", "r2"), "r2")
    return metrics.agg(best.alias("b")).select("b.model", "b.r2")


def rmse_gap(metrics: DataFrame, a: str, b: str) -> DataFrame:
    """Which of two models has the smaller rmse, and by how much."""
    of = lambda m: F.max(F.when(F.col("model") == m, F.col("rmse")))
    gap = metrics.agg(of(a).alias("x"), of(b).alias("y"))
    return gap.select(
        F.when(F.col("x") < F.col("y"), F.lit(a)).otherwise(F.lit(b)).alias("better"),
        F.round(F.abs(F.col("x") - F.col("y")), 2).alias("gap"),
    )


def fold_importance(df: DataFrame, feature_names: list[str], top: int | None = None) -> DataFrame:
    """Sum the scores of a flat step-by-step model over its steps.

    Input is (pos, importance) with pos = step * features + feature.
    """
    n = len(feature_names)
    label = F.element_at(F.array(*[F.lit(f) for f in feature_names]), (F.col("pos") % n + 1).cast("int"))
    folded = df.groupBy(label.alias("feature")).agg(F.sum("importance").alias("importance"))
    ordered = folded.orderBy(F.desc("importance"), F.desc("feature"))
    return ordered.limit(top) if top else ordered


def stride(df: DataFrame, by, order, every: int = 50, span: float = 3600) -> DataFrame:
    """Every n-th row of each series, from the first."""
    return with_position(df, names(by), order, span=span).where(F.col("pos") % every == 0)


def zoom(df: DataFrame, by, order, lo: int = 100, hi: int = 400, span: float = 3600) -> DataFrame:
    """Rows lo..hi-1 of each series."""
    return with_position(df, names(by), order, span=span).where((F.col("pos") >= lo) & (F.col("pos") < hi))
