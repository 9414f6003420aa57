"""Regression models on flat sequence arrays with Spark ML."""

from pyspark.ml import Model
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlat.operators.dataset import scale_steps, unscale
from netlat.operators.scores import evaluation_rows, regression_metrics
from netlat.schemas import FEATURES, TARGET

SEED = 42
# The search space of the boosted trees.
GRID = {
    "maxIter": [100, 300, 500],
    "maxDepth": [4, 6, 8],
    "stepSize": [0.05, 0.1],
    "subsamplingRate": [0.8, 1.0],
}


def vectors(df: DataFrame, features: str = "features") -> DataFrame:
    """The flat array as an ML vector, in column `vector`."""
    return df.withColumn("vector", array_to_vector(F.col(features)))


def gbt(**params) -> GBTRegressor:
    return GBTRegressor(featuresCol="vector", labelCol="y_target", seed=SEED, **params)


def fit_gbt(df: DataFrame, **params) -> Model:
    """Boosted trees with squared error."""
    return gbt(**params).fit(vectors(df))


def tune(df: DataFrame, grid: dict[str, list], fold_col: str = "fold", parallelism: int = 1, **params) -> CrossValidatorModel:
    """Best setting of a grid by mean squared error over the given folds, then
    fitted on all rows."""
    estimator = gbt(**params)
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), values)
    maps = builder.build()
    folds = df.agg(F.max(fold_col)).first()[0] + 1
    search = CrossValidator(
        estimator=estimator,
        estimatorParamMaps=maps,
        evaluator=RegressionEvaluator(labelCol="y_target", metricName="mse"),
        numFolds=folds,
        foldCol=fold_col,
        parallelism=parallelism,
        seed=SEED,
    )
    return search.fit(vectors(df))


def grid_table(spark: SparkSession, tuned: CrossValidatorModel) -> DataFrame:
    """One row per setting with its mean squared error; the driver holds only the
    grid."""
    rows = [
        tuple(float(v) for v in (*[params[p] for p in params], mse))
        for params, mse in zip(tuned.getEstimatorParamMaps(), tuned.avgMetrics)
    ]
    columns = [p.name for p in tuned.getEstimatorParamMaps()[0]] + ["mse"]
    return spark.createDataFrame(rows, columns)


def score(df: DataFrame, model: Model, mm: DataFrame | None = None, name: str = "prediction", features: str = "features") -> DataFrame:
    """Predictions, mapped back to milliseconds by the scaler of the target."""
    out = model.transform(vectors(df, features)).drop("vector")
    if name != "prediction":
        out = out.withColumnRenamed("prediction", name)
    return unscale(out, mm, name, "y_target") if mm is not None else out


def score_window(df: DataFrame, model: Model, mm: DataFrame, cols=FEATURES) -> DataFrame:
    """Predictions for raw windows: scale each step, predict, map back."""
    scaled = scale_steps(df, mm, cols)
    return score(scaled, model, mm)


def baselines() -> dict:
    """Other regressors of the comparison, by name."""
    return {
        "forest": RandomForestRegressor(featuresCol="vector", labelCol="y_target", seed=SEED, numTrees=20, maxDepth=5),
        "linear": LinearRegression(featuresCol="vector", labelCol="y_target", regParam=0.01),
    }


def fit_models(train: DataFrame, models: dict) -> dict[str, Model]:
    """Fitted models as they are, estimators fitted on `train`."""
    return {n: m if isinstance(m, Model) else m.fit(vectors(train)) for n, m in models.items()}


def predictions(df: DataFrame, models: dict[str, Model]) -> DataFrame:
    """df with each model's scaled prediction in a column of its name."""
    for name, model in models.items():
        df = score(df, model, None, name)
    return df


def save_model(model: Model, path: str) -> None:
    """Store a fitted model; one that is there is replaced."""
    model.write().overwrite().save(path)


def load_model(spark: SparkSession, path: str) -> Model:
    """A stored model of any kind."""
    return DefaultParamsReader.loadParamsInstance(path, spark)


def compare(
    train: DataFrame, test: DataFrame, models: dict, mm: DataFrame | None = None, persistence: str | None = TARGET,
    actual: str = "y_target",
) -> DataFrame:
    """Error measures of several models on one test set.

    `models` holds fitted models or estimators to fit on `train`. `persistence`
    names a column of the test set that serves as the forecast "stays as it is".
    """
    fitted = fit_models(train, models)
    rows = predictions(test, fitted)
    names = list(fitted)
    if persistence and persistence in test.columns:
        rows = rows.withColumn("persistence", F.col(persistence))
        names.append("persistence")
    if mm is not None:
        rows = unscale(rows, mm, [actual, *fitted], "y_target")
    kept = evaluation_rows(rows, actual, names)
    return regression_metrics(kept, actual, names)


def importance_table(spark: SparkSession, model: Model) -> DataFrame:
    """(pos, importance) of a fitted tree model; its size is that of one window."""
    scores = model.featureImportances.toArray()
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(scores)], "pos bigint, importance double")


__all__ = [
    "GRID", "SEED", "baselines", "compare", "fit_gbt", "fit_models", "gbt", "grid_table", "importance_table",
    "load_model", "predictions", "save_model", "score", "score_window", "tune", "vectors",
]
