"""Session helpers."""

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A path under the cluster's shared checkpoint folder; where none is set, under the
    warehouse folder, which all executors share as well."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return f"{base.rstrip('/')}/{name}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return shared_path(spark, f"{name}-{uuid.uuid4().hex}")


def settle(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table to the shared folder and read it back, so that what follows
    neither computes it again nor depends on the executors that made it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
