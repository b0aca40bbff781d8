"""Plain table sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_features(df: DataFrame, path: str) -> None:
    """Replace the feature table at `path`."""
    df.write.mode("overwrite").parquet(path)


def write_counterfactuals(df: DataFrame, path: str) -> None:
    """Counterfactual table as CSV with a header; the change list becomes text."""
    flat = df.withColumn("changes", F.to_json("changes"))
    flat.write.mode("overwrite").option("header", True).csv(path)


def read_counterfactuals(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)
