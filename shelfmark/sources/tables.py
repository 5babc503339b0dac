"""Loading the tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """``directory`` may be any URI that Spark reads."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
