"""Parquet tables of a data directory."""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of ``sf_dir``; Spark resolves the path, so any of its file systems will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
