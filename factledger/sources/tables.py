"""Parquet tables of a data folder, read lazily so that Catalyst prunes columns and pushes filters."""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; ``sf_dir`` may be any path that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
