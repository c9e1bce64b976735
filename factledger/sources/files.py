"""Report tables and notes as files: CSV by week, JSON by note. Spark's committer makes each write whole or absent."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_reports(reports: DataFrame, path: str) -> None:
    """One folder of CSV files a week; what was at the path goes."""
    reports.write.mode("overwrite").partitionBy("week").option("header", True).csv(path)


def table_index(tables: DataFrame, attributes: list[str]) -> DataFrame:
    """One row a table: ``table_id``, its attributes and ``n_rows``. Rows without id belong to none."""
    return tables.where(F.col("table_id").isNotNull()).groupBy("table_id", *attributes).agg(F.count(F.lit(1)).alias("n_rows"))


def write_tables(tables: DataFrame, path: str, attributes: list[str]) -> None:
    """``path/tables``: one CSV file a table in a folder of its id; ``path/index``: the tables' index, in the order of their
    attributes and ids. What was at both goes. Attributes stand in the index alone."""
    known = tables.where(F.col("table_id").isNotNull())
    known.drop(*attributes).repartition("table_id").write.mode("overwrite").partitionBy("table_id").option("header", True).csv(f"{path}/tables")
    table_index(tables, attributes).orderBy(*attributes, "table_id").write.mode("overwrite").option("header", True).csv(f"{path}/index")


def read_tables(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of the written tables (``schema`` without the id), with ``table_id``; a filter on it reads those folders alone."""
    return read_csv(spark, f"{path}/tables", f"{schema}, table_id string")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV files of a schema; no rows where nothing is at the path."""
    try:
        return spark.read.schema(schema).option("header", True).csv(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_notes(notes: DataFrame, path: str) -> None:
    """Notes as JSON lines, beside those that are there."""
    notes.write.mode("append").json(path)


def read_notes(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Notes of JSON files with their file. A line that is no JSON object has no note and is left out."""
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    return rows.where(F.col("note_id").isNotNull()).withColumn("file", F.col("_metadata.file_path"))
