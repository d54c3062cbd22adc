"""Readers of the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """`columns` (default: all) of the Parquet table `name` in `folder`."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def requests(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Analysis requests as sent; whole-row repeats are still there (operators drop them after their own work)."""
    return table(spark, folder, "analysis_requests", *(columns or ("request_id", "text")))


def distinct_rows(df: DataFrame) -> DataFrame:
    """Reloads repeat whole rows; such a row counts once."""
    return df.dropDuplicates()


def with_text(df: DataFrame, column: str = "text") -> DataFrame:
    """Only rows with a text; null and empty texts have no content to work on."""
    return df.filter(F.length(column) > 0)


def texts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the file's path) and text of plain text files, one row for each."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))


def arriving(spark: SparkSession, path: str, schema: str, files_at_once: int = 100) -> DataFrame:
    """Parquet files as they arrive, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)
