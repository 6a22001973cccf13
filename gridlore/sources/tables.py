"""Reading and registering tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def register(df: DataFrame, name: str) -> DataFrame:
    """Make a table known to ``spark.sql`` under a name, replacing an earlier one; nothing is copied."""
    df.createOrReplaceTempView(name)
    return df


def sample_rows(df: DataFrame, key: str, n: int = 3) -> DataFrame:
    """The first n rows by a key: Spark tables have no row order of their own."""
    return df.orderBy(key).limit(n)
