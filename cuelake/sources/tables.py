"""Loading the tables of one directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table, a file or a folder of files; schema from its footer, never from its rows."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
