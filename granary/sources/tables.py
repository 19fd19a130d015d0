"""Parquet tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder; Spark's reader opens it, so any store that Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
