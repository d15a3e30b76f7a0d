"""Readers for the Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docketloom.shipping import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``, lazily."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
