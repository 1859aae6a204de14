"""Reading the driver's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the folder `sf_dir` (one parquet file or a folder of them)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
