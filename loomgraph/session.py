"""A session with the settings the engine is tuned for; a cluster's own settings win."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(cpus: int = 8, partitions: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks. On a cluster use the cluster's session instead."""
    settings = {
        "spark.master": f"local[{cpus}]",
        "spark.sql.shuffle.partitions": str(partitions or cpus),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | conf
    spark = SparkSession.builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
