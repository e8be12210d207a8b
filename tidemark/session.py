"""The Spark session that the package is tested and benchmarked with."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    builder = SparkSession.builder.master(master).appName("tidemark")
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
