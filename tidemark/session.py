"""Session settings the engine is designed for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Settings that matter for skewed keys and large shuffles. They are plain Spark options, so a
# cluster can set them in spark-defaults instead.
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.executorEnv.OPENBLAS_NUM_THREADS": "1",  # one core per task
}


def local_session(name: str = "tidemark", cores: str = "*", **conf: str) -> SparkSession:
    """A single-JVM session for tests and benchmarks."""
    os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")  # local workers inherit the environment
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
    )
    for key, value in {**RECOMMENDED, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
