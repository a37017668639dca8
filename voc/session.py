"""A local session with the settings the jobs are written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    # call sites on every column expression cost more than building the plan
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # batches of one Arrow pass: large enough for the kernels, small enough for long texts
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
}


def local_session(cpus: int | None = None, memory: str = "4g", name: str = "voc") -> SparkSession:
    cpus = cpus or os.cpu_count() or 4
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    for key, value in {
        **SETTINGS, "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": str(cpus),
        "spark.driver.memory": memory, "spark.log.structuredLogging.enabled": "false",
    }.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
