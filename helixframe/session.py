"""Session construction shared by the entry points, the bench and the tests."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "helixframe", cores: int | None = None, extra: dict[str, str] | None = None) -> SparkSession:
    """A local session with the settings that a cluster submit would carry.

    On a cluster the master, memory and checkpoint folder come from spark-submit; nothing here overrides
    values that are already set there, because ``getOrCreate`` returns the running session.
    """
    n = cores or os.cpu_count() or 8
    builder = SparkSession.builder.appName(app).master(f"local[{n}]")
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.shuffle.partitions": str(max(8, n)),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | (extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
