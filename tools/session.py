"""A local session for tests, comparisons and the bench."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: str = "8", partitions: str = "8") -> SparkSession:
    os.environ.setdefault("TZ", "UTC")
    made = tempfile.mkdtemp(prefix="wickerlane-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("wickerlane")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", f"{made}/warehouse")
        .config("spark.checkpoint.dir", f"file://{made}/shared")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
