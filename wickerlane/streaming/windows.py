"""Event counts in time windows over a stream, with late events up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wickerlane.sources.layered import UpsertedTable
from wickerlane.streaming.entity_features import drain_into


def windowed_counts(stream: DataFrame, time: str, kind: str, value: str, length: str = "1 day", late: str = "7 days") -> DataFrame:
    """``window_start, <kind>, n, total`` per tumbling window; on a stream, windows close ``late`` after the newest event."""
    rows = stream.withColumn("time_", F.col(time).cast("timestamp")).withWatermark("time_", late)
    return rows.groupBy(F.window("time_", length).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), kind, "n", "total")


def drain(spark: SparkSession, counts: DataFrame, keys: list[str], path: str) -> DataFrame:
    """Run a stream of aggregates over what it has now, its changed rows upserted by key. The same path goes on."""
    store = UpsertedTable(spark, f"{path}/windows", counts.schema, keys)
    drain_into(store, counts, f"{path}/checkpoint")
    return store.read()
