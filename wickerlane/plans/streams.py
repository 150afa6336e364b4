"""Registered plan of a stream beyond the general problems: events per day and type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wickerlane.functions.text import settled
from wickerlane.plans.base import query
from wickerlane.streaming.entity_features import parquet_stream
from wickerlane.streaming.windows import drain, windowed_counts
from wickerlane.workspace import scratch


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value) + 1e-9, 4) AS total FROM events GROUP BY 1, 2")
def S1_event_windows(spark: SparkSession, d: str) -> DataFrame:
    counts = windowed_counts(parquet_stream(spark, f"{d}/events.parquet"), "ts", "event_type", "value", late="60 days")
    out = drain(spark, counts, ["window_start", "event_type"], scratch(spark, "windows"))
    return out.select(F.to_date("window_start").alias("day"), "event_type", "n", settled("total", 4).alias("total"))
