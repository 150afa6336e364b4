"""Running sums over a whole table without a window over everything."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wickerlane.workspace import materialize


def running_sums(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """``df`` with ``name``, the sum of ``value`` over all rows before by ``key`` (unique), without a window over everything.

    Rows are range-partitioned and summed within partitions; the offsets of the partitions come from their sums, of which
    there are as many as partitions.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(df.repartitionByRange(parts, key).withColumn("part_", F.spark_partition_id()), "running-sums")
    starts, at = [], 0
    for r in rows.groupBy("part_").agg(F.sum(value).alias("s"), F.min(key).alias("low")).orderBy("low").collect():
        starts.append((r["part_"], at))
        at += r["s"] or 0
    offsets = df.sparkSession.createDataFrame(starts, "part_ int, offset_ bigint")
    before_ = F.coalesce(F.sum(value).over(Window.partitionBy("part_").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(F.broadcast(offsets), "part_").withColumn(name, F.col("offset_") + before_).drop("part_", "offset_")
