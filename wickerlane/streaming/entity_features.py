"""One row per entity from an event stream, kept by stateful aggregation and upserted after each batch."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wickerlane.functions.text import ratio
from wickerlane.sources.layered import UpsertedTable
from wickerlane.workspace import children, filesystem

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class EntityFeatures:
    """Counts, totals, means, first and last day per entity, in all, by event type and by trailing period.

    The streaming state holds, per entity, type and day, the number of events and values and the total, in the executors'
    state stores with their checkpoint on shared storage. Each batch emits the full counters it touched, which replace
    these rows in a table bucketed by entity (one layer a batch, see ``UpsertedTable``). The feature rows of all entities
    come from that table without an exchange, for any day ``as_of``: the day may move on while the state stays. Hundreds of
    types cost rows only where an entity has them; the columns of the result are those of ``kinds``.

    ``periods`` are days that end with ``as_of``. Defined cases: rows with a null entity do not count; a null type
    counts in the totals over all types only; a null day counts outside periods only; a null value counts as a row but
    in no total or mean; means are null where no value is; events after ``as_of`` are left out; an empty source
    gives an empty table; other columns are ignored.
    """

    KEYS = ("entity", "kind", "day")

    def __init__(self, entity: str, day: str, kind: str, value: str, kinds: list, periods: tuple[int, ...] = (7, 30, 90)):
        if any(p < 1 for p in periods):
            raise ValueError("periods must be positive")
        self.entity, self.day, self.kind, self.value, self.kinds, self.periods = entity, day, kind, value, kinds, periods

    def counters(self, events: DataFrame) -> DataFrame:
        """``entity, kind, day, n, v, s``: the mergeable counters, over a batch or a stream."""
        c = lambda name: F.col(f"`{name}`")
        rows = events.select(c(self.entity).alias("entity"), c(self.kind).alias("kind"), c(self.day).cast("date").alias("day"), c(self.value).alias("value"))
        aggs = [F.count(F.lit(1)).alias("n"), F.count("value").alias("v"), F.sum("value").alias("s")]
        return rows.where(F.col("entity").isNotNull()).groupBy(*self.KEYS).agg(*aggs)

    def features(self, counters: DataFrame, as_of: dt.date) -> DataFrame:
        """One full row per entity from its counters, as of a day.

        The periods are summed per entity and type first, so the work per row does not grow with the number of types; an
        entity's types then come together in a map, from which the columns of ``kinds`` are taken. All of it stays in
        the partition of the entity.
        """
        rows, spans = counters.where(F.col("day").isNull() | (F.col("day") <= F.lit(as_of))), [None, *self.periods]
        inside = lambda p: F.lit(True) if p is None else F.col("day") > F.lit(as_of - dt.timedelta(days=p))
        sums = [f"{c}{p or ''}" for p in spans for c in ("n", "v", "s")]
        per = rows.groupBy("entity", "kind").agg(
            *[F.sum(F.when(inside(p), F.col(c))).alias(f"{c}{p or ''}") for p in spans for c in ("n", "v", "s")], F.min("day").alias("first"), F.max("day").alias("last")
        )
        own = F.when(F.col("kind").isin(self.kinds), F.struct("kind", F.struct(*sums, "first", "last").alias("cell"))) if self.kinds else F.lit(None)
        one = per.groupBy("entity").agg(
            *[F.sum(c).alias(c) for c in sums], F.min("first").alias("first"), F.max("last").alias("last"), *([F.map_from_entries(F.collect_list(own)).alias("kinds")] if self.kinds else [])
        )
        named = [("all", lambda c: F.col(c)), *((f"type{k}", lambda c, k=k: F.col("kinds")[k].getField(c)) for k in self.kinds)]
        out, days = [F.col("entity").alias(self.entity)], []
        for name, get in named:
            for p in spans:
                cell, n, v, total = f"{name}_{p}d" if p else name, *(get(f"{c}{p or ''}") for c in ("n", "v", "s"))
                total = F.coalesce(total.cast("double"), F.lit(0.0))
                out += [F.coalesce(n, F.lit(0)).alias(f"n_{cell}"), total.alias(f"total_{cell}"), F.when(v > 0, ratio(total, v)).alias(f"mean_{cell}")]
            days += [F.datediff(F.lit(as_of), get(x)).alias(f"days_since_{x}_{name}") for x in ("first", "last")]
        return one.select(*out, *days)

    def run(self, spark: SparkSession, stream: DataFrame, path: str, checkpoint: str, as_of: dt.date) -> DataFrame:
        """Drain what the stream has now and return the feature rows as of a day. The same path and checkpoint go on."""
        counters = self.counters(stream)
        store = UpsertedTable(spark, path, counters.schema, list(self.KEYS), ["entity"])
        drain_into(store, counters, checkpoint)
        return self.features(store.read(), as_of)


def drain_into(store: UpsertedTable, counters: DataFrame, checkpoint: str) -> None:
    """Run a stream of aggregates over what it has now; each batch's changed rows are upserted, once."""
    spark = counters.sparkSession
    settings = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.minBatchesToRetain": "2"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        writer = counters.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
        writer.foreachBatch(lambda batch, epoch: store.upsert(batch, checkpoint, epoch) and None).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def parquet_stream(spark: SparkSession, path: str, batches: int = 3) -> DataFrame:
    """A parquet table (a folder of files, or one file) as a stream of about ``batches`` batches."""
    schema: T.StructType = spark.read.parquet(path).schema
    fs, target = filesystem(spark, path)
    if not fs.getFileStatus(target).isDirectory():  # the file source lists folders only
        parent, name = path.rsplit("/", 1)
        return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(parent)
    files = [p for p in children(spark, path) if p.endswith(".parquet")]
    per = max(1, -(-len(files) // batches))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per).parquet(path)
