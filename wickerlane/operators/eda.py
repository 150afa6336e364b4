"""Descriptive reports of the log, the articles and the customers, as long rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wickerlane.operators.popularity import top_by

ONE = F.lit


def months(tx: DataFrame) -> DataFrame:
    return tx.groupBy(F.date_format("t_dat", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("customer_id").alias("customers"), F.count_distinct("article_id").alias("articles"))


def weekdays(tx: DataFrame) -> DataFrame:
    """Monday is 0."""
    return tx.groupBy(F.weekday("t_dat").alias("weekday")).agg(F.count(F.lit(1)).alias("rows"))


def busiest_days(tx: DataFrame, most: int = 30) -> DataFrame:
    return tx.groupBy("t_dat").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "t_dat").limit(most)


def channels(tx: DataFrame) -> DataFrame:
    """Customers by the share of their purchases made online (channel 2): mostly online (.8), mostly in stores (.2), mixed."""
    share = tx.groupBy("customer_id").agg(F.avg((F.col("sales_channel_id") == 2).cast("double")).alias("s"))
    kind = F.when(F.col("s") >= 0.8, "online").when(F.col("s") <= 0.2, "store").otherwise("mixed")
    return share.where(F.col("s").isNotNull()).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("customers"))


def depth(tx: DataFrame, customers: DataFrame, cold: int = 0, sparse: int = 4) -> DataFrame:
    """Customers of the universe by number of purchases: cold, sparse, dense."""
    n = customers.select("customer_id").distinct().join(tx.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n")), "customer_id", "left")
    n = n.withColumn("n", F.coalesce("n", F.lit(0)))
    kind = F.when(F.col("n") <= cold, "cold").when(F.col("n") <= sparse, "sparse").otherwise("dense")
    return n.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("customers"), F.sum("n").alias("rows"))


def hierarchy(articles: DataFrame, columns: list[str], most: int = 20) -> DataFrame:
    """The most frequent values of each column with the number of distinct ones: ``column, value, n, rank, distinct_values``."""
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit("")).alias("value")) for c in columns])
    counts = articles.select(F.inline(each)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    fan = counts.groupBy("column").agg(F.count(F.lit(1)).alias("distinct_values"))
    return top_by(counts, ["column"], most, ("n desc", "value")).join(F.broadcast(fan), "column")


def article_lifetimes(tx: DataFrame) -> DataFrame:
    return tx.groupBy("article_id").agg((F.datediff(F.max("t_dat"), F.min("t_dat")) + 1).alias("days"), F.count(F.lit(1)).alias("rows"))


def repeat_purchases(tx: DataFrame) -> DataFrame:
    pairs = tx.groupBy("customer_id", "article_id").agg(F.count(F.lit(1)).alias("n"))
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("n") > 1).alias("repeated_pairs"), F.sum("n").alias("rows"), F.max("n").alias("most"))


def gaps(tx: DataFrame) -> DataFrame:
    """Days between successive purchases of the same pair, in bins 0-2, 3-7, 8-14; longer gaps are in none."""
    before = F.lag("t_dat").over(Window.partitionBy("customer_id", "article_id").orderBy("seq"))
    days = tx.select(F.datediff("t_dat", before).alias("g")).where(F.col("g").isNotNull() & (F.col("g") >= 0))
    kind = F.when(F.col("g") <= 2, "0-2").when(F.col("g") <= 7, "3-7").when(F.col("g") <= 14, "8-14")
    return days.groupBy(kind.alias("gap")).agg(F.count(F.lit(1)).alias("rows")).where(F.col("gap").isNotNull())


def customer_metadata(customers: DataFrame) -> DataFrame:
    """``column, value, n`` of nine age buckets and the categorical columns, blanks as ``missing``."""
    age = F.trim("age").try_cast("double")
    bucket = F.when(age.isNull() | (age <= 0), "missing")
    for low, high in ((0, 18), (18, 25), (25, 35), (35, 45), (45, 55), (55, 65), (65, 75)):
        bucket = bucket.when(age < high, f"{low}-{high - 1}")
    cells = [F.struct(F.lit("age").alias("column"), bucket.otherwise("75+").alias("value"))]
    for c in ("fn", "active", "club_member_status", "fashion_news_frequency"):
        cells.append(F.struct(F.lit(c).alias("column"), F.when(F.trim(F.coalesce(c, F.lit(""))) == "", "missing").otherwise(F.trim(c)).alias("value")))
    return customers.select(F.inline(F.array(*cells))).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
