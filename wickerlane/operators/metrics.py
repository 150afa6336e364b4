"""Ranking metrics and diagnostics over long tables of predictions and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickerlane.operators.running import running_sums


def per_customer(predictions: DataFrame, found: DataFrame, k: int = 12) -> DataFrame:
    """``customer_id, labels, hits, ap, recall`` of every labelled customer at ``k``.

    ``predictions`` are ``customer_id, article_id, pos``; a repeated article takes its slots but is credited once, at the
    first. A customer without predictions scores 0.
    """
    if k < 1:
        raise ValueError("k must be positive")
    cut = predictions.where(F.col("pos") <= k).groupBy("customer_id", "article_id").agg(F.min("pos").alias("pos"))
    hit = cut.join(found, ["customer_id", "article_id"], "left_semi")
    sofar = F.count(F.lit(1)).over(Window.partitionBy("customer_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    won = hit.withColumn("precision", sofar / F.col("pos")).groupBy("customer_id").agg(F.sum("precision").alias("won"), F.count(F.lit(1)).alias("hits"))
    size = found.groupBy("customer_id").agg(F.count_distinct("article_id").alias("labels"))
    out = size.join(won, "customer_id", "left")
    hits = F.coalesce("hits", F.lit(0))
    return out.select("customer_id", "labels", hits.alias("hits"), (F.coalesce("won", F.lit(0.0)) / F.least("labels", F.lit(k))).alias("ap"), (hits / F.col("labels")).alias("recall"))


def summary(scores: DataFrame) -> DataFrame:
    """``customers, map, recall`` (0.0 without customers)."""
    return scores.agg(F.count(F.lit(1)).alias("customers"), F.coalesce(F.avg("ap"), F.lit(0.0)).alias("map"), F.coalesce(F.avg("recall"), F.lit(0.0)).alias("recall"))


def _cumulated(counts: DataFrame, value: str) -> DataFrame:
    """``v, f, upto, all``: each distinct value, how often it and how often values up to it occur, and the number of rows."""
    freq = counts.groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("f"))
    run = running_sums(freq, "v", "f", "ahead")
    return run.withColumn("upto", F.col("ahead") + F.col("f")).join(F.broadcast(run.agg(F.sum("f").alias("all"))), F.lit(True))


def distribution(counts: DataFrame, value: str = "n", shares: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """Nearest-rank percentiles as ``minimum, p50, …, maximum, mean`` in one row; nothing is sorted on one node.

    Values are counted first; the running count then goes over distinct values only.
    """
    run = _cumulated(counts, value)
    at = [F.min(F.when(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("all"))), F.col("v"))).alias(f"p{round(p * 100)}") for p in shares]
    return run.agg(F.min("v").alias("minimum"), *at, F.max("v").alias("maximum"), (F.sum(F.col("v") * F.col("f")) / F.sum("f")).alias("mean"))


def rounded_index_percentiles(counts: DataFrame, value: str, percents: tuple[int, ...]) -> DataFrame:
    """Percentiles at the half-even rounded index p (n - 1), one row each: ``percent, value``."""
    run = _cumulated(counts, value)
    each = run.withColumn("percent", F.explode(F.array(*[F.lit(p) for p in percents])))
    index = F.bround(F.col("percent") / 100.0 * (F.col("all") - 1), 0)
    return each.where(F.col("upto") > index).groupBy("percent").agg(F.min("v").alias("value"))


def history_bucket(n: Column) -> Column:
    return F.when(n == 0, "0").when(n <= 2, "1-2").when(n <= 10, "3-10").otherwise("11+")


def by_history(scores: DataFrame, depth: DataFrame) -> DataFrame:
    """MAP and recall by the number of earlier purchases (``customer_id, n``); empty buckets come out as 0."""
    spark = scores.sparkSession
    every = spark.createDataFrame([(b,) for b in ("0", "1-2", "3-10", "11+")], "bucket string")
    named = scores.join(depth, "customer_id", "left").withColumn("bucket", history_bucket(F.coalesce("n", F.lit(0))))
    sums = named.groupBy("bucket").agg(F.count(F.lit(1)).alias("customers"), F.avg("ap").alias("map"), F.avg("recall").alias("recall"))
    zero = F.lit(0.0)
    return every.join(sums, "bucket", "left").select("bucket", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("map", zero).alias("map"), F.coalesce("recall", zero).alias("recall"))


def coverage(predictions: DataFrame, customers: DataFrame, k: int = 12) -> DataFrame:
    """One row on the shape of predictions: customers with any and with k, rows, repeated rows, distinct articles."""
    per = predictions.groupBy("customer_id").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("article_id").alias("articles"))
    full = customers.select("customer_id").distinct().join(per, "customer_id", "left").fillna(0)
    shape = full.agg(
        F.count(F.lit(1)).alias("customers"), F.count_if(F.col("rows") > 0).alias("with_any"), F.count_if(F.col("rows") >= k).alias("with_k"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("rows") - F.col("articles")), F.lit(0)).alias("repeated_rows"),
    )
    return shape.join(F.broadcast(predictions.agg(F.count_distinct("article_id").alias("articles"))), F.lit(True))


def ceiling(candidates: DataFrame, found: DataFrame, k: int = 12) -> DataFrame:
    """What a perfect ranker could reach with these candidates: mean oracle MAP and recall, label coverage."""
    have = candidates.select("customer_id", "article_id").distinct()
    reach = have.join(found, ["customer_id", "article_id"], "left_semi").groupBy("customer_id").agg(F.count(F.lit(1)).alias("reach"))
    size = found.groupBy("customer_id").agg(F.count(F.lit(1)).alias("labels"))
    there = have.groupBy("customer_id").agg(F.count(F.lit(1)).alias("candidates"))
    per = size.join(reach, "customer_id", "left").join(there, "customer_id", "left").fillna(0)
    cut = F.least("reach", F.lit(k))
    return per.agg(
        F.count(F.lit(1)).alias("customers"), F.count_if(F.col("candidates") > 0).alias("with_candidates"), F.avg(cut / F.least("labels", F.lit(k))).alias("oracle_map"),
        F.avg(cut / F.col("labels")).alias("oracle_recall"), (F.sum("reach") / F.sum("labels")).alias("label_coverage"), F.avg("candidates").alias("mean_candidates"),
    )
