"""Final predictions for the whole universe, as text rows in a given order."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickerlane.operators import candidates as c
from wickerlane.operators import popularity
from wickerlane.operators.candidates import merge_ranked, union
from wickerlane.operators.temporal import before, lookback


def final_cutoff(tx: DataFrame) -> dt.date:
    """The day after the last transaction."""
    return popularity.last_day(tx) + dt.timedelta(days=1)


def backfilled(ranked: DataFrame, tx: DataFrame, cutoff: dt.date, customers: DataFrame, k: int = 12, days: int = 7) -> DataFrame:
    """``customer_id, article_id, pos``: the ranker's lists, then recent, then all-time popularity, up to ``k``."""
    own = c.as_source(ranked.withColumnRenamed("pos", "rank"), "ranker")
    parts = [own, c.recent_source(tx, cutoff, customers, k, days), c.all_time_source(tx, cutoff, customers, k)]
    return merge_ranked(union(parts), ["ranker", "recent_popularity", "all_time_popularity"], k)


def baseline_predictions(tx: DataFrame, cutoff: dt.date, customers: DataFrame, k: int = 12, days: int = 7) -> DataFrame:
    return backfilled(popularity.repeats(tx, cutoff, customers, k).withColumnRenamed("rank", "pos"), tx, cutoff, customers, k, days)


def as_text(predictions: DataFrame, customers: DataFrame) -> DataFrame:
    """``customer_id, prediction`` for every customer; no prediction gives an empty text. Lists are bounded by k."""
    lists = predictions.groupBy("customer_id").agg(F.array_sort(F.collect_list(F.struct("pos", "article_id"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x["article_id"]), " ")
    return customers.join(lists, "customer_id", "left").withColumn("prediction", F.coalesce(text, F.lit(""))).drop("l")


def backfilled_text(ranked: DataFrame, tx: DataFrame, cutoff: dt.date, customers: DataFrame, k: int = 12, days: int = 7) -> DataFrame:
    """``as_text`` of ``backfilled``; the two popularity lists are one row that every customer's own list is filled up from."""
    first = lambda stats, name: popularity.top(stats, k).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "article_id"))), lambda x: x["article_id"]).alias(name))
    fill = first(popularity.article_stats(lookback(tx, cutoff, days)), "recent_").crossJoin(first(popularity.article_stats(before(tx, cutoff)), "all_"))
    own = ranked.groupBy("customer_id").agg(F.array_sort(F.collect_list(F.struct("pos", "article_id"))).alias("own_"))
    mine = F.coalesce(F.transform("own_", lambda x: x["article_id"]), F.array().cast("array<string>"))
    every = customers.join(own, "customer_id", "left").crossJoin(F.broadcast(fill))
    return every.select(*customers.columns, F.array_join(F.slice(F.array_distinct(F.concat(mine, "recent_", "all_")), 1, k), " ").alias("prediction"))


def write_submission(rows: DataFrame, order: str, path: str, most: int = 12) -> None:
    """One CSV file in the order of a column; more than ``most`` or repeated articles raise while writing."""
    ids = F.filter(F.split("prediction", " "), lambda x: x != "")
    bad = (F.size(ids) > most) | (F.size(F.array_distinct(ids)) < F.size(ids))
    checked = rows.withColumn("prediction", F.when(bad, F.raise_error(F.concat(F.lit("bad prediction of "), "customer_id")).cast("string")).otherwise(F.col("prediction")))
    # A range sort orders in parallel; the one file the format asks for is joined at the end.
    checked.orderBy(order).select("customer_id", "prediction").coalesce(1).write.mode("overwrite").csv(path, header=True, quote="\u0000")


def write_candidates(rows: DataFrame, path: str) -> None:
    """Candidate rows as CSV with scores of ten significant digits (parquet is the exact form)."""
    extra = [x for x in rows.columns if x not in c.COLUMNS]
    rows.select("customer_id", "article_id", "source", "source_rank", *[F.format_string("%.10g", F.col(x).cast("double")).alias(x) for x in ("source_score", *extra)]).write.mode("overwrite").csv(path, header=True)


OPTIONAL = ("two_tower_score", "content_user_cosine")


def read_candidates(spark, path: str) -> DataFrame:
    """Candidate CSV; the header must be the canonical columns, then optional ones in their order. Missing ones are 0.0."""
    df = spark.read.csv(path, header=True)
    head, tail = df.columns[: len(c.COLUMNS)], df.columns[len(c.COLUMNS) :]
    if tuple(head) != c.COLUMNS or [x for x in OPTIONAL if x in tail] != list(tail):
        raise ValueError(f"{path}: columns {df.columns}")
    typed = df.select("customer_id", "article_id", "source", F.col("source_rank").cast("int"), *[F.col(x).cast("double").alias(x) for x in ("source_score", *tail)])
    return typed.withColumns({x: F.lit(0.0) for x in OPTIONAL if x not in tail})
