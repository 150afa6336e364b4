"""Popularity and repeat purchases: counts with recency, ranked with every tie broken."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickerlane.operators.temporal import before, lookback, shifted

BY_COUNT = ("n desc", "last_day desc", "article_id")


def order(keys: tuple[str, ...]) -> list[Column]:
    return [F.desc(k[:-5]) if k.endswith(" desc") else F.asc(k) for k in keys]


def article_stats(tx: DataFrame) -> DataFrame:
    """``article_id, n, last_day``."""
    return tx.groupBy("article_id").agg(F.count(F.lit(1)).alias("n"), F.max("t_dat").alias("last_day"))


def window_stats(tx: DataFrame, cutoff: dt.date, days: tuple[int, ...] = (1, 3, 7)) -> DataFrame:
    """All-time and windowed counts and last days of each article before the cutoff, in one scan."""
    aggs = [F.count(F.lit(1)).alias("n_all"), F.max("t_dat").alias("last_all")]
    for n in days:
        inside = F.col("t_dat") >= F.lit(cutoff - dt.timedelta(days=n))
        aggs += [F.count_if(inside).alias(f"n_{n}d"), F.max(F.when(inside, F.col("t_dat"))).alias(f"last_{n}d")]
    return before(tx, cutoff).groupBy("article_id").agg(*aggs)


def pair_stats(tx: DataFrame) -> DataFrame:
    """``customer_id, article_id, n, last_day``."""
    return tx.groupBy("customer_id", "article_id").agg(F.count(F.lit(1)).alias("n"), F.max("t_dat").alias("last_day"))


def purchase_state(tx: DataFrame, cutoff: dt.date) -> DataFrame:
    """``customer_id, article_id, n, last_day, seq`` of pairs before the cutoff: what every history-based source needs.

    Counts add up, days and sequences take the greatest, so articles, customers and attribute values roll up from here
    without another pass over the log.
    """
    return before(tx, cutoff).groupBy("customer_id", "article_id").agg(F.count(F.lit(1)).alias("n"), F.max("t_dat").alias("last_day"), F.max("seq").alias("seq"))


def personal_state(tx: DataFrame, cutoff: dt.date, targets: DataFrame) -> DataFrame:
    """``purchase_state`` with ``rank`` (most often bought first), ``position`` (newest first) and ``target`` (whether of ``targets``).

    Rows are exchanged once, by customer; all else stays in the customer's partition.
    """
    rows = before(tx, cutoff).select("customer_id", "article_id", "t_dat", "seq").repartition("customer_id")
    state = rows.groupBy("customer_id", "article_id").agg(F.count(F.lit(1)).alias("n"), F.max("t_dat").alias("last_day"), F.max("seq").alias("seq"))
    own = top_by(state, ["customer_id"], None).withColumn("position", F.row_number().over(Window.partitionBy("customer_id").orderBy(F.desc("seq"))))
    known = targets.select("customer_id").distinct().withColumn("target", F.lit(True))
    return own.join(known, "customer_id", "left").fillna(False, subset=["target"])


def stats_of_state(state: DataFrame) -> DataFrame:
    return state.groupBy("article_id").agg(F.sum("n").alias("n"), F.max("last_day").alias("last_day"))


def top(stats: DataFrame, k: int, keys: tuple[str, ...] = BY_COUNT) -> DataFrame:
    """The first ``k`` rows with ``rank``; each partition sends k rows, so only k reach the last one."""
    if k < 1:
        raise ValueError("k must be positive")
    first = stats.orderBy(*order(keys)).limit(k)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(*order(keys))))


def top_by(stats: DataFrame, groups: list[str], k: int | None, keys: tuple[str, ...] = BY_COUNT) -> DataFrame:
    """``rank`` within groups, up to ``k``."""
    ranked = stats.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*order(keys))))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def repeats(tx: DataFrame, cutoff: dt.date, targets: DataFrame, k: int = 12, state: DataFrame | None = None) -> DataFrame:
    """Each target customer's own articles, most often bought first."""
    who = targets.select("customer_id")
    own = state.join(who, "customer_id", "left_semi").drop("seq") if state is not None else pair_stats(before(tx, cutoff).join(who, "customer_id", "left_semi"))
    return top_by(own, ["customer_id"], k)


def log_popularity(tx: DataFrame, groups: list[str] = (), most: int | None = None) -> DataFrame:
    """``groups, article_id, score, rank`` with score log1p(n) over the greatest of the group; ties by article."""
    counts = tx.groupBy(*groups, "article_id").agg(F.log1p(F.count(F.lit(1))).alias("c"))
    if groups:
        best = F.max("c").over(Window.partitionBy(*groups))
        scored = counts.select(*groups, "article_id", F.round(F.col("c") / best, 9).alias("score"))
        return top_by(scored, list(groups), most, ("score desc", "article_id"))
    # No group: the greatest comes from a one-row aggregate, not from a window over everything.
    one = counts.agg(F.max("c").alias("best"))
    scored = counts.join(F.broadcast(one), F.col("best").isNotNull()).select("article_id", F.round(F.col("c") / F.col("best"), 9).alias("score"))
    if most is not None:
        return top(scored, most, ("score desc", "article_id"))
    return scored


def seasonal(tx: DataFrame, cutoff: dt.date, shift_days: int = 366, window_days: int = 7, most: int = 12) -> DataFrame:
    return log_popularity(shifted(tx, cutoff, shift_days, window_days), most=most)


def segment_popularity(tx: DataFrame, cutoff: dt.date, segments: DataFrame, lookback_days: int = 7, most: int | None = None) -> DataFrame:
    """``segment, article_id, score, rank`` within segments of customers (``customer_id, segment``)."""
    return log_popularity(lookback(tx, cutoff, lookback_days).join(segments, "customer_id"), ["segment"], most)


def age_segments(customers: DataFrame, bucket: int = 10, invalid: str = "raise") -> DataFrame:
    """``customer_id, segment`` such as ``age_30_39``; blank ages are ``age_unknown``.

    Ages that are not whole positive numbers raise, or with ``invalid`` "unknown" count as blank.
    """
    if bucket < 1 or invalid not in ("raise", "unknown"):
        raise ValueError("bucket must be positive and invalid raise or unknown")
    text = F.trim(F.coalesce("age", F.lit("")))
    number = F.when(text.rlike(r"\A[0-9]{1,9}\z"), text.try_cast("int"))
    low = (F.floor(number / bucket) * bucket).cast("int")
    named = F.concat(F.lit("age_"), low.cast("string"), F.lit("_"), (low + bucket - 1).cast("string"))
    other = F.lit("age_unknown") if invalid == "unknown" else F.raise_error(F.concat(F.lit("invalid age: "), text)).cast("string")
    return customers.select("customer_id", F.when(text == "", "age_unknown").when(number > 0, named).otherwise(other).alias("segment"))


def last_day(tx: DataFrame) -> dt.date:
    """The latest transaction day; an empty log raises."""
    day = tx.agg(F.max("t_dat")).first()[0]
    if day is None:
        raise ValueError("there are no transactions")
    return day
