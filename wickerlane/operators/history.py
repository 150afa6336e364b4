"""Bounded newest-first histories, item neighbours and what is derived from them."""

from __future__ import annotations

import datetime as dt
from math import lcm

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wickerlane.operators.popularity import log_popularity, top_by
from wickerlane.operators.temporal import before, lookback


def recent_unique(tx: DataFrame, key: str = "article_id", most: int = 8) -> DataFrame:
    """``customer_id, key, position``: each customer's last ``most`` distinct values, the newest at 1.

    Newest is by ``seq``, the order of the log; a value seen again moves to the front.
    """
    if most < 1:
        raise ValueError("most must be positive")
    last = tx.groupBy("customer_id", key).agg(F.max("seq").alias("seq"))
    place = F.row_number().over(Window.partitionBy("customer_id").orderBy(F.desc("seq")))
    return last.withColumn("position", place).where(F.col("position") <= most).select("customer_id", key, "position")


def pair_counts(history: DataFrame) -> DataFrame:
    """``article_id, other_id, n``: in how many histories both stand. The bound on histories bounds the pairs."""
    other = history.select("customer_id", F.col("article_id").alias("other_id"))
    both = history.select("customer_id", "article_id").join(other, "customer_id").where(F.col("article_id") != F.col("other_id"))
    return both.groupBy("article_id", "other_id").agg(F.count(F.lit(1)).alias("n"))


def neighbours(counts: DataFrame, most: int = 100) -> DataFrame:
    """The ``most`` most frequent others of each article, with ``rank``."""
    return top_by(counts, ["article_id"], most, ("n desc", "other_id"))


def co_visitation(tx: DataFrame, cutoff: dt.date, targets: DataFrame, k: int = 12, history_items: int = 8, neighbour_items: int = 100, state: DataFrame | None = None) -> DataFrame:
    """``customer_id, article_id, score, rank``: neighbours of the history, each counted over its history position.

    Scores are summed as whole multiples of 1 / lcm(1..history_items), so equal scores are exactly equal. ``state`` is a
    ``purchase_state`` of the same cutoff, if there is one.
    """
    history = recent_unique(before(tx, cutoff) if state is None else state, most=history_items)
    near = neighbours(pair_counts(history), neighbour_items)
    return co_visitation_scores(history.join(targets.select("customer_id"), "customer_id", "left_semi"), near, k, history_items)


def ten_digits(near: DataFrame) -> bool:
    """Whether all ids of a written table of neighbours are ten digits, so that numbers have the same order and give them back."""
    return near.where(~F.col("other_id").rlike(r"\A[0-9]{10}\z")).isEmpty()


def neighbour_lists(near: DataFrame) -> DataFrame:
    """``article_id, others, counts``: one row an article, in the order of ``rank``, which has no gaps."""
    one = F.array_sort(F.collect_list(F.struct("rank", "other_id", "n"))).alias("l")
    return near.groupBy("article_id").agg(one).select("article_id", F.col("l.other_id").alias("others"), F.col("l.n").alias("counts"))


def co_visitation_scores(history: DataFrame, near: DataFrame, k: int | None, history_items: int = 8, digits: bool = False) -> DataFrame:
    """Customers are dealt into parts, and each part gets the neighbours of the articles it holds, once for all its customers.

    So what a history meets (up to ``neighbour_items`` rows for each of its articles) is summed where it is made. The join
    reuses the partitioning by part, for which ``spark.sql.requireAllClusterKeysForCoPartition`` is set to false in the session.
    Neighbours (of ``neighbours``) travel as one row an article, as numbers if they are ``ten_digits``. Keys that differ within
    a part come first, since sorting compares by the first one's prefix.
    """
    spark = history.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    unit, parts = lcm(*range(1, history_items + 1)), int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = part_names(spark, parts)
    part = F.element_at(F.array(*[F.lit(x) for x in names]), F.pmod(F.xxhash64("customer_id"), F.lit(len(names))).cast("int") + 1)
    mine = history.select(part.alias("part_"), "customer_id", "article_id", "position")
    lists = neighbour_lists(near.withColumn("other_id", F.col("other_id").cast("bigint")) if digits else near)
    sent = mine.select("part_", "article_id").distinct().join(lists, "article_id")
    met = mine.repartition(parts, "part_").join(sent.repartition(parts, "part_").hint("merge"), ["article_id", "part_"])
    each = met.select("customer_id", "part_", (F.lit(unit) / F.col("position")).cast("bigint").alias("weight"), "counts", F.posexplode("others").alias("near_rank", "other_id"))
    sums = each.groupBy("customer_id", "part_", F.col("other_id").alias("article_id")).agg(F.sum(F.get("counts", "near_rank") * F.col("weight")).alias("units"), F.min("near_rank").alias("near_rank"))
    ranked = top_by(sums, ["customer_id", "part_"], k, ("units desc", "near_rank", "article_id"))
    article = F.lpad(F.col("article_id").cast("string"), 10, "0").alias("article_id") if digits else F.col("article_id")
    return ranked.select("customer_id", article, (F.col("units") / unit).alias("score"), "rank")


def part_names(spark, parts: int) -> list[int]:
    """Numbers that hash partitioning sends to different partitions, one to each."""
    home = F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts))
    return sorted(r["name"] for r in spark.range(0, 50 * parts, 1, 1).groupBy(home.alias("home")).agg(F.min(F.col("id").cast("int")).alias("name")).collect())


def co_visitation_coverage(history: DataFrame, near: DataFrame, k: int = 12) -> DataFrame:
    """Per customer how many distinct candidates there are, and how many fit in ``k``."""
    met = history.join(near.select("article_id", "other_id"), "article_id")
    return met.groupBy("customer_id").agg(F.count_distinct("other_id").alias("candidates")).withColumn("kept", F.least("candidates", F.lit(k)))


def attribute_affinity(
    tx: DataFrame, cutoff: dt.date, targets: DataFrame, attributes: DataFrame, k: int = 12, lookback_days: int = 7, history_values: int = 8, most_per_value: int | None = None, state: DataFrame | None = None
) -> DataFrame:
    """Articles popular within the attribute values of a customer's history, over the value's position in it.

    ``attributes`` has ``article_id, value``; transactions of unknown articles are skipped. The bound counts values.
    """
    past = (before(tx, cutoff) if state is None else state).join(attributes, "article_id")
    popular = log_popularity(lookback(tx, cutoff, lookback_days).join(attributes, "article_id"), ["value"], most_per_value)
    mine = recent_unique(past.join(targets.select("customer_id"), "customer_id", "left_semi"), "value", history_values)
    # A customer's list is complete once each value has given its first k articles.
    met = mine.join(popular.where(F.col("rank") <= k).select("value", "article_id", "score"), "value")
    best = met.groupBy("customer_id", "article_id").agg(F.round(F.max(F.col("score") / F.col("position")), 9).alias("score"))
    return top_by(best, ["customer_id"], k, ("score desc", "article_id"))


def recent_values(state: DataFrame, attributes: dict[str, DataFrame], most: int = 8) -> DataFrame:
    """``customer_id, kind, value, position``: each customer's last ``most`` values of every attribute (kind: its name).

    The state (``customer_id, article_id, seq``) is exchanged once by article for all attributes, and once by customer.
    """
    rows = state.select("customer_id", "article_id", "seq")
    for name, values in attributes.items():
        rows = rows.join(values.select("article_id", F.col("value").alias(f"value_{name}")), "article_id", "left")
    rows = rows.drop("article_id").repartition("customer_id")
    each = F.array(*[F.struct(F.lit(name).alias("kind"), F.col(f"value_{name}").alias("value")) for name in attributes])
    last = rows.select("customer_id", "seq", F.inline(each)).where(F.col("value").isNotNull()).groupBy("customer_id", "kind", "value").agg(F.max("seq").alias("seq"))
    return top_by(last, ["customer_id", "kind"], most, ("seq desc",)).select("customer_id", "kind", "value", F.col("rank").alias("position"))


#: A list of so many rows at most is broadcast.
SHORT = 10_000


def value_scores(mine: DataFrame, popular: DataFrame, k: int = 12) -> DataFrame:
    """``attribute_affinity`` from the values of each customer (``customer_id, value, position``) and the lists of the values.

    ``popular`` is written already; a short one goes to where the customers are, otherwise what the values meet goes there.
    """
    lists = popular.where(F.col("rank") <= k).select("value", "article_id", "score")
    # A number of partitions is named, since few and small rows become many: joined by size they would spill.
    parts = int(mine.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = mine.repartition(parts, "customer_id").join(F.broadcast(lists), "value") if lists.limit(SHORT + 1).count() <= SHORT else mine.join(lists, "value").repartition(parts, "customer_id")
    best = met.groupBy("customer_id", "article_id").agg(F.round(F.max(F.col("score") / F.col("position")), 9).alias("score"))
    return top_by(best, ["customer_id"], k, ("score desc", "article_id"))
