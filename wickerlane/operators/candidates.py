"""The candidate table: every source's ranked articles per target customer, and merges of them."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickerlane.operators import history, popularity
from wickerlane.operators.temporal import before, lookback
from wickerlane.workspace import materialize, release

COLUMNS = ("customer_id", "article_id", "source", "source_rank", "source_score")


def as_source(ranked: DataFrame, name: str, score: str | None = None) -> DataFrame:
    """Canonical candidate columns; without ``score`` it is the reciprocal rank."""
    return ranked.select("customer_id", *_described(name, score))


def _described(name: str, score: str | None = None) -> list[Column | str]:
    value = F.col(score) if score else F.lit(1.0) / F.col("rank")
    return ["article_id", F.lit(name).alias("source"), F.col("rank").cast("int").alias("source_rank"), value.cast("double").alias("source_score")]


def for_everyone(ranking: DataFrame, targets: DataFrame) -> DataFrame:
    """A global list, already cut to k rows, given to each target: a hash join on a constant with k rows broadcast."""
    return targets.select("customer_id", F.lit(1).alias("all_")).join(F.broadcast(ranking.withColumn("all_", F.lit(1))), "all_").drop("all_")


def repeat_source(tx: DataFrame, cutoff: dt.date, targets: DataFrame, k: int, state: DataFrame | None = None) -> DataFrame:
    return as_source(popularity.repeats(tx, cutoff, targets, k, state), "repeat")


def recent_source(tx: DataFrame, cutoff: dt.date, targets: DataFrame, k: int, days: int = 7, name: str = "recent_popularity") -> DataFrame:
    return as_source(for_everyone(popularity.top(popularity.article_stats(lookback(tx, cutoff, days)), k), targets), name)


def all_time_source(tx: DataFrame, cutoff: dt.date, targets: DataFrame, k: int, state: DataFrame | None = None) -> DataFrame:
    stats = popularity.article_stats(before(tx, cutoff)) if state is None else popularity.stats_of_state(state)
    return as_source(for_everyone(popularity.top(stats, k), targets), "all_time_popularity")


def co_visitation_source(tx: DataFrame, cutoff: dt.date, targets: DataFrame, k: int, **options) -> DataFrame:
    return as_source(history.co_visitation(tx, cutoff, targets, k, **options), "co_visitation", "score")


def seasonal_source(tx: DataFrame, cutoff: dt.date, targets: DataFrame, k: int, **options) -> DataFrame:
    return as_source(for_everyone(popularity.seasonal(tx, cutoff, most=k, **options), targets), "seasonal_popularity", "score")


def segment_source(tx: DataFrame, cutoff: dt.date, targets: DataFrame, segments: DataFrame, k: int, days: int = 7) -> DataFrame:
    ranked = popularity.segment_popularity(tx, cutoff, segments, days, k)
    mine = segments.join(targets.select("customer_id"), "customer_id", "left_semi")
    return as_source(mine.join(ranked, "segment"), "age_segment_popularity", "score")


def affinity_source(tx: DataFrame, cutoff: dt.date, targets: DataFrame, attributes: DataFrame, k: int, name: str, **options) -> DataFrame:
    return as_source(history.attribute_affinity(tx, cutoff, targets, attributes, k, **options), name, "score")


def union(parts: list[DataFrame]) -> DataFrame:
    """UNION ALL of candidate tables; scores that only some have are 0.0 in the others.

    ``spark.sql.unionOutputPartitioning`` is set to false in the session: Spark counts on parts that are partitioned alike
    staying so, but with adaptive execution one may change when it runs, and what follows then meets unequal partitions.
    """
    parts[0].sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    extra = [c for c in out.columns if c not in COLUMNS]
    return out.fillna(0.0, subset=extra) if extra else out


class Parts(NamedTuple):
    """The sources of a cutoff: candidates of single customers, lists that all ``targets`` get, lists of their ``segments``.

    Lists have ``article_id, source, source_rank, source_score``, those of segments ``segment`` too.
    """

    own: list[DataFrame]
    targets: DataFrame
    common: list[DataFrame]
    segments: DataFrame
    by_segment: DataFrame

    def rows(self) -> DataFrame:
        """One candidate table."""
        mine = self.segments.join(self.targets, "customer_id", "left_semi").join(self.by_segment, "segment").select(*COLUMNS)
        return union([*self.own, *[for_everyone(x, self.targets).select(*COLUMNS) for x in self.common], mine])

    def by_customer(self) -> DataFrame:
        """``rows`` in partitions by customer: only single customers' candidates and one row for each list a target gets are
        exchanged; the lists, which are short, are broadcast and expanded afterwards."""
        listed, spark = COLUMNS[1:], self.targets.sparkSession
        key = F.concat(F.lit("of "), F.col("segment"))
        marks = [self.targets.select("customer_id", F.lit("all").alias("key_"))]
        marks += [self.segments.join(self.targets, "customer_id", "left_semi").select("customer_id", key.alias("key_")).where("key_ IS NOT NULL")]
        lists = [x.select(F.lit("all").alias("key_"), *listed) for x in self.common] + [self.by_segment.select(key.alias("key_"), *listed)]
        lists = reduce(DataFrame.unionByName, lists).groupBy("key_").agg(F.collect_list(F.struct(*listed)).alias("list_"))
        sent = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [*self.own, *marks])
        sent = sent.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "customer_id")
        met = sent.join(F.broadcast(lists), "key_", "left")
        return met.select("customer_id", F.inline(F.when(F.col("key_").isNull(), F.array(F.struct(*listed))).otherwise(F.col("list_"))))


def every_source(tx: DataFrame, cutoff: dt.date, targets: DataFrame, *options, **named) -> DataFrame:
    """The relational sources (``source_parts``) as one candidate table."""
    return source_parts(tx, cutoff, targets, *options, **named).rows()


def source_parts(tx: DataFrame, cutoff: dt.date, targets: DataFrame, segments: DataFrame, garment: DataFrame, product: DataFrame, k: int = 12, days: int = 7, short: tuple[int, ...] = (1, 3)) -> Parts:
    """The relational sources of a cutoff.

    The log is read and exchanged once, by customer, into a state per pair that is written, and read once more for the rows
    of the last ``days`` days alone, which are written too: the three short lists, the segments and the affinities come from
    these, all sources that look further back from the state. Lists that take exchanges of their own are written as they
    are made, one after the other, in the order of the customers, so that the files of one exchange are gone when the next
    begins; tables that nothing reads any more are removed. Only the seasonal window has a scan of its own.
    """
    targets = materialize(targets.select("customer_id"), "targets")
    state = materialize(popularity.personal_state(tx, cutoff, targets), "purchase-state")
    recent = materialize(lookback(tx, cutoff, max(days, *short)).select("customer_id", "article_id", "t_dat"), "recent-rows")
    mine = state.where("target")
    near = materialize(history.neighbours(history.pair_counts(state.where("position <= 8"))), "neighbours")
    covis = materialize(history.co_visitation_scores(mine.where("position <= 8"), near, k, digits=history.ten_digits(near)), "co-visitation")
    release(near)
    values = materialize(history.recent_values(mine, {"garment": garment, "product": product}), "recent-values")

    def affinity(kind: str, attributes: DataFrame, name: str) -> DataFrame:
        popular = materialize(popularity.log_popularity(lookback(recent, cutoff, days).join(attributes, "article_id"), ["value"], k), "value-lists")
        scores = materialize(history.value_scores(values.where(F.col("kind") == kind), popular, k), "affinity")
        release(popular)
        return as_source(scores, name, "score")

    def newest(n: int, name: str) -> DataFrame:
        return popularity.top(popularity.article_stats(lookback(recent, cutoff, n)), k).select(*_described(name))

    own = [as_source(mine.where(F.col("rank") <= k), "repeat"), as_source(covis, "co_visitation", "score")]
    own += [affinity("garment", garment, "garment_group_popularity"), affinity("product", product, "product_code_popularity")]
    release(values)
    common = [newest(days, "recent_popularity"), *[newest(n, f"recent_popularity_{n}d") for n in short]]
    common += [materialize(popularity.top(popularity.stats_of_state(state), k), "all-time").select(*_described("all_time_popularity"))]
    common += [popularity.seasonal(tx, cutoff, most=k).select(*_described("seasonal_popularity", "score"))]
    by_segment = popularity.segment_popularity(recent, cutoff, segments, days, k).select("segment", *_described("age_segment_popularity", "score"))
    return Parts(own, targets, common, segments, by_segment)


def merge_ranked(candidates: DataFrame, priority: list[str], k: int) -> DataFrame:
    """``customer_id, article_id, pos``: the sources' lists one after the other, first occurrence kept, cut to ``k``."""
    rank = F.create_map(*[x for i, s in enumerate(priority) for x in (F.lit(s), F.lit(i))])[F.col("source")]
    known = candidates.where(F.col("source").isin(priority)).withColumn("place", F.struct(rank.alias("source"), F.col("source_rank").alias("rank")))
    first = known.groupBy("customer_id", "article_id").agg(F.min("place").alias("place"))
    pos = F.row_number().over(Window.partitionBy("customer_id").orderBy("place", "article_id"))
    return first.withColumn("pos", pos).where(F.col("pos") <= k).select("customer_id", "article_id", "pos")


def source_counts(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
