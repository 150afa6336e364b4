"""Diagnostics of candidate sources and of blends of them, and ablations, each in one plan over all variants."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wickerlane.operators import candidates as c
from wickerlane.operators import features as ft
from wickerlane.operators import history, metrics, popularity
from wickerlane.operators.temporal import lookback
from wickerlane.workspace import materialize

REPEAT, RECENT, ALL_TIME, CO_VISITATION = "repeat", "recent_popularity", "all_time_popularity", "co_visitation"
#: Blends: lists one after the other, first occurrence kept; the backfill is recent, then all-time popularity.
BLENDS = {
    "repeat_popularity_blend": (REPEAT, "backfill"),
    "repeat_co_visitation_popularity_blend": (REPEAT, CO_VISITATION, "backfill"),
    "repeat_popularity_co_visitation_blend": (REPEAT, "backfill", CO_VISITATION),
}
SHARES = (0.5, 0.9, 0.95, 0.99)


class SourceDiagnostics:
    """Four sources and three blends for ``targets``, measured at the depths ``ks`` on the labels ``found``.

    Lists are made once, at the greatest depth. Only labelled customers' lists are measured; of the others the number of
    candidates counts. Global lists, and blends that a full backfill tops up, have the same number for everyone, so no
    list is multiplied by all targets. Distributions come from histograms of these numbers.

    Defined cases: labels of customers who are no targets do not count; a customer without candidates counts with 0; without
    labels the metrics are 0.
    """

    def __init__(self, tx: DataFrame, cutoff: dt.date, targets: DataFrame, found: DataFrame, ks: tuple[int, ...] = (12, 50, 100), days: int = 7, history_items: int = 8, neighbour_items: int = 100):
        if not ks or min(ks) < 1:
            raise ValueError("the depths must be positive")
        self.ks, self.most, self.spark = tuple(sorted(set(ks))), max(ks), tx.sparkSession
        most = self.most
        self.targets = materialize(targets.select("customer_id").dropna().distinct(), "diagnosed")
        self.found = materialize(found.join(self.targets, "customer_id", "left_semi").select("customer_id", "article_id").distinct(), "diagnosed-labels")
        self.size = self.targets.count()
        state = materialize(popularity.purchase_state(tx, cutoff), "purchase-state")
        self.depth = state.groupBy("customer_id").agg(F.sum("n").alias("n"))
        self.repeat = materialize(popularity.repeats(tx, cutoff, self.targets, most, state).select("customer_id", "article_id", F.col("rank").alias("pos")), "diagnosed-repeat")
        self.global_ = {
            RECENT: popularity.top(popularity.article_stats(lookback(tx, cutoff, days)), most).select("article_id", F.col("rank").alias("pos")),
            ALL_TIME: popularity.top(popularity.stats_of_state(state), most).select("article_id", F.col("rank").alias("pos")),
        }
        both = self.global_[RECENT].withColumn("s", F.lit(0)).unionByName(self.global_[ALL_TIME].withColumn("s", F.lit(1)))
        first = both.groupBy("article_id").agg(F.min(F.struct("s", "pos")).alias("place"))  # at most twice the depth
        self.global_["backfill"] = popularity.top(first, most, ("place",)).select("article_id", F.col("rank").alias("pos"))
        self.global_ = {n: materialize(g, "diagnosed-global") for n, g in self.global_.items()}
        recent = history.recent_unique(state, most=history_items)
        near = materialize(history.neighbours(history.pair_counts(recent), neighbour_items), "diagnosed-near")
        mine = recent.join(self.targets, "customer_id", "left_semi")
        self.covis = materialize(history.co_visitation_scores(mine, near, most, history_items).select("customer_id", "article_id", F.col("rank").alias("pos")), "diagnosed-covis")
        self.reached = near.join(mine.select("article_id").distinct(), "article_id", "left_semi").select(F.col("other_id").alias("article_id")).distinct()

    def _for(self, who: DataFrame, name: str) -> DataFrame:
        """A source's lists of some customers."""
        if name in self.global_:
            return c.for_everyone(self.global_[name], who).select("customer_id", "article_id", "pos")
        return (self.repeat if name == REPEAT else self.covis).join(who, "customer_id", "left_semi")

    def _blend(self, who: DataFrame, parts: tuple[str, ...]) -> DataFrame:
        lists = [self._for(who, p).select("customer_id", "article_id", F.lit(p).alias("source"), F.col("pos").alias("source_rank")) for p in parts]
        return c.merge_ranked(c.union(lists), list(parts), self.most)

    def lists(self) -> DataFrame:
        """``source, customer_id, article_id, pos`` of the labelled customers."""
        who = materialize(self.found.select("customer_id").distinct(), "diagnosed-who")
        out = None
        for name in (REPEAT, RECENT, ALL_TIME, CO_VISITATION, *BLENDS):
            one = self._blend(who, BLENDS[name]) if name in BLENDS else self._for(who, name)
            one = one.select(F.lit(name).alias("source"), "customer_id", "article_id", "pos")
            out = one if out is None else out.unionByName(one)
        return out

    def scores(self) -> DataFrame:
        """``source, customer_id, ap, recall_k…`` of every labelled customer."""
        labels = self.found.groupBy("customer_id").agg(F.count(F.lit(1)).alias("labels"))
        hit = self.lists().join(self.found, ["customer_id", "article_id"], "left_semi")
        sofar = F.row_number().over(Window.partitionBy("source", "customer_id").orderBy("pos"))
        aggs = [F.count_if(F.col("pos") <= k).alias(f"hits_{k}") for k in self.ks]
        got = hit.withColumn("precision", sofar / F.col("pos")).groupBy("source", "customer_id").agg(F.sum(F.when(F.col("pos") <= 12, F.col("precision"))).alias("won"), *aggs)
        names = self.spark.createDataFrame([(n,) for n in (REPEAT, RECENT, ALL_TIME, CO_VISITATION, *BLENDS)], "source string")
        every = labels.join(F.broadcast(names), F.lit(True)).join(got, ["source", "customer_id"], "left")
        zero = lambda x: F.coalesce(x, F.lit(0))
        return every.select("source", "customer_id", (zero("won") / F.least("labels", F.lit(12))).alias("ap"), *[(zero(f"hits_{k}") / F.col("labels")).alias(f"recall_{k}") for k in self.ks])

    def counts(self) -> DataFrame:
        """``source, n, customers``: how many targets have how many candidates; at most depth + 1 rows a source."""
        fixed = {n: g.count() for n, g in self.global_.items()}
        out = self.spark.createDataFrame([(n, fixed[n], self.size) for n in (RECENT, ALL_TIME)], "source string, n bigint, customers bigint")
        varying = {REPEAT: self.repeat, CO_VISITATION: self.covis}
        for name, parts in BLENDS.items():
            if fixed["backfill"] >= self.most:
                out = out.unionByName(self.spark.createDataFrame([(name, self.most, self.size)], "source string, n bigint, customers bigint"))
            else:
                varying[name] = self._blend(self.targets, parts)
        for name, lists in varying.items():
            per = self.targets.join(lists.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n")), "customer_id", "left").fillna(0, ["n"])
            out = out.unionByName(per.groupBy("n").agg(F.count(F.lit(1)).alias("customers")).select(F.lit(name).alias("source"), "n", "customers"))
        return out

    def articles(self) -> DataFrame:
        """``source, articles``: how many articles a source can give."""
        ids = {REPEAT: self.repeat.select("article_id"), CO_VISITATION: self.reached, **{n: g.select("article_id") for n, g in self.global_.items()}}
        out = None
        for name in (REPEAT, RECENT, ALL_TIME, CO_VISITATION, *BLENDS):
            parts = [ids[p] for p in BLENDS.get(name, (name,))]
            one = parts[0]
            for p in parts[1:]:
                one = one.unionByName(p)
            one = one.agg(F.count_distinct("article_id").alias("articles")).select(F.lit(name).alias("source"), "articles")
            out = one if out is None else out.unionByName(one)
        return out

    def report(self) -> DataFrame:
        """One row per source and blend."""
        scores = self.scores().groupBy("source").agg(F.count(F.lit(1)).alias("evaluated_customers"), F.avg("ap").alias("map_at_12"), *[F.avg(f"recall_{k}").alias(f"recall_at_{k}") for k in self.ks])
        upto = F.sum("customers").over(Window.partitionBy("source").orderBy("n"))
        run = self.counts().withColumn("upto", upto)
        at = [F.min(F.when(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.lit(p) * F.lit(self.size))), F.col("n"))).alias(f"p{round(p * 100)}") for p in SHARES]
        shape = run.where("customers > 0").groupBy("source").agg(
            F.sum(F.when(F.col("n") > 0, F.col("customers")).otherwise(0)).alias("rows_with_candidates"), F.sum(F.when(F.col("n") >= self.most, F.col("customers")).otherwise(0)).alias("rows_with_all"),
            F.min("n").alias("minimum"), *at, F.max("n").alias("maximum"), (F.sum(F.col("n") * F.col("customers")) / F.sum("customers")).alias("mean"),
        )
        out = shape.join(self.articles(), "source").join(scores, "source", "left")
        share = F.when(F.lit(self.size) > 0, F.col("rows_with_candidates") / F.lit(max(1, self.size))).otherwise(0.0)
        return out.withColumn("target_customers", F.lit(self.size).cast("bigint")).withColumn("candidate_coverage", share).fillna(0)

    def by_history(self) -> DataFrame:
        """``source, bucket, customers, map_at_12, recall_at_12`` by the number of purchases before the cutoff; no empty buckets."""
        named = self.scores().join(self.depth, "customer_id", "left").withColumn("bucket", metrics.history_bucket(F.coalesce("n", F.lit(0))))
        return named.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("customers"), F.avg("ap").alias("map_at_12"), F.avg("recall_12").alias("recall_at_12"))


def ablation(candidates: DataFrame, found: DataFrame, base: tuple[str, ...], add: tuple[str, ...] = (), k: int = 12) -> DataFrame:
    """``variant, map, delta``: MAP of the deterministic ranking with the ``base`` sources, without each, and with each of ``add``.

    The variants are ranked in one plan: rows are multiplied by the variants that hold their source, and a customer of a
    variant stands for a customer. Labels of customers without candidates count with 0.
    """
    sets = {"baseline": base, **{f"-{s}": tuple(x for x in base if x != s) for s in base}, **{f"+{s}": (*base, s) for s in add if s not in base}}
    spark = candidates.sparkSession
    members = spark.createDataFrame([(v, s) for v, names in sets.items() for s in names], "variant string, source string")
    own = F.concat_ws("|", "variant", "customer_id").alias("customer_id")
    rows = candidates.join(F.broadcast(members), "source").select(own, "article_id", "source", "source_rank", "source_score")
    variants = spark.createDataFrame([(v,) for v in sets], "variant string")
    labels = found.select("customer_id", "article_id").distinct().join(F.broadcast(variants), F.lit(True)).select(own, "article_id")
    per = metrics.per_customer(ft.deterministic_rank(ft.pair_features(rows), k), labels, k)
    means = per.groupBy(F.substring_index("customer_id", "|", 1).alias("variant")).agg(F.avg("ap").alias("map"))
    base_map = means.where("variant = 'baseline'").select(F.col("map").alias("base_map"))
    return means.join(F.broadcast(base_map), F.lit(True)).select("variant", "map", (F.col("map") - F.col("base_map")).alias("delta"))


__all__ = ["BLENDS", "SourceDiagnostics", "ablation"]
