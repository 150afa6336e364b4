"""Registered plans: training examples and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wickerlane.functions.text import settled
from wickerlane.operators import behavioral as bh
from wickerlane.operators import features as ft
from wickerlane.operators import fusion, metrics
from wickerlane.operators import training as tr
from wickerlane.operators import vectors as vc
from wickerlane.operators.temporal import before
from wickerlane.plans.base import query
from wickerlane.plans.fixtures import CUT, K, SPLIT, all_candidates, found, sql, targets, tx
from wickerlane.plans.ranking import SIDECARS, labelled, ltr
from wickerlane.workspace import materialize

D, S = DataFrame, SparkSession
_PAIRS = "SELECT customer_id, article_id, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq, max(t_dat) AS last_day FROM past GROUP BY 1, 2"


def past(spark: S, d: str) -> D:
    return before(tx(spark, d), CUT)


@query(sql(_PAIRS))
def D24_positive_pairs(spark: S, d: str) -> D:
    return tr.positive_pairs(past(spark, d))


@query(sql(f"SELECT * FROM ({_PAIRS}) QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY last_seq DESC) = 1"))
def D24_latest_per_customer(spark: S, d: str) -> D:
    return tr.positive_pairs(past(spark, d), "latest_customer")


@query(sql(f"SELECT * FROM ({_PAIRS}) ORDER BY last_seq DESC LIMIT 1000"))
def D24_latest_capped(spark: S, d: str) -> D:
    """Also F5: the thousand pairs bought last."""
    return tr.positive_pairs(past(spark, d), "latest", 1000)


@query(sql("SELECT article_id, round(q, 9) AS q, round(ln(q) + 1e-9, 6) AS log_q FROM (SELECT article_id, (n + 1) / (sum(n) OVER () + count(*) OVER ()) AS q FROM (SELECT article_id, count(*) AS n FROM past GROUP BY 1))"))
def D25_sampling_log_q(spark: S, d: str) -> D:
    return tr.sampling_log_q(past(spark, d)).select("article_id", F.round("q", 9).alias("q"), settled("log_q").alias("log_q"))


@query(sql("SELECT article_id AS item, row_number() OVER (ORDER BY article_id) - 1 AS idx FROM (SELECT DISTINCT article_id FROM past)"))
def M4_vocabulary(spark: S, d: str) -> D:
    return tr.vocabulary(past(spark, d), "article_id").select("item", "idx")


@query(sql("SELECT customer_id, t_dat, string_agg(article_id, ' ' ORDER BY seq) AS items FROM past GROUP BY 1, 2 HAVING count(*) >= 2"))
def M5_baskets(spark: S, d: str) -> D:
    return tr.baskets(past(spark, d)).select("customer_id", "t_dat", F.array_join("items", " ").alias("items"))


@query()
def M5_item_vectors(spark: S, d: str) -> D:
    return tr.item_vectors(tr.baskets(past(spark, d)), rounds=1)


@query()
def M1_negatives(spark: S, d: str) -> D:
    """Also C11: no negative was ever bought by its customer."""
    return tr.negatives(tr.positive_pairs(past(spark, d), "latest_customer"), past(spark, d), 3, sampling="mixed")


@query()
def A15_two_tower_examples(spark: S, d: str) -> D:
    """Labelled examples with indices: each customer's last pair and its negatives."""
    t = past(spark, d)
    positives = tr.positive_pairs(t, "latest_customer")
    no = tr.negatives(positives, t, 2)
    rows = positives.select("customer_id", "article_id", F.lit(1).alias("label")).unionByName(no.select("customer_id", F.col("negative_id").alias("article_id"), F.lit(0).alias("label")))
    named = lambda c: tr.vocabulary(t, c).select(F.col("idx").alias(c.replace("_id", "_index")), F.col("item").alias(c))
    return rows.join(named("customer_id"), "customer_id").join(named("article_id"), "article_id")


@query()
def I12_factor_retrieval(spark: S, d: str) -> D:
    """Also M2, A16 and L7's input: implicit factors, dot products over all articles, the best twelve per target."""
    users, items = tr.factors(past(spark, d))
    mine = users.join(targets(spark, d).withColumnRenamed("customer_id", "query"), "query", "left_semi")
    return vc.exact_search(mine, items, K, "dot").select(F.col("query").alias("customer_id"), F.col("item").alias("article_id"), "score", F.col("rank").alias("pos"))


@query()
def L7_factor_evaluation(spark: S, d: str) -> D:
    return metrics.summary(metrics.per_customer(I12_factor_retrieval(spark, d), found(spark, d), K))


@query()
def I13_two_tower_score(spark: S, d: str) -> D:
    users, items = tr.factors(past(spark, d))
    return vc.pair_dots(all_candidates(spark, d), users, items)


def _linear_rows(spark: S, d: str, split) -> D:
    rows = labelled(spark, d, split)
    ranks = [f"{s}_rank" for s in ("repeat", "recent_popularity", "all_time_popularity")]
    return materialize(rows.select("customer_id", "article_id", "label", "source_count", "best_rank", *ranks, ft.deterministic_score().alias("deterministic_score"), *ft.linear_vector()), "linear-rows")


@query()
def J5_linear_ranker(spark: S, d: str) -> D:
    """Also J4, J6, L9's comparison: trained on the window before, ranked and scored on the evaluation window."""
    train, target = _linear_rows(spark, d, SPLIT.previous()), _linear_rows(spark, d, SPLIT)
    want = found(spark, d)
    out = metrics.summary(metrics.per_customer(ft.source_order(target, K), want, K)).withColumn("ranker", F.lit("source_order"))
    for name, score in (("linear", tr.linear_score(tr.fit_linear(train))), ("linear_sgd", tr.linear_score(tr.fit_linear_exact(train))), ("deterministic", F.col("deterministic_score"))):
        ranked = ft.rank_by(target.withColumn("score", score), K, "score desc").select("customer_id", "article_id", "pos")
        out = out.unionByName(metrics.summary(metrics.per_customer(ranked, want, K)).withColumn("ranker", F.lit(name)))
    return out


def _tree_columns() -> list[str]:
    return [*ft.linear_names()[1:], "deterministic_score", *bh.names(), *SIDECARS]


def _trained(spark: S, d: str, windows: int) -> tuple[D, D]:
    """The sampled rows of the last ``windows`` windows before the evaluation window, and those to be ranked."""
    split, train = SPLIT, None
    for _ in range(windows):
        split = split.previous()
        one = ltr(spark, d, split).withColumn("window", F.lit(str(split.cutoff)))
        train = one if train is None else train.unionByName(one)
    return materialize(train, "ltr-train"), materialize(ltr(spark, d), "ltr-target")


def _ranked(df: D, key: str, name: str) -> D:
    return ft.rank_by(df, K, f"{key} desc").select(F.lit(name).alias("ranker"), "customer_id", "article_id", "pos")


@query()
def J12_tree_ranker(spark: S, d: str) -> D:
    """Boosted trees on the 111 columns of two windows, alone and blended with the deterministic score (J13)."""
    columns = _tree_columns()
    train, target = _trained(spark, d, 2)
    scored = materialize(tr.tree_scores(tr.fit_trees(train, columns), target, columns), "tree-scores")
    blend = ft.z_blend(scored, "deterministic_score", "model_score", 0.75)
    return _ranked(scored, "deterministic_score", "deterministic").unionByName(_ranked(scored, "model_score", "trees")).unionByName(_ranked(blend, "blend", "blend"))


@query()
def J18_bagged_trees(spark: S, d: str) -> D:
    """The mean of three models that differ in their seed, blended with the deterministic score."""
    train, target = _trained(spark, d, 1)
    scored = tr.bagged_scores(train, target, _tree_columns(), seeds=(1, 2, 3))
    return _ranked(ft.z_blend(scored, "deterministic_score", "model_score", 0.75), "blend", "bagged").drop("ranker")


@query()
def J19_two_model_fusion(spark: S, d: str) -> D:
    """Boosted trees and a random forest: blended by z-scores, and their lists fused by reciprocal ranks."""
    columns = _tree_columns()
    train, target = _trained(spark, d, 1)
    scored = tr.tree_scores(tr.fit_trees(train, columns), target, columns, "boosted")
    scored = materialize(tr.tree_scores(tr.fit_forest(train, columns), scored, columns, "forest"), "two-models")
    lists = _ranked(scored, "boosted", "boosted").unionByName(_ranked(scored, "forest", "forest"))
    fused = fusion.reciprocal_rank_fusion(lists, most=K).select(F.lit("fused").alias("ranker"), "customer_id", "article_id", "pos")
    return lists.unionByName(_ranked(ft.z_blend(scored, "boosted", "forest", 1.0), "blend", "blend")).unionByName(fused)


@query(
    sql(
        """SELECT customer_id, article_id, least(3, (SELECT count(DISTINCT article_id) FROM past) - owned)::BIGINT AS negatives, 0::BIGINT AS bought, 0::BIGINT AS repeated FROM
        (SELECT customer_id, article_id FROM past QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY seq DESC) = 1) JOIN (SELECT customer_id, count(DISTINCT article_id) AS owned FROM past GROUP BY 1) USING (customer_id)"""
    )
)
def C11_negatives_exclude_history(spark: S, d: str) -> D:
    """Of each positive pair the number of its negatives: complete, none bought by its customer, none twice."""
    t = past(spark, d)
    own = t.select("customer_id", F.col("article_id").alias("negative_id"), F.lit(1).alias("mine")).distinct()
    rows = tr.negatives(tr.positive_pairs(t, "latest_customer"), t, 3, sampling="mixed").join(own, ["customer_id", "negative_id"], "left")
    n = F.count(F.lit(1))
    return rows.groupBy("customer_id", "article_id").agg(n.alias("negatives"), F.count("mine").alias("bought"), (n - F.count_distinct("negative_id")).alias("repeated"))
