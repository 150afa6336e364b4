"""Registered plans: clock rule, popularity, histories, candidate sources and metrics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wickerlane.functions.text import is_article_id, is_customer_id, label, settled
from wickerlane.operators import candidates as c
from wickerlane.operators import history, metrics, popularity, temporal
from wickerlane.plans.base import query
from wickerlane.plans.fixtures import CUT, DAYS, K, MORE, SPLIT, all_candidates, attribute, found, segments, sql, targets, tx
from wickerlane.sources.tables import table

D = DataFrame
S = SparkSession


def near(spark: S, d: str) -> D:
    return history.neighbours(history.pair_counts(history.recent_unique(temporal.before(tx(spark, d), CUT))))


# -- A, B: scans, filters --------------------------------------------------------------------------------------
@query(sql("SELECT seq, t_dat, customer_id, article_id, round(price + 1e-9, 6) AS price, sales_channel_id FROM tx"))
def A2_transactions(spark: S, d: str) -> D:
    return tx(spark, d).withColumn("price", settled("price"))


@query("SELECT DISTINCT customer_id FROM customers UNION ALL SELECT DISTINCT article_id FROM articles")
def A3_id_sets(spark: S, d: str) -> D:
    return table(spark, d, "customers").select("customer_id").distinct().union(table(spark, d, "articles").select("article_id").distinct())


@query(sql("SELECT * FROM garment_attr UNION ALL SELECT * FROM product_attr"))
def A4_article_attributes(spark: S, d: str) -> D:
    return attribute(spark, d, "garment_group_name").unionByName(attribute(spark, d, "product_code"))


@query(sql("SELECT * FROM segments"))
def A5_age_segments(spark: S, d: str) -> D:
    return segments(spark, d)


@query(sql("SELECT seq, t_dat, customer_id, article_id FROM past"))
def B1_before_cutoff(spark: S, d: str) -> D:
    return temporal.before(tx(spark, d), CUT).select("seq", "t_dat", "customer_id", "article_id")


@query(sql("SELECT seq, t_dat, customer_id, article_id FROM recent"))
def B2_lookback(spark: S, d: str) -> D:
    return temporal.lookback(tx(spark, d), CUT, DAYS).select("seq", "t_dat", "customer_id", "article_id")


@query(sql(f"SELECT seq, t_dat, article_id FROM tx WHERE t_dat >= DATE '{CUT - dt.timedelta(366)}' AND t_dat < DATE '{CUT - dt.timedelta(359)}'"))
def B3_seasonal_window(spark: S, d: str) -> D:
    return temporal.shifted(tx(spark, d), CUT).select("seq", "t_dat", "article_id")


BUCKET = f"CASE WHEN t_dat < DATE '{CUT}' THEN 'train' WHEN t_dat < DATE '{SPLIT.end}' THEN 'validation' ELSE 'future' END AS bucket"


@query(sql(f"SELECT {BUCKET}, t_dat, count(*) AS rows FROM tx GROUP BY ALL"))
def B4_split_bucket(spark: S, d: str) -> D:
    return tx(spark, d).groupBy(temporal.bucket(SPLIT).alias("bucket"), "t_dat").agg(F.count(F.lit(1)).alias("rows"))


@query(
    """SELECT coalesce(regexp_full_match(customer_id, '[0-9a-f]{64}'), false) AS customer_ok, coalesce(regexp_full_match(article_id, '[0-9]{10}'), false) AS article_ok,
    count(*) AS rows FROM transactions_train GROUP BY ALL"""
)
def B5_id_predicates(spark: S, d: str) -> D:
    t = table(spark, d, "transactions_train")
    return t.groupBy(is_customer_id("customer_id").alias("customer_ok"), is_article_id("article_id").alias("article_ok")).agg(F.count(F.lit(1)).alias("rows"))


@query(sql("SELECT article_id, count(*) AS rows FROM past SEMI JOIN targets USING (customer_id) GROUP BY 1"))
def B10_target_scope(spark: S, d: str) -> D:
    mine = temporal.before(tx(spark, d), CUT).join(targets(spark, d), "customer_id", "left_semi")
    return mine.groupBy("article_id").agg(F.count(F.lit(1)).alias("rows"))


@query(sql("SELECT customer_id FROM targets"))
def B11_label_customers(spark: S, d: str) -> D:
    return targets(spark, d)


# -- C: joins --------------------------------------------------------------------------------------------------
@query(sql("SELECT value, count(*) AS rows FROM past JOIN garment_attr USING (article_id) GROUP BY 1"))
def C1_article_join(spark: S, d: str) -> D:
    return temporal.before(tx(spark, d), CUT).join(attribute(spark, d, "garment_group_name"), "article_id").groupBy("value").agg(F.count(F.lit(1)).alias("rows"))


@query(sql("SELECT segment, count(*) AS rows FROM past JOIN segments USING (customer_id) GROUP BY 1"))
def C2_segment_join(spark: S, d: str) -> D:
    return temporal.before(tx(spark, d), CUT).join(segments(spark, d), "customer_id").groupBy("segment").agg(F.count(F.lit(1)).alias("rows"))


@query(sql("SELECT * FROM pairs"))
def C3_history_pairs(spark: S, d: str) -> D:
    return history.pair_counts(history.recent_unique(temporal.before(tx(spark, d), CUT)))


@query(sql("SELECT customer_id, article_id, units, near_rank FROM covis_sum"))
def C4_neighbour_fanout(spark: S, d: str) -> D:
    mine = history.recent_unique(temporal.before(tx(spark, d), CUT)).join(targets(spark, d), "customer_id", "left_semi")
    scores = mine.join(near(spark, d).withColumnRenamed("rank", "near_rank"), "article_id")
    return scores.groupBy("customer_id", F.col("other_id").alias("article_id")).agg(F.sum(F.expr("n * (840 div position)")).alias("units"), F.min("near_rank").alias("near_rank"))


@query(sql("SELECT customer_id, article_id, round(score + 1e-9, 6) AS score FROM garment_best"))
def C5_attribute_join(spark: S, d: str) -> D:
    # Without the cut per customer: every article of the values' first twelve.
    out = history.attribute_affinity(tx(spark, d), CUT, targets(spark, d), attribute(spark, d, "garment_group_name"), k=1_000_000, most_per_value=12)
    return out.select("customer_id", "article_id", settled("score").alias("score"))


@query(sql("SELECT customer_id, article_id, rank FROM targets, top7"))
def C6_list_for_everyone(spark: S, d: str) -> D:
    ranked = popularity.top(popularity.article_stats(temporal.lookback(tx(spark, d), CUT, DAYS)), K)
    return c.for_everyone(ranked, targets(spark, d)).select("customer_id", "article_id", "rank")


@query(sql("SELECT c.customer_id, c.article_id, CAST(f.article_id IS NOT NULL AS INTEGER) AS label FROM (SELECT DISTINCT customer_id, article_id FROM candidates) c LEFT JOIN found f USING (customer_id, article_id)"))
def C7_labelled_candidates(spark: S, d: str) -> D:
    have = all_candidates(spark, d).select("customer_id", "article_id").distinct()
    return have.join(found(spark, d).withColumn("label", F.lit(1)), ["customer_id", "article_id"], "left").fillna(0, subset=["label"])


@query(sql("SELECT customer_id, article_id FROM topped ANTI JOIN (SELECT DISTINCT customer_id, article_id FROM past) USING (customer_id, article_id)", topped="SELECT customer_id, article_id FROM targets, topall"))
def C10_exclude_history(spark: S, d: str) -> D:
    shown = c.all_time_source(tx(spark, d), CUT, targets(spark, d), K).select("customer_id", "article_id")
    return shown.join(temporal.before(tx(spark, d), CUT).select("customer_id", "article_id"), ["customer_id", "article_id"], "left_anti")


@query(
    sql("""SELECT 'silent' AS side, customer_id FROM (SELECT customer_id FROM customers EXCEPT SELECT customer_id FROM past)
    UNION ALL SELECT 'unlisted', customer_id FROM (SELECT customer_id FROM past EXCEPT SELECT customer_id FROM customers)""")
)
def C12_customer_difference(spark: S, d: str) -> D:
    known, seen = table(spark, d, "customers").select("customer_id").distinct(), temporal.before(tx(spark, d), CUT).select("customer_id").distinct()
    side = lambda a, b, name: a.join(b, "customer_id", "left_anti").select(F.lit(name).alias("side"), "customer_id")
    return side(known, seen, "silent").unionByName(side(seen, known, "unlisted"))


# -- D: aggregates ---------------------------------------------------------------------------------------------
@query(sql("SELECT article_id, count(*) AS n, max(t_dat) AS last_day FROM past GROUP BY 1"))
def D1_article_stats(spark: S, d: str) -> D:
    return popularity.article_stats(temporal.before(tx(spark, d), CUT))


_WINDOWS = ", ".join(f"count(*) FILTER (t_dat >= DATE '{CUT}' - {n}) AS n_{n}d, max(t_dat) FILTER (t_dat >= DATE '{CUT}' - {n}) AS last_{n}d" for n in (1, 3, 7))


@query(sql(f"SELECT article_id, count(*) AS n_all, max(t_dat) AS last_all, {_WINDOWS} FROM past GROUP BY 1"))
def D2_window_stats(spark: S, d: str) -> D:
    return popularity.window_stats(tx(spark, d), CUT)


@query(sql("SELECT customer_id, article_id, count(*) AS n, max(t_dat) AS last_day FROM past GROUP BY 1, 2"))
def D3_pair_stats(spark: S, d: str) -> D:
    return popularity.pair_stats(temporal.before(tx(spark, d), CUT))


@query(sql(f"SELECT {BUCKET}, count(*) AS rows, count(DISTINCT customer_id) AS customers, count(DISTINCT article_id) AS articles, count(DISTINCT (customer_id, article_id)) AS pairs FROM tx GROUP BY 1"))
def D4_split_summary(spark: S, d: str) -> D:
    return temporal.split_summary(tx(spark, d), SPLIT)


SPLITS = [temporal.Split(CUT - dt.timedelta(days=14), 7), temporal.Split(CUT - dt.timedelta(days=7), 7), SPLIT]


@query(sql(" UNION ALL ".join(f"SELECT DISTINCT DATE '{s.cutoff}' AS cutoff, customer_id, article_id FROM tx WHERE t_dat >= DATE '{s.cutoff}' AND t_dat < DATE '{s.end}'" for s in SPLITS)))
def D5_labels_of_many_cutoffs(spark: S, d: str) -> D:
    temporal.check_windows(SPLITS)
    return temporal.labels_of_many(tx(spark, d), SPLITS)


@query(sql("SELECT value, article_id, round(c / max(c) OVER (PARTITION BY value) + 1e-9, 6) AS score FROM garment_count"))
def D7_log_popularity(spark: S, d: str) -> D:
    rows = temporal.lookback(tx(spark, d), CUT, DAYS).join(attribute(spark, d, "garment_group_name"), "article_id")
    return popularity.log_popularity(rows, ["value"]).select("value", "article_id", settled("score").alias("score"))


@query(sql("SELECT source, count(*) AS rows FROM candidates GROUP BY 1"))
def D15_source_rows(spark: S, d: str) -> D:
    return c.source_counts(all_candidates(spark, d))


@query("SELECT max(t_dat) AS last_day FROM transactions_train")
def D27_last_day(spark: S, d: str) -> D:
    return table(spark, d, "transactions_train").agg(F.max("t_dat").alias("last_day"))


# -- E, F: rankings --------------------------------------------------------------------------------------------
@query(sql("SELECT article_id, row_number() OVER (ORDER BY n DESC, last_day DESC, article_id) AS rank FROM (SELECT article_id, count(*) AS n, max(t_dat) AS last_day FROM past GROUP BY 1) QUALIFY rank <= 100"))
def E1_popularity_rank(spark: S, d: str) -> D:
    return popularity.top(popularity.article_stats(temporal.before(tx(spark, d), CUT)), 100).select("article_id", "rank")


@query(sql("SELECT customer_id, article_id, rank FROM repeats"))
def E2_repeat_rank(spark: S, d: str) -> D:
    return popularity.repeats(tx(spark, d), CUT, targets(spark, d), K).select("customer_id", "article_id", "rank")


@query(sql("SELECT * FROM history"))
def E3_recent_unique_history(spark: S, d: str) -> D:
    return history.recent_unique(temporal.before(tx(spark, d), CUT))


@query(sql("SELECT * FROM garment_hist"))
def E4_recent_attributes(spark: S, d: str) -> D:
    past = temporal.before(tx(spark, d), CUT).join(attribute(spark, d, "garment_group_name"), "article_id").join(targets(spark, d), "customer_id", "left_semi")
    return history.recent_unique(past, "value", 8)


@query(sql("SELECT * FROM near"))
def E5_neighbours(spark: S, d: str) -> D:
    return near(spark, d)


@query(sql("SELECT segment, article_id, round(score + 1e-9, 6) AS score, rank FROM seg_pop"))
def E7_segment_rank(spark: S, d: str) -> D:
    return popularity.segment_popularity(tx(spark, d), CUT, segments(spark, d), DAYS, 12).withColumn("score", settled("score"))


@query(sql("SELECT * FROM top7"))
def F1_top_list(spark: S, d: str) -> D:
    return popularity.top(popularity.article_stats(temporal.lookback(tx(spark, d), CUT, DAYS)), K).select("article_id", "rank")


# -- G: set operations -----------------------------------------------------------------------------------------
MERGED = """SELECT customer_id, article_id, row_number() OVER (PARTITION BY customer_id ORDER BY p, source_rank, article_id) AS pos FROM
  (SELECT customer_id, article_id, p, source_rank FROM (SELECT *, CASE source WHEN 'repeat' THEN 0 WHEN 'recent_popularity' THEN 1 ELSE 2 END AS p FROM candidates
   WHERE source IN ('repeat', 'recent_popularity', 'all_time_popularity')) QUALIFY row_number() OVER (PARTITION BY customer_id, article_id ORDER BY p, source_rank) = 1) QUALIFY pos <= 12"""
PRIORITY = ["repeat", "recent_popularity", "all_time_popularity"]
MORE["merged"] = MERGED


def baseline(spark: S, d: str) -> D:
    """Repeat purchases, then recent, then all-time popularity."""
    t, who = tx(spark, d), targets(spark, d)
    return c.merge_ranked(c.union([c.repeat_source(t, CUT, who, K), c.recent_source(t, CUT, who, K, DAYS), c.all_time_source(t, CUT, who, K)]), PRIORITY, K)


@query(sql("SELECT * FROM merged"))
def G1_first_wins_merge(spark: S, d: str) -> D:
    return baseline(spark, d)


@query(sql("SELECT customer_id, article_id, source, source_rank, round(source_score + 1e-9, 6) AS source_score FROM candidates"))
def G4_candidate_union(spark: S, d: str) -> D:
    return all_candidates(spark, d).withColumn("source_score", settled("source_score"))


@query(sql("SELECT count(*) AS reached FROM (SELECT DISTINCT customer_id, article_id FROM candidates) SEMI JOIN found USING (customer_id, article_id)"))
def G6_labels_reached(spark: S, d: str) -> D:
    have = all_candidates(spark, d).select("customer_id", "article_id").distinct()
    return have.join(found(spark, d), ["customer_id", "article_id"], "left_semi").agg(F.count(F.lit(1)).alias("reached"))


# -- I: candidate sources --------------------------------------------------------------------------------------
def _source(name: str, key: str, plan) -> None:
    query(
        sql(f"SELECT customer_id, article_id, source, source_rank, round(source_score + 1e-9, 6) AS source_score FROM candidates WHERE source = '{name}'"), key
    )(lambda spark, d: plan(spark, d, tx(spark, d), targets(spark, d)).withColumn("source_score", settled("source_score")))


_source("repeat", "I1_repeat", lambda s, d, t, w: c.repeat_source(t, CUT, w, K))
_source("recent_popularity", "I2_recent_popularity", lambda s, d, t, w: c.recent_source(t, CUT, w, K))
_source("recent_popularity_1d", "I3_recent_popularity_1d", lambda s, d, t, w: c.recent_source(t, CUT, w, K, 1, "recent_popularity_1d"))
_source("recent_popularity_3d", "I3_recent_popularity_3d", lambda s, d, t, w: c.recent_source(t, CUT, w, K, 3, "recent_popularity_3d"))
_source("all_time_popularity", "I4_all_time_popularity", lambda s, d, t, w: c.all_time_source(t, CUT, w, K))
_source("co_visitation", "I5_co_visitation", lambda s, d, t, w: c.co_visitation_source(t, CUT, w, K))
_source("seasonal_popularity", "I6_seasonal_popularity", lambda s, d, t, w: c.seasonal_source(t, CUT, w, K))
_source("age_segment_popularity", "I7_age_segment_popularity", lambda s, d, t, w: c.segment_source(t, CUT, w, segments(s, d), K))
_source("garment_group_popularity", "I8_garment_group_popularity", lambda s, d, t, w: c.affinity_source(t, CUT, w, attribute(s, d, "garment_group_name"), K, "garment_group_popularity"))
_source("product_code_popularity", "I9_product_code_popularity", lambda s, d, t, w: c.affinity_source(t, CUT, w, attribute(s, d, "product_code"), K, "product_code_popularity"))


@query(sql("SELECT customer_id, count(*) AS candidates, least(count(*), 12) AS kept FROM covis_sum GROUP BY 1"))
def I16_co_visitation_coverage(spark: S, d: str) -> D:
    mine = history.recent_unique(temporal.before(tx(spark, d), CUT)).join(targets(spark, d), "customer_id", "left_semi")
    return history.co_visitation_coverage(mine, near(spark, d), 12)


@query(sql("SELECT source, count(*) AS rows, count(DISTINCT customer_id) AS customers, count(DISTINCT article_id) AS articles FROM candidates GROUP BY 1"))
def I17_candidate_export(spark: S, d: str) -> D:
    return all_candidates(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("customer_id").alias("customers"), F.count_distinct("article_id").alias("articles"))


# -- L: evaluation ---------------------------------------------------------------------------------------------
MORE["hits"] = "SELECT customer_id, pos, row_number() OVER (PARTITION BY customer_id ORDER BY pos) AS sofar FROM merged SEMI JOIN found USING (customer_id, article_id)"
MORE["scored"] = """SELECT f.customer_id, f.labels, coalesce(h.hits, 0) AS hits, coalesce(h.won, 0) / least(f.labels, 12) AS ap, coalesce(h.hits, 0) / f.labels AS recall
  FROM (SELECT customer_id, count(*) AS labels FROM found GROUP BY 1) f LEFT JOIN (SELECT customer_id, count(*) AS hits, sum(sofar / pos) AS won FROM hits GROUP BY 1) h USING (customer_id)"""


@query(sql("SELECT * FROM merged"))
def L4_predictions(spark: S, d: str) -> D:
    return baseline(spark, d)


@query(sql("SELECT customer_id, labels, hits, round(ap + 1e-9, 6) AS ap, round(recall + 1e-9, 6) AS recall FROM scored"))
def L1_average_precision(spark: S, d: str) -> D:
    out = metrics.per_customer(baseline(spark, d), found(spark, d), K)
    return out.withColumns({"ap": settled("ap"), "recall": settled("recall")})


@query(sql("SELECT count(*) AS customers, round(avg(ap) + 1e-9, 6) AS map, round(avg(recall) + 1e-9, 6) AS recall FROM scored"))
def L2_map_and_recall(spark: S, d: str) -> D:
    out = metrics.summary(metrics.per_customer(baseline(spark, d), found(spark, d), K))
    return out.withColumns({"map": settled("map"), "recall": settled("recall")})


@query(
    sql("""SELECT b.bucket, count(s.customer_id) AS customers, round(coalesce(avg(ap), 0) + 1e-9, 6) AS map, round(coalesce(avg(recall), 0) + 1e-9, 6) AS recall FROM
    (VALUES ('0'), ('1-2'), ('3-10'), ('11+')) b(bucket) LEFT JOIN (SELECT scored.*, CASE WHEN coalesce(n, 0) = 0 THEN '0' WHEN n <= 2 THEN '1-2' WHEN n <= 10 THEN '3-10' ELSE '11+' END AS bucket
    FROM scored LEFT JOIN (SELECT customer_id, count(*) AS n FROM past GROUP BY 1) USING (customer_id)) s USING (bucket) GROUP BY 1""")
)
def D13_history_buckets(spark: S, d: str) -> D:
    scores = metrics.per_customer(baseline(spark, d), found(spark, d), K)
    depth = temporal.before(tx(spark, d), CUT).groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"))
    return metrics.by_history(scores, depth).withColumns({"map": settled("map"), "recall": settled("recall")})


@query(
    sql("""SELECT min(n) AS minimum, quantile_disc(n, 0.5) AS p50, quantile_disc(n, 0.9) AS p90, quantile_disc(n, 0.95) AS p95, quantile_disc(n, 0.99) AS p99, max(n) AS maximum, round(avg(n) + 1e-9, 6) AS mean
    FROM (SELECT customer_id, count(*) AS n FROM past GROUP BY 1)""")
)
def D11_distribution(spark: S, d: str) -> D:
    n = temporal.before(tx(spark, d), CUT).groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"))
    return metrics.distribution(n).withColumn("mean", settled("mean"))


@query(
    sql("""SELECT percent, n AS value FROM (SELECT n, row_number() OVER (ORDER BY n) AS i, count(*) OVER () AS m FROM (SELECT count(*) AS n FROM past GROUP BY customer_id)) r,
    (VALUES (10), (25), (50), (75), (90), (99)) p(percent) WHERE i = round_even(percent / 100.0::DOUBLE * (m - 1), 0)::BIGINT + 1""")
)
def D12_rounded_index_percentiles(spark: S, d: str) -> D:
    n = temporal.before(tx(spark, d), CUT).groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"))
    return metrics.rounded_index_percentiles(n, "n", (10, 25, 50, 75, 90, 99))


@query(
    sql("""SELECT count(*) AS customers, count(*) FILTER (rows > 0) AS with_any, count(*) FILTER (rows >= 12) AS with_k, sum(rows)::BIGINT AS rows, sum(rows - arts)::BIGINT AS repeated_rows,
    (SELECT count(DISTINCT article_id) FROM merged) AS articles FROM (SELECT t.customer_id, count(m.article_id) AS rows, count(DISTINCT m.article_id) AS arts FROM targets t LEFT JOIN merged m USING (customer_id) GROUP BY 1)""")
)
def D14_coverage(spark: S, d: str) -> D:
    return metrics.coverage(baseline(spark, d), targets(spark, d), K)


@query(
    sql("""SELECT count(*) AS customers, count(*) FILTER (n > 0) AS with_candidates, round(avg(least(reach, 12) / least(labels, 12)) + 1e-9, 6) AS oracle_map, round(avg(least(reach, 12) / labels) + 1e-9, 6) AS oracle_recall,
    round(sum(reach) / sum(labels) + 1e-9, 6) AS label_coverage, round(avg(n) + 1e-9, 6) AS mean_candidates FROM
    (SELECT f.customer_id, labels, coalesce(n, 0) AS n, coalesce(reach, 0) AS reach FROM (SELECT customer_id, count(*) AS labels FROM found GROUP BY 1) f
     LEFT JOIN (SELECT customer_id, count(*) AS n, count(f2.article_id) AS reach FROM (SELECT DISTINCT customer_id, article_id FROM candidates) c LEFT JOIN found f2 USING (customer_id, article_id) GROUP BY 1) USING (customer_id))""")
)
def L8_perfect_ranker_ceiling(spark: S, d: str) -> D:
    out = metrics.ceiling(all_candidates(spark, d), found(spark, d), K)
    return out.withColumns({c: settled(c) for c in ("oracle_map", "oracle_recall", "label_coverage", "mean_candidates")})


@query(
    sql("""SELECT source, count(DISTINCT customer_id) AS customers, count(*) AS rows, count(DISTINCT article_id) AS articles, count(*) FILTER (hit) AS hits FROM
    (SELECT c.*, f.article_id IS NOT NULL AS hit FROM candidates c LEFT JOIN found f USING (customer_id, article_id)) GROUP BY 1""")
)
def L5_source_diagnostics(spark: S, d: str) -> D:
    marked = all_candidates(spark, d).join(found(spark, d).withColumn("hit", F.lit(True)), ["customer_id", "article_id"], "left")
    return marked.groupBy("source").agg(
        F.count_distinct("customer_id").alias("customers"), F.count(F.lit(1)).alias("rows"), F.count_distinct("article_id").alias("articles"), F.count("hit").alias("hits")
    )
