"""Further entries: steps of other plans that have a name of their own, and round trips through files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wickerlane.functions.text import path_of_image, settled
from wickerlane.operators import content as ct
from wickerlane.operators import features as ft
from wickerlane.operators import fusion, history, metrics, popularity, submission, temporal
from wickerlane.operators import reports as rp
from wickerlane.operators import training as tr
from wickerlane.operators import two_tower as tt
from wickerlane.operators import vectors as vc
from wickerlane.plans import ranking, recommend, reports, training, vectors  # noqa: F401
from wickerlane.plans.base import QUERIES, SQL, query
from wickerlane.plans.fixtures import CUT, K, SPLIT, all_candidates, attribute, found, sql, targets, tx
from wickerlane.sources.tables import read_text_csv, table
from wickerlane.workspace import materialize, scratch

D, S = DataFrame, SparkSession


def _same(name: str, as_: str) -> None:
    """The entry ``name`` is what the plan ``as_`` computes."""
    query(SQL.get(as_), name)(QUERIES[as_])


for _name, _as in (
    ("D6_directed_pair_counts", "C3_history_pairs"), ("E9_content_rerank", "I10_content_with_prior"), ("E12_fused_rank", "J14_reciprocal_rank_fusion"), ("E14_trial_rank", "J8_grid_tuning"),
    ("F3_top_after_history", "I11_prior_powered_similarity"), ("F4_pool_and_rerank", "I10_content_with_prior"), ("F5_latest_capped", "D24_latest_capped"), ("F7_diversity", "J17_diversity_rerank"), ("F8_top_values", "D20_hierarchy"), ("G7_customer_difference", "C12_customer_difference"),
):
    _same(_name, _as)


@query(sql("SELECT f.customer_id, count(m.article_id) AS predicted FROM (SELECT DISTINCT customer_id FROM found) f LEFT JOIN merged m USING (customer_id) GROUP BY 1"))
def C9_labels_with_predictions(spark: S, d: str) -> D:
    who = found(spark, d).select("customer_id").distinct()
    return who.join(recommend.baseline(spark, d), "customer_id", "left").groupBy("customer_id").agg(F.count("article_id").alias("predicted"))


@query(sql("SELECT customer_id, article_id, rank FROM covis"))
def E6_co_visitation_rank(spark: S, d: str) -> D:
    return history.co_visitation(tx(spark, d), CUT, targets(spark, d), K).select("customer_id", "article_id", "rank")


@query(sql("SELECT customer_id, article_id, rank FROM product_affinity"))
def E8_affinity_rank(spark: S, d: str) -> D:
    return history.attribute_affinity(tx(spark, d), CUT, targets(spark, d), attribute(spark, d, "product_code"), K).select("customer_id", "article_id", "rank")


@query(sql("SELECT customer_id, pos, sofar FROM hits"))
def E13_cumulative_hits(spark: S, d: str) -> D:
    hit = recommend.baseline(spark, d).join(found(spark, d), ["customer_id", "article_id"], "left_semi")
    sofar = F.count(F.lit(1)).over(Window.partitionBy("customer_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return hit.select("customer_id", "pos", sofar.alias("sofar"))


@query(sql("SELECT customer_id, article_id, row_number() OVER (PARTITION BY customer_id ORDER BY round(score, 9) DESC, article_id) AS pos FROM det"))
def E16_score_to_rank(spark: S, d: str) -> D:
    return ft.rank_by(ranking.feats(spark, d).withColumn("score", ft.deterministic_score()), None, "score desc").select("customer_id", "article_id", "pos")


@query(sql("SELECT source, article_id, row_number() OVER (PARTITION BY source ORDER BY n DESC, article_id) AS rank FROM (SELECT source, article_id, count(*) AS n FROM candidates GROUP BY 1, 2) QUALIFY rank <= 5"))
def F2_group_top(spark: S, d: str) -> D:
    counts = all_candidates(spark, d).groupBy("source", "article_id").agg(F.count(F.lit(1)).alias("n"))
    return popularity.top_by(counts, ["source"], 5, ("n desc", "article_id")).select("source", "article_id", "rank")


@query(sql("SELECT article_id, n FROM (SELECT article_id, count(DISTINCT customer_id) AS n FROM past GROUP BY 1) ORDER BY n DESC, article_id LIMIT 5000"))
def F6_article_pool(spark: S, d: str) -> D:
    """The pool of a factor retrieval: articles with most positive pairs."""
    counts = tr.positive_pairs(temporal.before(tx(spark, d), CUT)).groupBy("article_id").agg(F.count(F.lit(1)).alias("n"))
    return popularity.top(counts, 5000, ("n desc", "article_id")).select("article_id", "n")


@query(sql("SELECT customer_id, string_agg(article_id, ' ' ORDER BY first_seq) AS items FROM (SELECT customer_id, article_id, min(seq) AS first_seq FROM past SEMI JOIN targets USING (customer_id) GROUP BY 1, 2) GROUP BY 1"))
def G3_dedupe_in_order(spark: S, d: str) -> D:
    mine = temporal.before(tx(spark, d), CUT).join(targets(spark, d), "customer_id", "left_semi")
    sequences = tr.baskets(mine, by_day=False, least=1)
    return sequences.select("customer_id", F.array_join(F.array_distinct("items"), " ").alias("items"))


@query(sql("SELECT customer_id, round(recall + 1e-9, 6) AS recall FROM scored"))
def L3_recall(spark: S, d: str) -> D:
    return metrics.per_customer(recommend.baseline(spark, d), found(spark, d), K).select("customer_id", settled("recall").alias("recall"))


@query(sql(f"SELECT DISTINCT customer_id, article_id FROM tx WHERE t_dat >= DATE '{SPLIT.previous().cutoff}' AND t_dat < DATE '{CUT}'"))
def J6_previous_window_labels(spark: S, d: str) -> D:
    return found(spark, d, SPLIT.previous())


@query()
def J4_logistic_weights(spark: S, d: str) -> D:
    """The weights that sequential descent and distributed regression find on the window before."""
    rows = materialize(ranking.labelled(spark, d, SPLIT.previous()).select("customer_id", "article_id", "label", *ft.linear_vector()), "linear-rows")
    pairs = zip(ft.linear_names(), tr.fit_linear_exact(rows), tr.fit_linear(rows))
    return spark.createDataFrame([(n, float(a), float(b)) for n, a, b in pairs], "name string, sequential double, distributed double")


@query("SELECT article_id, combined_text, image_relative_path, image_exists FROM (" + reports.CONTENT_SQL + ")")
def A14_content_csv(spark: S, d: str) -> D:
    """Article content written as CSV and read again."""
    path = scratch(spark, "content-csv")
    own = reports._content(spark, d).select("article_id", "combined_text", "image_relative_path", F.col("image_exists").cast("string").alias("image_exists"))
    own.write.csv(path, header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    back = read_text_csv(spark, path, ["article_id", "combined_text"])
    return back.withColumn("image_exists", F.col("image_exists").cast("boolean"))


@query(sql("SELECT customer_id, article_id, source, source_rank FROM candidates"))
def A6_candidate_scan(spark: S, d: str) -> D:
    path = scratch(spark, "candidates-csv")
    submission.write_candidates(all_candidates(spark, d), path)
    return submission.read_candidates(spark, path).select("customer_id", "article_id", "source", "source_rank")


@query(sql("SELECT item AS article_id, len(vec) AS dim, round(list_sum(vec) + 1e-9, 5) AS total FROM textvec"))
def A9_embedding_readers(spark: S, d: str) -> D:
    """The text vectors written as JSON lines with a manifest, and read under its checks."""
    path = scratch(spark, "embeddings") + ".jsonl"
    rows = vectors.text_vectors(spark, d).select(F.col("item").alias("article_id"), "vec")
    ct.write_cache(rows, rows.count(), path, "given")
    back, _ = ct.read_cache(spark, path)
    total = F.aggregate("vec", F.lit(0.0), lambda s, v: s + v)
    return back.select("article_id", F.size("vec").cast("bigint").alias("dim"), settled(total, 5).alias("total"))


@query()
def A16_factor_export(spark: S, d: str) -> D:
    """Customer and article factors in one table: ``side, id, vec``."""
    users, items = tr.factors(temporal.before(tx(spark, d), CUT))
    return users.select(F.lit("customer").alias("side"), F.col("query").alias("id"), "vec").unionByName(items.select(F.lit("article").alias("side"), F.col("item").alias("id"), "vec"))


@query("SELECT 'images/' || article_id[1:3] || '/' || article_id || '.jpg' AS path, article_id FROM articles")
def A19_image_paths(spark: S, d: str) -> D:
    return table(spark, d, "articles").select(path_of_image("article_id").alias("path"), "article_id")


def _hashed(spark: S, d: str) -> D:
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v * v))
    unit = vectors.text_vectors(spark, d).withColumn("f", norm).select("item", "id", array_to_vector(F.transform("vec", lambda x: x / F.col("f"))).alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=0.5, numHashTables=8, seed=5).fit(unit)
    met = model.approxSimilarityJoin(unit.where(F.col("id") % 50 == 0), unit, 0.55, "distance")
    rows = met.where(F.col("datasetA.item") != F.col("datasetB.item")).select(F.col("datasetA.item").alias("query"), F.col("datasetB.item").alias("item"), F.round("distance", 9).alias("distance"))
    return popularity.top_by(rows, ["query"], 10, ("distance", "item"))


@query()
def M8_hashed_search(spark: S, d: str) -> D:
    """Approximate search by random projections: of text vectors with an index divisible by 50 the 10 nearest of all within distance 0.55 (cosine 0.85)."""
    return _hashed(spark, d)


@query("SELECT true AS reaches_nine_tenths")
def M8_hashed_recall(spark: S, d: str) -> D:
    """Whether the hashed search finds at least nine tenths of what exact search finds within its distance."""
    items = vectors.text_vectors(spark, d)
    asked = items.where(F.col("id") % 50 == 0).select(F.col("item").alias("query"), "vec")
    exact = vc.exact_search(asked, items.select("item", "vec"), 11).where((F.col("query") != F.col("item")) & (F.col("score") >= 1 - 0.55**2 / 2))
    exact = materialize(popularity.top_by(exact.drop("rank"), ["query"], 10, ("score desc", "item")), "exact")
    got = exact.join(_hashed(spark, d).select("query", "item"), ["query", "item"], "left_semi").count()
    return spark.createDataFrame([(got >= 0.9 * exact.count(),)], "reaches_nine_tenths boolean")


# -- guards, registries, reports ---------------------------------------------------------------------------------
@query(sql(f"SELECT 0::BIGINT AS late_rows, (SELECT max(t_dat) FROM past) AS last_day, (SELECT count(*) FROM found) AS labels, (SELECT max(t_dat) FROM past) < DATE '{CUT}' AS holds"))
def B9_leakage_guard(spark: S, d: str) -> D:
    """The clock rule on the rows that features are made of, and the guard that refuses features of a later cutoff."""
    temporal.assert_before({"cutoff": str(CUT)}, CUT)
    out = temporal.leakage(temporal.before(tx(spark, d), CUT), found(spark, d), SPLIT)
    return out.withColumn("holds", F.col("last_day") < F.lit(CUT))


@query("SELECT 'candidate_k' AS setting, '12' AS first_value, '24' AS other_value")
def B12_comparable_windows(spark: S, d: str) -> D:
    """Settings in which two rolling runs differ; windows that overlap are refused."""
    temporal.check_windows(ranking.ROLLING)
    a, b = {"k": K, "candidate_k": 12, "cutoff": "2023-11-17"}, {"k": K, "candidate_k": 24, "cutoff": "2023-11-24"}
    return spark.createDataFrame([(n, str(a[n]), str(b[n])) for n in temporal.comparable([a, b])], "setting string, first_value string, other_value string")


@query(sql(f"SELECT 'source_order' AS name, round(map + 1e-9, 6) AS offline FROM ({ranking.evaluated('merged')}) UNION ALL SELECT 'deterministic', round(map + 1e-9, 6) FROM ({ranking.evaluated('detrank')}) ORDER BY offline DESC, name LIMIT 1"))
def L10_champion(spark: S, d: str) -> D:
    """The best of the rankers, found from a rolling report that was written as JSON and read again (A17)."""
    import json

    rows = ranking.J2_deterministic_evaluation(spark, d).select("ranker", "map").collect()  # two rows
    path = scratch(spark, "report") + ".json"
    rp.write_report(spark, {"config": {"k": K}, "windows": [{"cutoff": str(CUT), **{r["ranker"]: r["map"] for r in rows}}]}, path)
    runs, warnings = rp.discover([json.loads(rp.read_text(spark, path)), {"windows": []}])
    if len(warnings) != 1 or "# Champion" not in rp.champion_page(runs, warnings):
        raise ValueError("the empty report was not told of")
    best = rp.champion(runs)
    return spark.createDataFrame([(best.name, best.offline)], "name string, offline double")


@query(sql("SELECT name, bucket, rows FROM (SELECT 'split' AS name, CASE WHEN t_dat < DATE '2023-12-01' THEN 'train' WHEN t_dat < DATE '2023-12-08' THEN 'validation' ELSE 'future' END AS bucket, count(*) AS rows FROM tx GROUP BY 1, 2)"))
def A17_json_report(spark: S, d: str) -> D:
    """The split summary written as a JSON report with sorted keys, read again; its Markdown page has a row per bucket (A18)."""
    summary = temporal.split_summary(tx(spark, d), SPLIT).select("bucket", "rows")
    path = scratch(spark, "report") + ".json"
    rp.write_report(spark, summary, path)
    back = spark.read.option("multiLine", True).schema("bucket string, rows bigint").json(path)
    if rp.markdown("Split", {"rows": back}).count("\n| ") != back.count() + 2:
        raise ValueError("the page lacks rows")
    return back.select(F.lit("split").alias("name"), "bucket", "rows")


@query("SELECT * FROM (VALUES ('a', 0.03::DOUBLE, 0.022::DOUBLE, 'kept'), ('b', 0.02, NULL, ''), ('c', 0.01, 0.02, '')) r(name, offline, public, notes)")
def G8_merged_registries(spark: S, d: str) -> D:
    """Two registries of runs by configuration: metrics of the newer entry, scores and notes of the older where it has none."""
    old = [rp.Run("a", {"k": 12}, 0.025, 0.022, "kept"), rp.Run("c", {"k": 50}, 0.01, 0.02)]
    new = [rp.Run("a", {"k": 12}, 0.03), rp.Run("b", {"k": 24}, 0.02)]
    return spark.createDataFrame([(r.name, r.offline, r.public, r.notes) for r in rp.merge_runs(old, new)], "name string, offline double, public double, notes string")


_ONES = " + ".join(x for x in ("(source_count / 15.0::DOUBLE)", "(1.0::DOUBLE / best_rank)", *(f"CASE WHEN {n}_rank IS NOT NULL THEN 1 + {ranking._value(n)} + 1.0::DOUBLE / {n}_rank ELSE 0 END" for n in ft.SOURCES)))


@query(sql(f"SELECT 'deterministic' AS ranker, customer_id, article_id, pos FROM detrank WHERE pos <= 12 UNION ALL SELECT 'linear', customer_id, article_id, row_number() OVER (PARTITION BY customer_id ORDER BY round(1 + {_ONES}, 9) DESC, article_id) AS pos FROM feats QUALIFY pos <= 12"))
def J22_ranker_protocol(spark: S, d: str) -> D:
    """Two rankers behind one interface over the same features; the linear one with all weights 1."""
    rows, out = materialize(ranking.feats(spark, d), "features"), None
    for ranker in (rp.DeterministicRanker(), rp.LinearRanker((1.0,) * 48)):
        one = ranker.rank(rows, K).select(F.lit(ranker.name).alias("ranker"), "customer_id", "article_id", "pos")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT 'hashed-words' AS provider_name, 'text' AS embedding_kind, 'cosine' AS metric, 64 AS vector_dimension, count(*) AS article_count, count(*) FILTER (combined_text <> '') AS embedding_count, count(*) FILTER (combined_text = '') AS missing_embedding_count FROM (" + reports.CONTENT_SQL + ")")
def A11_embedding_manifest(spark: S, d: str) -> D:
    from dataclasses import asdict

    path, rows = scratch(spark, "embeddings"), reports._content(spark, d)
    ct.write_cache(ct.generate_embeddings(rows), rows.count(), path, "hashed-words")
    m = asdict(ct.read_cache(spark, path)[1])
    return spark.createDataFrame([tuple(m.values())], "provider_name string, embedding_kind string, metric string, vector_dimension int, article_count bigint, embedding_count bigint, missing_embedding_count bigint")


@query(sql("SELECT a.item AS query, b.item AS item, round(round(list_dot_product(a.vec, b.vec), 9) + 1e-9, 6) AS score FROM textvec a, textvec b WHERE a.id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY a.item ORDER BY round(list_dot_product(a.vec, b.vec), 9) DESC, b.item) <= 10"))
def M7_exact_dot_search(spark: S, d: str) -> D:
    items = vectors.text_vectors(spark, d)
    out = vc.exact_search(items.where(F.col("id") % 50 == 0).select(F.col("item").alias("query"), "vec"), items.select("item", "vec"), 10, "dot")
    return out.select("query", "item", settled("score").alias("score"))


_LIST = "SELECT customer_id, unnest(l) AS article_id, generate_subscripts(l, 1) AS pos FROM (SELECT customer_id, string_split(string_agg(article_id, ' ' ORDER BY pos), ' ') AS l FROM ({q}) GROUP BY 1)"


@query(
    sql(
        "SELECT customer_id, article_id, row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, article_id) AS pos FROM (SELECT customer_id, article_id, round(sum(1.0::DOUBLE / (60 + pos)), 12) AS score FROM ("
        + " UNION ALL ".join(_LIST.format(q=q) for q in ("SELECT customer_id, article_id, pos FROM merged", "SELECT customer_id, article_id, pos FROM detrank WHERE pos <= 12", "SELECT customer_id, article_id, rank AS pos FROM covis"))
        + ") GROUP BY 1, 2) QUALIFY pos <= 12"
    )
)
def C14_merge_of_submissions(spark: S, d: str) -> D:
    """Three submissions written as files, read again, met by customer and fused by the places of their articles."""
    rows, who = materialize(ranking.feats(spark, d), "features"), targets(spark, d)
    lists = {
        "baseline": recommend.baseline(spark, d),
        "deterministic": ft.deterministic_rank(rows, K).select("customer_id", "article_id", "pos"),
        "co_visitation": rows.where("co_visitation_rank IS NOT NULL").select("customer_id", "article_id", F.col("co_visitation_rank").alias("pos")),
    }
    slates = None
    for name, ranked in lists.items():
        path = scratch(spark, "submission")
        submission.write_submission(submission.as_text(ranked, who).withColumn("o", F.col("customer_id")), "o", path)
        one = spark.read.csv(path, header=True).where("coalesce(prediction, '') <> ''").select(F.lit(name).alias("ranker"), "customer_id", F.posexplode(F.split("prediction", " ")).alias("place", "article_id"))
        one = one.select("ranker", "customer_id", "article_id", (F.col("place") + 1).alias("pos"), F.lit(0.0).alias("score"))
        slates = one if slates is None else slates.unionByName(one)
    return fusion.reciprocal_rank_fusion(slates, most=K).select("customer_id", "article_id", "pos")


# -- the two-tower model -----------------------------------------------------------------------------------------
def _examples(spark: S, d: str) -> D:
    t = temporal.before(tx(spark, d), CUT)
    pairs = tr.positive_pairs(t, "latest", 20_000)
    no = tr.negatives(pairs, t, 2)
    day = pairs.select("customer_id", "article_id", F.col("last_day").alias("day"))
    bad = no.join(day, ["customer_id", "article_id"]).select("customer_id", F.col("negative_id").alias("article_id"), F.lit(0).alias("label"), "day")
    return day.select("customer_id", "article_id", F.lit(1).alias("label"), "day").unionByName(bad)


@query("SELECT * FROM (VALUES ('bpr', true), ('logistic', true)) r(objective, loss_fell)")
def M2_two_tower_loss(spark: S, d: str) -> D:
    """Both objectives with log-q and recency weights: the mean loss falls over the epochs."""
    rows, out = materialize(_examples(spark, d), "examples"), []
    for objective in ("bpr", "logistic"):
        fitted = tt.train(rows, tt.TrainingConfig(objective=objective, log_q=0.5, half_life_days=30.0, epochs=4), CUT)
        losses = [r["vec"][0] for r in sorted(fitted.where("side = 'loss'").collect(), key=lambda r: int(r["id"]))]
        out.append((objective, losses[-1] < losses[0]))
    return spark.createDataFrame(out, "objective string, loss_fell boolean")


@query()
def I12_two_tower_retrieval(spark: S, d: str) -> D:
    """Dot products plus a tenth of the log-popularity over a pool of 2,000 articles, the best twelve per target."""
    fitted = materialize(tt.train(_examples(spark, d)), "towers")
    side = lambda s, name: fitted.where(F.col("side") == s).select(F.col("id").alias(name), "vec")
    mine = side("customer", "query").join(targets(spark, d).withColumnRenamed("customer_id", "query"), "query", "left_semi")
    prior = popularity.log_popularity(temporal.before(tx(spark, d), CUT))
    return tt.retrieve(mine, side("article", "item"), K, prior, 0.1, 2_000)
