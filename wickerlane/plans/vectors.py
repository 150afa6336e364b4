"""Registered plans: exact vector search and content similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wickerlane.functions.text import settled
from wickerlane.operators import metrics
from wickerlane.operators import vectors as vc
from wickerlane.operators.candidates import as_source, union
from wickerlane.plans import ranking  # noqa: F401  (its CTEs are used here)
from wickerlane.plans.base import query
from wickerlane.plans.fixtures import CUT, K, MORE, all_candidates, found, sql, targets, tx
from wickerlane.plans.ranking import evaluated
from wickerlane.sources.tables import table

D, S = DataFrame, SparkSession
TEXT = "embeddings/text_v2/article_vectors.jsonl"


def all_vectors(spark: S, d: str) -> D:
    runs = table(spark, d, "embedding_runs").select(F.col("embeddings_path").alias("grp"), F.col("vector_dimension").alias("dim"))
    return vc.newest(table(spark, d, "article_vectors"), "embeddings_path", "article_id", "embedding_index", "vector", runs)


def text_vectors(spark: S, d: str) -> D:
    return all_vectors(spark, d).where(F.col("grp") == TEXT).select("item", "id", "vec")


MORE["usable"] = """SELECT embeddings_path AS grp, article_id AS item, embedding_index AS id, vector::DOUBLE[] AS vec FROM article_vectors JOIN
  (SELECT DISTINCT embeddings_path, vector_dimension FROM embedding_runs) USING (embeddings_path) WHERE vector IS NOT NULL AND len(vector) = vector_dimension
  AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0
  QUALIFY row_number() OVER (PARTITION BY embeddings_path, article_id ORDER BY embedding_index DESC) = 1"""
MORE["textvec"] = f"SELECT item, id, vec FROM usable WHERE grp = '{TEXT}'"
MORE["vhist"] = "SELECT customer_id, article_id, row_number() OVER (PARTITION BY customer_id ORDER BY seq DESC) AS position FROM (SELECT customer_id, article_id, max(seq) AS seq FROM past SEMI JOIN targets USING (customer_id) JOIN (SELECT item AS article_id FROM textvec) USING (article_id) GROUP BY 1, 2) QUALIFY position <= 8"
MORE["vmean"] = "SELECT customer_id, list(m ORDER BY i) AS vec FROM (SELECT customer_id, i, avg(x) AS m FROM (SELECT customer_id, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM vhist JOIN textvec ON item = article_id) GROUP BY 1, 2) GROUP BY 1"
MORE["vcos"] = "SELECT q.customer_id, item AS article_id, round(list_cosine_similarity(q.vec, t.vec), 9) AS cosine FROM vmean q, textvec t WHERE (q.customer_id, t.item) NOT IN (SELECT (customer_id, article_id) FROM vhist)"
MORE["content_rank"] = "SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY cosine DESC, article_id) AS pos FROM vcos QUALIFY pos <= 12"


@query(sql("SELECT grp, item, id FROM usable"))
def M7_usable_vectors(spark: S, d: str) -> D:
    return all_vectors(spark, d).select("grp", "item", "id")


@query(sql("SELECT a.item AS query, b.item AS item, round(list_cosine_similarity(a.vec, b.vec), 9) AS score, row_number() OVER (PARTITION BY a.item ORDER BY round(list_cosine_similarity(a.vec, b.vec), 9) DESC, b.item) AS rank FROM textvec a, textvec b WHERE a.id % 50 = 0 QUALIFY rank <= 10"))
def C13_exact_search(spark: S, d: str) -> D:
    """Every text vector whose index is divisible by 50, against all text vectors."""
    items = text_vectors(spark, d)
    return vc.exact_search(items.where(F.col("id") % 50 == 0).select(F.col("item").alias("query"), "vec"), items.select("item", "vec"), 10)


@query(sql("SELECT a.item AS query, b.item AS item, round(-list_distance(a.vec, b.vec) * list_distance(a.vec, b.vec) + 1e-9, 6) AS score FROM textvec a, textvec b WHERE a.id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY a.item ORDER BY round(-list_distance(a.vec, b.vec) * list_distance(a.vec, b.vec), 9) DESC, b.item) <= 10"))
def M7_exact_l2_search(spark: S, d: str) -> D:
    items = text_vectors(spark, d)
    out = vc.exact_search(items.where(F.col("id") % 50 == 0).select(F.col("item").alias("query"), "vec"), items.select("item", "vec"), 10, "l2")
    return out.select("query", "item", settled("score").alias("score"))


@query(sql("SELECT customer_id, article_id, round(cosine + 1e-9, 6) AS score, pos AS rank FROM content_rank"))
def I10_content_similarity(spark: S, d: str) -> D:
    return vc.content_similarity(tx(spark, d), CUT, targets(spark, d), text_vectors(spark, d), K).withColumn("score", settled("score"))


MORE["vprior"] = "SELECT article_id, round(c / max(c) OVER (), 9) AS prior FROM (SELECT article_id, ln(1 + count(*)) AS c FROM past GROUP BY 1)"
MORE["vpool"] = "SELECT *, round(0.7::DOUBLE * cosine + 0.3::DOUBLE * coalesce(prior, 0), 9) AS score FROM (SELECT * FROM vcos QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY cosine DESC, article_id) <= 50) LEFT JOIN vprior USING (article_id)"


@query(sql("SELECT customer_id, article_id, round(score + 1e-9, 6) AS score, row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, cosine DESC, article_id) AS rank FROM vpool QUALIFY rank <= 12"))
def I10_content_with_prior(spark: S, d: str) -> D:
    """Also F4 and E9: a pool of 50 by cosine, reranked with the popularity prior."""
    return vc.content_similarity(tx(spark, d), CUT, targets(spark, d), text_vectors(spark, d), K, prior_weight=0.3, pool=50).withColumn("score", settled("score"))


@query(
    sql(
        "SELECT customer_id, article_id, round(round(score, 9) + 1e-9, 6) AS score, row_number() OVER (PARTITION BY customer_id ORDER BY round(score, 9) DESC, article_id) AS rank FROM scored_ QUALIFY rank <= 50",
        last_=f"SELECT customer_id, article_id, seq FROM past SEMI JOIN targets USING (customer_id) SEMI JOIN (SELECT item AS article_id FROM textvec) USING (article_id) WHERE t_dat >= DATE '{CUT}' - 90 QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY seq DESC) <= 20",
        mean_="SELECT customer_id, list(m ORDER BY i) AS vec FROM (SELECT customer_id, i, avg(x) AS m FROM (SELECT customer_id, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM last_ JOIN textvec ON item = article_id) GROUP BY 1, 2) GROUP BY 1",
        recent_="SELECT article_id, round(c / max(c) OVER (), 9) AS prior FROM (SELECT article_id, ln(1 + count(*)) AS c FROM recent GROUP BY 1)",
        scored_="SELECT q.customer_id, item AS article_id, list_cosine_similarity(q.vec, t.vec) * sqrt(prior) AS score FROM mean_ q, textvec t JOIN recent_ ON article_id = item WHERE (q.customer_id, t.item) NOT IN (SELECT (customer_id, article_id) FROM last_)",
    )
)
def I11_prior_powered_similarity(spark: S, d: str) -> D:
    """Also F3: an exact cut after leaving out the history."""
    return vc.prior_powered_similarity(tx(spark, d), CUT, targets(spark, d), text_vectors(spark, d)).withColumn("score", settled("score"))


@query(sql("SELECT customer_id, article_id, round(coalesce(list_cosine_similarity(q.vec, t.vec), 0) + 1e-9, 6) AS cosine FROM (SELECT DISTINCT customer_id, article_id FROM candidates) LEFT JOIN vmean q USING (customer_id) LEFT JOIN textvec t ON item = article_id"))
def I14_content_user_cosine(spark: S, d: str) -> D:
    items = text_vectors(spark, d)
    _, queries = vc.history_vectors(tx(spark, d), CUT, targets(spark, d), items)
    return vc.pair_scores(all_candidates(spark, d), queries, items).withColumn("cosine", settled("cosine"))


@query(
    sql("""SELECT customer_id, article_id, source, source_rank, round(source_score + 1e-9, 6) AS source_score FROM candidates
    UNION ALL SELECT customer_id, article_id, 'text_similarity', pos, round(cosine + 1e-9, 6) FROM content_rank""")
)
def G5_append_content_candidates(spark: S, d: str) -> D:
    near = vc.content_similarity(tx(spark, d), CUT, targets(spark, d), text_vectors(spark, d), K)
    return union([all_candidates(spark, d), as_source(near, "text_similarity", "score")]).withColumn("source_score", settled("source_score"))


@query(sql(evaluated("content_rank")))
def L6_content_diagnostics(spark: S, d: str) -> D:
    near = vc.content_similarity(tx(spark, d), CUT, targets(spark, d), text_vectors(spark, d), K).withColumnRenamed("rank", "pos")
    out = metrics.summary(metrics.per_customer(near, found(spark, d), K))
    return out.withColumns({"map": settled("map"), "recall": settled("recall")})


@query(sql("SELECT a.article_id AS item, CAST(t.vec IS NOT NULL AS INTEGER) AS there, round(coalesce(t.vec[1], 0) + 1e-9, 6) AS first_value, round(coalesce(list_sum(t.vec), 0) + 1e-9, 6) AS total FROM (SELECT DISTINCT article_id FROM articles) a LEFT JOIN textvec t ON item = a.article_id"))
def M6_aligned_matrix(spark: S, d: str) -> D:
    from wickerlane.operators.training import vocabulary

    rows = vc.aligned(vocabulary(table(spark, d, "articles"), "article_id"), text_vectors(spark, d), 64)
    total = F.aggregate("vec", F.lit(0.0), lambda s, v: s + v)
    return rows.select("item", F.exists("vec", lambda x: x != 0).cast("int").alias("there"), settled(F.get("vec", F.lit(0))).alias("first_value"), settled(total).alias("total"))


_FALLBACK = """SELECT customer_id, article_id, row_number() OVER (PARTITION BY customer_id ORDER BY p, rank, article_id) AS pos FROM (SELECT * FROM (
  SELECT customer_id, article_id, 0 AS p, pos AS rank FROM content_rank UNION ALL SELECT customer_id, article_id, 1, rank FROM targets, top7 UNION ALL SELECT customer_id, article_id, 2, rank FROM targets, topall)
  QUALIFY row_number() OVER (PARTITION BY customer_id, article_id ORDER BY p, rank) = 1) QUALIFY pos <= 12"""


@query(sql(_FALLBACK, targets="SELECT DISTINCT customer_id FROM customers"))
def I15_content_with_fallback(spark: S, d: str) -> D:
    """Content similarity for every customer, filled up with popularity."""
    from wickerlane.operators.submission import backfilled

    t, who = tx(spark, d), table(spark, d, "customers").select("customer_id").distinct()
    near = vc.content_similarity(t, CUT, who, text_vectors(spark, d), K).select("customer_id", "article_id", F.col("rank").alias("pos"))
    return backfilled(near, t, CUT, who, K)


query(ranking._matrix_sql())(ranking.J10_without_factors)


# -- the other vector sources ----------------------------------------------------------------------------------
def _path_source(path: str, source: str, prior: float) -> None:
    """Content similarity over the vectors of another path, as a candidate source, with its SQL."""
    own = {"textvec": f"SELECT item, id, vec FROM usable WHERE grp = '{path}'"}
    plain = f"SELECT customer_id, article_id, '{source}' AS source, pos AS source_rank, round(cosine + 1e-9, 6) AS source_score FROM content_rank"
    mixed = f"SELECT customer_id, article_id, '{source}' AS source, row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, cosine DESC, article_id) AS source_rank, round(score + 1e-9, 6) AS source_score FROM vpool QUALIFY source_rank <= 12"

    def plan(spark: S, d: str) -> D:
        items = all_vectors(spark, d).where(F.col("grp") == path).select("item", "id", "vec")
        near = vc.content_similarity(tx(spark, d), CUT, targets(spark, d), items, K, prior_weight=prior, pool=50 if prior else None)
        return as_source(near, source, "score").withColumn("source_score", settled("source_score"))

    query(sql(mixed if prior else plain, **own), f"I10_{source}")(plan)


IMAGE, MULTIMODAL = "embeddings/image_v3/article_vectors.npy", "embeddings/multimodal_v1/article_vectors.csv"
_path_source(IMAGE, "image_similarity", 0.0)
_path_source(MULTIMODAL, "multimodal_similarity", 0.0)
_path_source(MULTIMODAL, "multimodal_similarity_popularity_prior", 0.3)


@query()
def I10_item2vec_similarity(spark: S, d: str) -> D:
    """Content similarity over item vectors learned from the baskets before the cutoff."""
    from wickerlane.operators import training as tr
    from wickerlane.operators.temporal import before

    t = tx(spark, d)
    items = tr.item_vectors(tr.baskets(before(t, CUT)))
    return as_source(vc.content_similarity(t, CUT, targets(spark, d), items, K), "item2vec_similarity", "score")
