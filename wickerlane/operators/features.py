"""One row per candidate pair: what each source says of it, and scores from that."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickerlane.functions.text import ratio
from wickerlane.operators.popularity import top_by

# Feature name, sources it takes in, weights of presence, score and reciprocal rank.
CONTENT = (
    "image_similarity", "text_similarity", "text_similarity_popularity_prior", "item2vec_similarity",
    "item2vec_similarity_popularity_prior", "multimodal_similarity", "multimodal_similarity_popularity_prior", "two_tower_multimodal",
)
SOURCES: dict[str, tuple[tuple[str, ...], float, float, float]] = {
    "repeat": (("repeat",), 3.0, 2.0, 0.0),
    "recent_popularity": (("recent_popularity",), 1.0, 1.0, 0.0),
    "recent_popularity_1d": (("recent_popularity_1d",), 1.0, 1.0, 0.0),
    "recent_popularity_3d": (("recent_popularity_3d",), 1.0, 1.0, 0.0),
    "all_time_popularity": (("all_time_popularity",), 0.15, 0.15, 0.0),
    "co_visitation": (("co_visitation",), 0.35, 0.10, 0.0),
    "seasonal_popularity": (("seasonal_popularity",), 0.10, 0.10, 0.0),
    "age_segment_popularity": (("age_segment_popularity",), 0.30, 0.20, 0.0),
    "garment_group_popularity": (("garment_group_popularity",), 0.40, 0.25, 0.0),
    "product_code_popularity": (("product_code_popularity",), 0.60, 0.40, 0.0),
    "content_similarity": (CONTENT, 0.10, 0.05, 0.0),
    "text_similarity": (("text_similarity", "text_similarity_popularity_prior"), 0.0, 0.0, 0.0),
    "item2vec_similarity": (("item2vec_similarity", "item2vec_similarity_popularity_prior"), 0.0, 0.0, 0.0),
    "two_tower_retrieval": (("two_tower_retrieval",), 0.10, 0.05, 0.0),
    "two_tower_latest_customer": (("two_tower_retrieval_latest_customer",), 0.10, 0.05, 0.0),
}
SOURCE_COUNT_WEIGHT = BEST_RANK_WEIGHT = 0.05
LOGGED = {"co_visitation"}


@dataclass(frozen=True)
class Weights:
    """Weights of the deterministic ranker; ``changed`` maps e.g. ``repeat_presence`` or ``source_count`` to a value."""

    changed: dict[str, float] = field(default_factory=dict)

    def of(self, name: str) -> float:
        if name in self.changed:
            return self.changed[name]
        if name == "source_count":
            return SOURCE_COUNT_WEIGHT
        if name == "best_rank":
            return BEST_RANK_WEIGHT
        source, part = name.rsplit("_", 1)
        return SOURCES[source][{"presence": 1, "score": 2, "rank": 3}[part]]


def pair_features(candidates: DataFrame, sidecars: tuple[str, ...] = (), placed: bool = False) -> DataFrame:
    """Per (customer, article): ``source_count`` (rows), ``best_rank``, ``max_source_score`` and each source's rank and score.

    Scores are floored at 0; a source without the pair has a null rank and score 0. Candidates are exchanged as they are, by
    customer: they are much smaller than the row of a pair, and what ranks them afterwards finds them in place. Those that are
    ``placed`` by customer already stay.
    """
    aggs = [F.count(F.lit(1)).alias("source_count"), F.min("source_rank").alias("best_rank"), F.greatest(F.lit(0.0), F.max("source_score")).alias("max_source_score")]
    for name, (sources, *_) in SOURCES.items():
        mine = F.col("source").isin(*sources)
        aggs += [F.min(F.when(mine, F.col("source_rank"))).alias(f"{name}_rank"), F.greatest(F.lit(0.0), F.coalesce(F.max(F.when(mine, F.col("source_score"))), F.lit(0.0))).alias(f"{name}_score")]
    aggs += [F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in sidecars]
    return (candidates if placed else candidates.repartition("customer_id")).groupBy("customer_id", "article_id").agg(*aggs)


def with_labels(features: DataFrame, found: DataFrame) -> DataFrame:
    return features.join(found.select("customer_id", "article_id", F.lit(1).alias("label")), ["customer_id", "article_id"], "left").fillna(0, subset=["label"])


def _score(name: str) -> Column:
    return F.log1p(F.col(f"{name}_score")) if name in LOGGED else F.col(f"{name}_score")


def deterministic_score(weights: Weights = Weights()) -> Column:
    """Presence and score of every source by weight, the number of sources and the reciprocal best rank."""
    total = F.lit(weights.of("source_count")) * F.col("source_count") + F.coalesce(F.lit(weights.of("best_rank")) / F.col("best_rank"), F.lit(0.0))
    for name in SOURCES:
        p, s, r = (weights.of(f"{name}_{x}") for x in ("presence", "score", "rank"))
        if p or s or r:
            part = F.lit(p) + F.lit(s) * _score(name)
            if r:
                part = part + F.lit(r) / F.col(f"{name}_rank")
            total = total + F.when(F.col(f"{name}_rank").isNotNull(), part).otherwise(0.0)
    return F.round(total, 9)


# The names of the inputs of the linear ranker, in their order; other systems read them.
LINEAR_NAMES = (
    "bias",
    "has_repeat",
    "repeat_score",
    "repeat_rank_reciprocal",
    "has_recent_popularity",
    "recent_popularity_score",
    "recent_popularity_rank_reciprocal",
    "has_recent_popularity_1d",
    "recent_popularity_1d_score",
    "recent_popularity_1d_rank_reciprocal",
    "has_recent_popularity_3d",
    "recent_popularity_3d_score",
    "recent_popularity_3d_rank_reciprocal",
    "has_all_time_popularity",
    "all_time_popularity_score",
    "all_time_popularity_rank_reciprocal",
    "has_co_visitation",
    "co_visitation_log_score",
    "co_visitation_rank_reciprocal",
    "has_seasonal_popularity",
    "seasonal_popularity_score",
    "seasonal_popularity_rank_reciprocal",
    "has_age_segment_popularity",
    "age_segment_popularity_score",
    "age_segment_popularity_rank_reciprocal",
    "has_garment_group_popularity",
    "garment_group_popularity_score",
    "garment_group_popularity_rank_reciprocal",
    "has_product_code_popularity",
    "product_code_popularity_score",
    "product_code_popularity_rank_reciprocal",
    "has_content_similarity",
    "content_similarity_score",
    "content_similarity_rank_reciprocal",
    "has_text_similarity",
    "text_similarity_score",
    "text_similarity_rank_reciprocal",
    "has_item2vec_similarity",
    "item2vec_similarity_score",
    "item2vec_similarity_rank_reciprocal",
    "has_two_tower_retrieval",
    "two_tower_retrieval_score",
    "two_tower_retrieval_rank_reciprocal",
    "has_two_tower_retrieval_latest_customer",
    "two_tower_retrieval_latest_customer_score",
    "two_tower_retrieval_latest_customer_rank_reciprocal",
    "source_count_scaled",
    "best_rank_reciprocal",
)


def linear_names() -> list[str]:
    return list(LINEAR_NAMES)


def linear_vector() -> list[Column]:
    """The 48 inputs of the linear ranker: a constant, presence, score and reciprocal rank of each source, and two summaries."""
    out = [F.lit(1.0)]
    for n in SOURCES:
        out += [F.col(f"{n}_rank").isNotNull().cast("double"), _score(n), F.coalesce(1.0 / F.col(f"{n}_rank"), F.lit(0.0))]
    out += [F.col("source_count") / float(len(SOURCES)), F.coalesce(1.0 / F.col("best_rank"), F.lit(0.0))]
    return [c.alias(name) for name, c in zip(LINEAR_NAMES, out, strict=True)]


def rank_by(features: DataFrame, k: int | None, *keys: str) -> DataFrame:
    """``pos`` of each pair within its customer by ``keys`` (``"score desc"``…), ties last by article."""
    return top_by(features, ["customer_id"], k, (*keys, "article_id")).withColumnRenamed("rank", "pos")


def deterministic_rank(features: DataFrame, k: int | None, weights: Weights = Weights()) -> DataFrame:
    """By score, then source count, then best rank (none counts as 1e9), then article."""
    scored = features.withColumn("score", deterministic_score(weights)).withColumn("rank_key", F.coalesce("best_rank", F.lit(10**9)))
    return rank_by(scored, k, "score desc", "source_count desc", "rank_key").drop("rank_key")


def source_order(features: DataFrame, k: int, priority: tuple[str, ...] = ("repeat", "recent_popularity", "all_time_popularity")) -> DataFrame:
    """The source lists one after the other, rebuilt from the features' ranks."""
    place = F.coalesce(*[F.when(F.col(f"{s}_rank").isNotNull(), F.struct(F.lit(i).alias("s"), F.col(f"{s}_rank").alias("r"))) for i, s in enumerate(priority)])
    return rank_by(features.withColumn("place", place).where(F.col("place").isNotNull()), k, "place").select("customer_id", "article_id", "pos")


def training_sample(features: DataFrame, negatives_per_positive: int = 50) -> DataFrame:
    """All positives and the best-scored negatives, ``negatives_per_positive`` times max(1, positives), per customer."""
    positives = F.greatest(F.lit(1), F.sum("label").over(Window.partitionBy("customer_id")))
    scored = features.withColumn("score", deterministic_score()).withColumn("allowed", positives * negatives_per_positive)
    place = F.row_number().over(Window.partitionBy("customer_id", "label").orderBy(F.desc("score"), "article_id"))
    return scored.withColumn("place", place).where((F.col("label") == 1) | (F.col("place") <= F.col("allowed"))).drop("place", "allowed")


def z_score(column: str, least: float = 1e-9) -> Column:
    """Score within the customer in standard deviations (population); a deviation up to ``least`` counts as 1."""
    w = Window.partitionBy("customer_id")
    std = F.stddev_pop(column).over(w)
    return (F.col(column) - F.avg(column).over(w)) / F.when(std > least, std).otherwise(1.0)


def z_blend(scored: DataFrame, first: str, second: str, weight: float = 0.75) -> DataFrame:
    return scored.withColumn("blend", F.round(z_score(first) + weight * z_score(second), 9))


def global_z_blend(scored: DataFrame, first: str, second: str, alpha: float) -> DataFrame:
    """(1 - alpha) z(first) + alpha z(second) with z over the whole table, from a one-row aggregate."""
    stats = scored.agg(*[f(c).alias(f"{n}_{c}") for c in (first, second) for n, f in (("avg", F.avg), ("std", F.stddev_pop))])
    z = lambda c: ratio(F.col(c) - F.col(f"avg_{c}"), F.col(f"std_{c}"))
    joined = scored.join(F.broadcast(stats), F.lit(True))
    return joined.withColumn("blend", F.round((1 - alpha) * z(first) + alpha * z(second), 9)).drop(*stats.columns)
