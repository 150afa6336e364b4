"""Fusing ranked lists, and reranking for diversity. Slates are long: ``ranker, customer_id, article_id, pos[, score]``."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickerlane.operators.features import rank_by


def _weight(weights: dict[str, float] | None) -> Column:
    if any(w < 0 for w in (weights or {}).values()):
        raise ValueError("weights must not be negative")
    if not weights:
        return F.lit(1.0)
    return F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("ranker")], F.lit(1.0))


def reciprocal_rank_fusion(slates: DataFrame, weights: dict[str, float] | None = None, k: int = 60, most: int | None = None) -> DataFrame:
    """Sum of w / (k + pos); ties by article."""
    sums = slates.groupBy("customer_id", "article_id").agg(F.round(F.sum(_weight(weights) / (F.lit(k) + F.col("pos"))), 12).alias("score"))
    return rank_by(sums, most, "score desc")


def consensus_fusion(slates: DataFrame, weights: dict[str, float] | None = None, k: int = 60, most: int = 12) -> DataFrame:
    """As above; ties by the total weight of the lists that hold the article, then by its best place."""
    w = _weight(weights)
    sums = slates.groupBy("customer_id", "article_id").agg(
        F.round(F.sum(w / (F.lit(k) + F.col("pos"))), 12).alias("score"), F.round(F.sum(w), 9).alias("consensus"), F.min("pos").alias("best")
    )
    return rank_by(sums, most, "score desc", "consensus desc", "best")


def z_score_fusion(slates: DataFrame, weights: dict[str, float] | None = None, most: int | None = None, eps: float = 1e-9) -> DataFrame:
    """Weighted sum of z scores per slate; what a slate lacks counts as its lowest z minus one."""
    w = Window.partitionBy("ranker", "customer_id")
    std = F.stddev_pop("score").over(w)
    z = slates.withColumn("z", (F.col("score") - F.avg("score").over(w)) / F.when(std > 0, std).otherwise(eps))
    z = z.withColumn("w", _weight(weights)).select("ranker", "customer_id", "article_id", "z", "w")
    # Each article gets the fallbacks of all its customer's slates, and the difference where a slate has it.
    floor = z.groupBy("customer_id", "ranker").agg((F.min("z") - 1).alias("f"), F.first("w").alias("w"))
    base = floor.groupBy("customer_id").agg(F.sum(F.col("w") * F.col("f")).alias("base"))
    gain = z.join(floor.select("customer_id", "ranker", "f"), ["customer_id", "ranker"]).groupBy("customer_id", "article_id").agg(F.sum(F.col("w") * (F.col("z") - F.col("f"))).alias("gain"))
    return rank_by(gain.join(base, "customer_id").select("customer_id", "article_id", F.round(F.col("base") + F.col("gain"), 9).alias("score")), most, "score desc")


def diversify(ranked: DataFrame, attributes: DataFrame, k: int = 12, relevance: float = 0.7, floor: float = 0.0) -> DataFrame:
    """Greedy maximal marginal relevance per customer: ``customer_id, article_id, pos``.

    ``ranked`` has ``customer_id, article_id, score, pos``; ``attributes`` has ``article_id`` and string columns. Similarity is the
    share of equal attributes. Each step takes the article with the greatest relevance * score - (1 - relevance) *
    similarity to the nearest one taken; the first in the list wins ties. A customer's list is bounded by the ranker's k.
    """
    if k < 0 or not 0 <= relevance <= 1:
        raise ValueError("k must not be negative, relevance in [0, 1]")
    names = [c for c in attributes.columns if c != "article_id"]
    rows = ranked.select("customer_id", "article_id", "score", "pos").join(attributes.select("article_id", F.array(*names).alias("attributes")), "article_id", "left")

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", kind="stable")
        score, tags = pdf["score"].to_numpy(float), [None if a is None else list(a) for a in pdf["attributes"]]
        n = len(score)
        alike = np.array([[0.0 if a is None or b is None or not a else sum(x == y for x, y in zip(a, b)) / len(a) for b in tags] for a in tags]).reshape(n, n)
        near, free, taken = np.zeros(n), np.ones(n, bool), []
        while free.any() and len(taken) < k:
            value = np.where(free, relevance * score - (1 - relevance) * near, -np.inf)
            best = int(np.argmax(value))  # the first of the greatest
            taken.append(best)
            free[best] = False
            near = np.maximum(np.maximum(near, floor) if len(taken) > 1 else floor, alike[best])
        return pd.DataFrame({"customer_id": pdf["customer_id"].iloc[taken].tolist(), "article_id": pdf["article_id"].iloc[taken].tolist(), "pos": range(1, len(taken) + 1)})

    kinds = dict(ranked.dtypes)
    return rows.groupBy("customer_id").applyInPandas(greedy, f"customer_id {kinds['customer_id']}, article_id {kinds['article_id']}, pos int")
