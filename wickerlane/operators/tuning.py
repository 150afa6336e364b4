"""Choosing weights of the deterministic ranker on one window and reporting on a later one."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickerlane.operators.features import Weights, deterministic_score, linear_names
from wickerlane.operators.popularity import top

# The default grid.
GRID = {
    "garment_group_popularity_presence": (0.2, 0.4, 0.6, 0.8), "garment_group_popularity_score": (0.10, 0.25, 0.40), "age_segment_popularity_presence": (0.0, 0.15, 0.30, 0.45),
    "age_segment_popularity_score": (0.0, 0.10, 0.20), "source_count": (0.0, 0.05, 0.10), "best_rank": (0.0, 0.05),
}


def trials(grid: dict[str, tuple[float, ...]] = GRID) -> list[dict[str, float]]:
    if not grid or any(not v for v in grid.values()):
        raise ValueError("an empty grid")
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def evaluate_trials(features: DataFrame, found: DataFrame, tried: list[dict[str, float]], k: int = 12) -> DataFrame:
    """``trial, map, recall`` of each weighting over labelled customers.

    ``features`` carry ``label``. The score is linear in the tuned weights, so the scores of all trials are one matrix
    product of the rows and the weights. Rows are exchanged once, by customer; of customers without a label among their
    candidates none are, since no ranking can win them anything. A task ranks one customer's rows under all trials at
    once and gives out sums per trial only.
    """
    tuned = sorted(tried[0])
    base = deterministic_score(Weights({t: 0.0 for t in tuned}))
    terms = {}
    for t in tuned:
        if t == "source_count":
            terms[t] = F.col("source_count").cast("double")
        elif t == "best_rank":
            terms[t] = F.coalesce(1.0 / F.col("best_rank"), F.lit(0.0))
        else:
            source, part = t.rsplit("_", 1)
            value = {"presence": F.lit(1.0), "score": F.log1p(F.col(f"{source}_score")) if source == "co_visitation" else F.col(f"{source}_score"), "rank": 1.0 / F.col(f"{source}_rank")}[part]
            terms[t] = F.when(F.col(f"{source}_rank").isNotNull(), value).otherwise(0.0)
    xs = [f"x_{i}" for i in range(len(tuned))]
    slim = features.select("customer_id", "article_id", "label", F.col("source_count").cast("bigint"), F.coalesce("best_rank", F.lit(10**9)).alias("rank_key"), base.alias("base"), *[terms[t].alias(x) for t, x in zip(tuned, xs)])
    sizes = found.groupBy("customer_id").agg(F.count_distinct("article_id").alias("labels"))
    customers = sizes.agg(F.count(F.lit(1)).alias("customers"))
    reached = features.where("label = 1").select("customer_id").distinct().join(sizes, "customer_id")
    rows = slim.join(reached, "customer_id").repartition("customer_id").sortWithinPartitions("customer_id", F.desc("source_count"), "rank_key", "article_id")
    weights = np.array([[w[t] for t in tuned] for w in tried], dtype=float).T

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        won, got = np.zeros(len(tried)), np.zeros(len(tried))

        def judge(pdf: pd.DataFrame) -> None:
            scores = np.round(pdf["base"].to_numpy()[:, None] + pdf[xs].to_numpy() @ weights, 9)
            first = np.argsort(-scores, axis=0, kind="stable")[:k]
            hit = (pdf["label"].to_numpy() == 1)[first]
            labels = int(pdf["labels"].iloc[0])
            precision = np.cumsum(hit, axis=0) / np.arange(1, len(first) + 1)[:, None]
            won[:] += (precision * hit).sum(axis=0) / min(labels, k)
            got[:] += hit.sum(axis=0) / labels

        held: pd.DataFrame | None = None
        for pdf in batches:  # a customer's rows may go on in the next batch
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            names = pdf["customer_id"].to_numpy()
            cuts = np.flatnonzero(names[1:] != names[:-1]) + 1
            for a, z in zip(np.r_[0, cuts[:-1]], cuts):
                judge(pdf.iloc[a:z])
            held = pdf.iloc[cuts[-1] if len(cuts) else 0 :]
        if held is not None and len(held):
            judge(held)
        yield pd.DataFrame({"trial": range(len(tried)), "ap": won, "rc": got})

    sums = rows.mapInPandas(run, "trial int, ap double, rc double").groupBy("trial").agg(F.sum("ap").alias("ap"), F.sum("rc").alias("rc"))
    total = sums.join(F.broadcast(customers), F.lit(True))
    share = lambda c: F.round(F.when(F.col("customers") > 0, F.col(c) / F.col("customers")).otherwise(0.0), 9)
    return total.select("trial", share("ap").alias("map"), share("rc").alias("recall"))


def best(results: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` best trials: by MAP, then recall, then the order of the grid."""
    return top(results, n, ("map desc", "recall desc", "trial"))


def rolling_summary(windows: DataFrame) -> DataFrame:
    """Over windows of ``cutoff, baseline, ranked``: mean, least and greatest gain and how many windows improved."""
    gain = F.col("ranked") - F.col("baseline")
    return windows.agg(F.count(F.lit(1)).alias("windows"), F.avg(gain).alias("mean_gain"), F.min(gain).alias("least_gain"), F.max(gain).alias("greatest_gain"), F.count_if(gain > 0).alias("improved"))


__all__ = ["GRID", "best", "evaluate_trials", "linear_names", "rolling_summary", "trials"]
