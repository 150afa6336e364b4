"""A small two-tower model: embedding tables of customers and articles, trained on a bounded sample of examples."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickerlane.operators.popularity import top
from wickerlane.operators.vectors import exact_search


@dataclass(frozen=True)
class TrainingConfig:
    """What a training run may ask for; anything else is refused when it is made."""

    dim: int = 16
    epochs: int = 3
    rate: float = 0.05
    l2: float = 0.0001
    objective: str = "logistic"
    log_q: float = 0.0
    half_life_days: float | None = None
    batch: int = 256
    most_examples: int = 100_000
    seed: int = 42

    def __post_init__(self) -> None:
        if min(self.dim, self.epochs, self.batch, self.most_examples) < 1 or self.rate <= 0 or self.l2 < 0:
            raise ValueError("dim, epochs, batch, most_examples and rate must be positive, l2 not negative")
        if self.objective not in ("logistic", "bpr") or not 0 <= self.log_q <= 1 or (self.half_life_days is not None and self.half_life_days <= 0):
            raise ValueError("objective is logistic or bpr, log_q in [0, 1], half_life_days positive")


def train(examples: DataFrame, config: TrainingConfig = TrainingConfig(), today: dt.date | None = None) -> DataFrame:
    """``side, id, vec``: the embeddings of customers and articles, and of ``loss`` the mean loss of each epoch.

    ``examples`` have ``customer_id, article_id, label`` and ``day`` (may be null). More than ``most_examples`` are cut to those of
    the customers that come first by a hash: the fit is on a bounded sample by its nature, everything else is not.
    ``logistic`` fits each example, ``bpr`` each positive against a negative of its customer. Scores of articles are lowered
    by ``log_q`` times the log of their share among the positives; an example weighs half as much per half-life of age.
    """
    n = examples.count()
    rows = examples.select("customer_id", "article_id", F.col("label").cast("int"), F.col("day").cast("date"))
    if n > config.most_examples:
        rows = rows.where(F.pmod(F.xxhash64("customer_id"), F.lit(1_000_000)) < int(1_000_000 * config.most_examples / n)).limit(config.most_examples)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        c = config
        pdf = pdf.sort_values(["customer_id", "article_id", "label"], kind="stable").reset_index(drop=True)
        rng = np.random.default_rng(c.seed)
        users, u = np.unique(pdf["customer_id"].to_numpy(str), return_inverse=True)
        items, i = np.unique(pdf["article_id"].to_numpy(str), return_inverse=True)
        y = pdf["label"].to_numpy(float)
        p, q = (rng.uniform(-1, 1, (len(x), c.dim)) / np.sqrt(c.dim) for x in (users, items))
        share = np.bincount(i, weights=y, minlength=len(items)) + 1.0
        shift = c.log_q * np.log(share / share.sum())
        weight = np.ones(len(y))
        if c.half_life_days:
            days = pd.to_datetime(pdf["day"])
            last = pd.Timestamp(today) if today else days.max()
            weight = np.power(0.5, (last - days).dt.days.fillna(0).to_numpy(float) / c.half_life_days)
        if c.objective == "bpr":  # each positive beside a negative of the same customer
            neg = pd.DataFrame({"u": u[y == 0], "j": i[y == 0]})
            both = pd.DataFrame({"u": u[y == 1], "i": i[y == 1], "w": weight[y == 1]}).merge(neg, on="u")
            a, pos, other, w = (both[x].to_numpy() for x in ("u", "i", "j", "w"))
        else:
            a, pos, other, w = u, i, None, weight
        losses = []
        for _ in range(c.epochs):
            order, total = rng.permutation(len(a)), 0.0
            for start in range(0, len(order), c.batch):
                o = order[start : start + c.batch]
                x = (p[a[o]] * (q[pos[o]] if other is None else q[pos[o]] - q[other[o]])).sum(axis=1)
                x = x - (shift[pos[o]] if other is None else shift[pos[o]] - shift[other[o]])
                t = y[o] if other is None else np.ones(len(o))
                s = 0.5 * (1 + np.tanh(x / 2))
                total += float((w[o] * -(t * np.log(np.maximum(s, 1e-12)) + (1 - t) * np.log(np.maximum(1 - s, 1e-12)))).sum())
                g = (w[o] * (s - t))[:, None]
                du = g * (q[pos[o]] if other is None else q[pos[o]] - q[other[o]]) + c.l2 * p[a[o]]
                di = g * p[a[o]] + c.l2 * q[pos[o]]
                if other is not None:
                    np.add.at(q, other[o], -c.rate * (-g * p[a[o]] + c.l2 * q[other[o]]))
                np.add.at(p, a[o], -c.rate * du)
                np.add.at(q, pos[o], -c.rate * di)
            losses.append(total / max(1, len(order)))
        out = [("customer", k, v.tolist()) for k, v in zip(users, p)] + [("article", k, v.tolist()) for k, v in zip(items, q)]
        return pd.DataFrame([*out, *(("loss", str(e), [x]) for e, x in enumerate(losses))], columns=["side", "id", "vec"])

    return rows.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(fit, "side string, id string, vec array<double>")


def retrieve(users: DataFrame, items: DataFrame, k: int = 12, prior: DataFrame | None = None, weight: float = 0.0, pool: int | None = None) -> DataFrame:
    """``customer_id, article_id, score, pos``: dot product plus ``weight`` times the prior (``article_id, score``), over the ``pool`` most popular articles if one is given."""
    if prior is None and (weight or pool):
        raise ValueError("weight and pool need a prior")
    known = items
    if pool:
        known = items.join(top(prior, pool, ("score desc", "article_id")).select(F.col("article_id").alias("item")), "item", "left_semi")
    if weight:  # one more dimension: the prior, times 1 for every customer
        own = prior.select(F.col("article_id").alias("item"), F.col("score").alias("prior"))
        known = known.join(own, "item", "left").select("item", F.concat("vec", F.array(F.coalesce("prior", F.lit(0.0)) * weight)).alias("vec"))
        users = users.select("query", F.concat("vec", F.array(F.lit(1.0))).alias("vec"))
    near = exact_search(users, known, k, "dot")
    return near.select(F.col("query").alias("customer_id"), F.col("item").alias("article_id"), "score", F.col("rank").alias("pos"))


__all__ = ["TrainingConfig", "retrieve", "train"]
