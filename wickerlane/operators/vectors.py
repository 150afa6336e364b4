"""Vectors of articles and customers: usable rows, means, exact search in blocks, content similarity."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickerlane.operators.history import recent_unique
from wickerlane.operators.popularity import log_popularity, top_by
from wickerlane.operators.temporal import before, lookback

METRICS = ("cosine", "dot", "l2")


def usable(vector: str, dim: Column | int) -> Column:
    """Not null, of the dimension, only finite numbers, not all zero."""
    v = F.col(vector)
    low, high = F.array_min(v), F.array_max(v)  # NaN is the greatest of all
    fine = ~F.isnan(high) & (high < float("inf")) & (low > float("-inf")) & ((low != 0) | (high != 0)) & ~F.exists(v, lambda x: x.isNull())
    return F.coalesce(v.isNotNull() & (F.size(v) == (F.lit(dim) if isinstance(dim, int) else dim)) & fine, F.lit(False))


def newest(df: DataFrame, group: str, item: str, version: str, vector: str, dims: DataFrame) -> DataFrame:
    """``grp, item, id, vec`` (array of double): the newest usable vector of each item in a group.

    ``dims`` (``grp``, ``dim``) gives the dimension per group. Rows with a null group, item or version are left out.
    """
    rows = df.select(
        F.col(f"`{group}`").alias("grp"), F.col(f"`{item}`").alias("item"), F.col(f"`{version}`").cast("bigint").alias("id"), F.col(f"`{vector}`").alias("vec")
    ).dropna(subset=["grp", "item", "id", "vec"])
    rows = rows.join(dims.select("grp", "dim").distinct(), "grp").where(usable("vec", F.col("dim")))
    last = rows.groupBy("grp", "item").agg(F.max_by(F.struct("id", "vec"), "id").alias("r"))
    return last.select("grp", "item", "r.id", F.col("r.vec").cast("array<double>").alias("vec"))


def mean_vectors(rows: DataFrame, key: str, vector: str = "vec") -> DataFrame:
    """``key, vec``: the mean of each key's vectors, of which there are few (a bounded history)."""
    gathered = rows.groupBy(key).agg(F.collect_list(vector).alias("vs"))
    mean = F.expr("transform(sequence(0, size(vs[0]) - 1), i -> aggregate(vs, 0D, (a, v) -> a + v[i]) / size(vs))")
    return gathered.select(key, mean.alias("vec"))


def _blocks(df: DataFrame, id_col: str, size: int, name: str) -> tuple[DataFrame, int, int]:
    """Rows packed into blocks of about ``size`` (ids and vectors), the number of blocks, and of bytes in all. One aggregate decides."""
    rows, dim = df.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    n = max(1, ceil(rows / size))
    keyed = df.select(F.pmod(F.xxhash64(id_col), F.lit(n)).alias(name), F.struct(F.col(id_col).alias("id"), F.col("vec")).alias("r"))
    packed = keyed.groupBy(name).agg(F.collect_list("r").alias(f"{name}_rows"))
    return packed, n, rows * (dim or 0) * 8


def _block_scores(metric: str, k: int, kind: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for queries, items in zip(pdf["q_rows"], pdf["i_rows"]):
                q, m = (np.array([np.asarray(r["vec"], dtype=np.float64) for r in x]) for x in (queries, items))
                if metric == "cosine":
                    q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
                    m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
                s = q @ m.T if metric != "l2" else -((q * q).sum(1)[:, None] - 2 * q @ m.T + (m * m).sum(1)[None, :])
                s = np.round(s, 9) + 0.0
                ids = np.array([r["id"] for r in items], dtype=object)
                order = np.argsort(ids, kind="stable")  # ties go to the smaller id
                s, ids = s[:, order], ids[order]
                n = min(k, s.shape[1])
                least = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n]
                rows, cols = np.nonzero(s >= least[:, None])  # the k best and what ties with the last of them
                order = np.lexsort((cols, -s[rows, cols], rows))
                rows, cols = rows[order], cols[order]
                starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
                first = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)])) < n
                rows, cols = rows[first], cols[first]
                yield pd.DataFrame({"query": [queries[i]["id"] for i in rows], "item": ids[cols], "score": s[rows, cols]})

    return run


def exact_search(queries: DataFrame, items: DataFrame, k: int, metric: str = "cosine", block: int = 2048, sent_whole: int = 64 << 20) -> DataFrame:
    """``query, item, score, rank``: the ``k`` best items of each query (``query, vec``) among all items (``item, vec``).

    Both sides are packed into blocks; each query block meets each item block by an equi-join on the block number, one matrix
    product scores the two, and only the k best of a block go on. Items of at most ``sent_whole`` bytes in all are
    broadcast, so no query moves again; more are exchanged by block. ``l2`` is the negative squared distance.
    """
    if k < 1 or metric not in METRICS:
        raise ValueError(f"k must be positive and metric one of {METRICS}")
    packed, n, held = _blocks(items, "item", block, "i")
    asked, m, _ = _blocks(queries, "query", block // 4, "q")
    # A task per query block: few bytes, but much to compute, so they must not be put together.
    asked = asked.repartition(m, "q").withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))))
    pairs = asked.join(F.broadcast(packed), "i") if held <= sent_whole else asked.join(packed, "i").repartition("i", "q")
    pairs = pairs.select("q_rows", "i_rows")
    kinds = {**dict(queries.dtypes), **dict(items.dtypes)}
    scored = pairs.mapInPandas(_block_scores(metric, k, kinds["item"]), f"query {kinds['query']}, item {kinds['item']}, score double")
    return top_by(scored, ["query"], k, ("score desc", "item"))


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def cosine(a: str, b: str) -> Column:
    """Cosine of two array columns, on the JVM; for pairs that are already joined."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.coalesce(F.when(norm > 0, _dot(a, b) / norm), F.lit(0.0))


def history_vectors(tx: DataFrame, cutoff: dt.date, targets: DataFrame, items: DataFrame, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """Bounded histories over articles that have a vector, and the mean vector of each: ``(history, queries)``."""
    known = before(tx, cutoff).join(targets.select("customer_id"), "customer_id", "left_semi").join(items.select(F.col("item").alias("article_id")), "article_id", "left_semi")
    history = recent_unique(known, most=most)
    joined = history.join(items.select(F.col("item").alias("article_id"), "vec"), "article_id")
    return history, mean_vectors(joined, "customer_id").withColumnRenamed("customer_id", "query")


def content_similarity(
    tx: DataFrame, cutoff: dt.date, targets: DataFrame, items: DataFrame, k: int = 12, history_items: int = 8, exclude_history: bool = True, prior_weight: float = 0.0, prior_days: int | None = None, pool: int | None = None
) -> DataFrame:
    """``customer_id, article_id, score, rank``: articles nearest to the mean of the history's vectors.

    With a prior, the ``pool`` nearest are reranked by (1 - w) cosine + w log-popularity, then cosine, then article.
    """
    if not 0 <= prior_weight <= 1:
        raise ValueError("prior_weight must lie in [0, 1]")
    size = max(k, pool or k)
    history, queries = history_vectors(tx, cutoff, targets, items, history_items)
    near = exact_search(queries, items, size + (history_items if exclude_history else 0)).select(F.col("query").alias("customer_id"), F.col("item").alias("article_id"), F.col("score").alias("cosine"))
    if exclude_history:
        near = near.join(history.select("customer_id", "article_id"), ["customer_id", "article_id"], "left_anti")
    near = top_by(near, ["customer_id"], size, ("cosine desc", "article_id")).drop("rank")
    if not prior_weight:
        return top_by(near.withColumnRenamed("cosine", "score"), ["customer_id"], k, ("score desc", "article_id"))
    past = before(tx, cutoff) if prior_days is None else lookback(tx, cutoff, prior_days)
    prior = log_popularity(past).select("article_id", F.col("score").alias("prior"))
    mixed = near.join(prior, "article_id", "left").withColumn("score", F.round((1 - prior_weight) * F.col("cosine") + prior_weight * F.coalesce("prior", F.lit(0.0)), 9))
    return top_by(mixed, ["customer_id"], k, ("score desc", "cosine desc", "article_id")).select("customer_id", "article_id", "score", "rank")


def prior_powered_similarity(tx: DataFrame, cutoff: dt.date, targets: DataFrame, items: DataFrame, k: int = 50, days: int = 90, most: int = 20, alpha: float = 0.5, prior_days: int = 7) -> DataFrame:
    """Cosine times prior to the power ``alpha``, over the last ``most`` purchases of ``days`` (repeats counted), own articles left out.

    Every article is scored before the cut, so an article far down by cosine alone can still come first.
    """
    vec = items.select(F.col("item").alias("article_id"), "vec")
    mine = lookback(tx, cutoff, days).join(targets.select("customer_id"), "customer_id", "left_semi").join(vec.select("article_id"), "article_id", "left_semi")
    last = top_by(mine.select("customer_id", "article_id", "seq"), ["customer_id"], most, ("seq desc",))
    queries = mean_vectors(last.join(vec, "article_id"), "customer_id").withColumnRenamed("customer_id", "query")
    prior = log_popularity(lookback(tx, cutoff, prior_days)).select("article_id", F.col("score").alias("prior"))
    # cos * prior^alpha is the dot product with the unit vector scaled by the prior: one search serves.
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v * v))
    scaled = vec.join(prior, "article_id").select(F.col("article_id").alias("item"), "vec", (F.pow("prior", F.lit(alpha)) / norm).alias("f"))
    scaled = scaled.select("item", F.transform("vec", lambda x: x * F.col("f")).alias("vec"))
    unit = queries.select("query", "vec", norm.alias("f")).where(F.col("f") > 0).select("query", F.transform("vec", lambda x: x / F.col("f")).alias("vec"))
    near = exact_search(unit, scaled, k + most, metric="dot").select(F.col("query").alias("customer_id"), F.col("item").alias("article_id"), "score")
    near = near.join(last.select("customer_id", "article_id").distinct(), ["customer_id", "article_id"], "left_anti")
    return top_by(near, ["customer_id"], k, ("score desc", "article_id"))


def pair_scores(pairs: DataFrame, queries: DataFrame, items: DataFrame, score=cosine, name: str = "cosine") -> DataFrame:
    """``customer_id, article_id`` and a score of given pairs; 0 where either has no vector. Each pair is scored once."""
    once = pairs.select("customer_id", "article_id").distinct()
    joined = once.join(queries.select(F.col("query").alias("customer_id"), F.col("vec").alias("a")), "customer_id", "left").join(items.select(F.col("item").alias("article_id"), F.col("vec").alias("b")), "article_id", "left")
    return joined.select("customer_id", "article_id", F.round(F.coalesce(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), score("a", "b")), F.lit(0.0)), 9).alias(name))


def pair_dots(pairs: DataFrame, queries: DataFrame, items: DataFrame) -> DataFrame:
    return pair_scores(pairs, queries, items, _dot, "two_tower_score")


def aligned(vocabulary: DataFrame, items: DataFrame, dim: int) -> DataFrame:
    """Vectors in the order of a vocabulary (``idx, item``); an item without one gets a row of zeros."""
    return vocabulary.join(items.select("item", "vec"), "item", "left").select("idx", "item", F.coalesce("vec", F.array_repeat(F.lit(0.0), dim)).alias("vec"))
