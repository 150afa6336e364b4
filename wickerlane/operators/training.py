"""Training examples and models: positive pairs, negatives, vocabularies, linear and tree rankers, factor and word models."""

from __future__ import annotations

from math import log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wickerlane.operators.features import linear_names
from wickerlane.operators.popularity import top, top_by
from wickerlane.operators.running import running_sums
from wickerlane.workspace import materialize


def positive_pairs(tx: DataFrame, selection: str = "first", most: int | None = None) -> DataFrame:
    """``customer_id, article_id, n, first_seq, last_seq, last_day`` of bought pairs.

    ``first`` keeps the first pairs of the log, ``latest`` those bought last, ``latest_customer`` each customer's last pair.
    """
    if selection not in ("first", "latest", "latest_customer") or (most is not None and most < 1):
        raise ValueError("unknown selection or limit")
    pairs = tx.groupBy("customer_id", "article_id").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.max("t_dat").alias("last_day"))
    if selection == "latest_customer":
        pairs = top_by(pairs, ["customer_id"], 1, ("last_seq desc",)).drop("rank")
    if most is None:
        return pairs
    return top(pairs, most, ("first_seq",) if selection == "first" else ("last_seq desc",)).drop("rank")


def sampling_log_q(tx: DataFrame, smoothing: float = 1.0) -> DataFrame:
    """``article_id, q, log_q``: smoothed share of each article."""
    counts = tx.groupBy("article_id").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("size"))
    q = (F.col("n") + smoothing) / (F.col("all") + smoothing * F.col("size"))
    return counts.join(F.broadcast(total), F.lit(True)).select("article_id", q.alias("q"), F.log(q).alias("log_q"))


def vocabulary(df: DataFrame, column: str, first_index: int = 0) -> DataFrame:
    """``idx, item`` with contiguous indices in the order of the items."""
    items = df.select(F.col(column).alias("item")).dropna().distinct().withColumn("one", F.lit(1).cast("bigint"))
    return running_sums(items, "item", "one", "idx").select((F.col("idx") + first_index).alias("idx"), "item")


def negatives(pairs: DataFrame, tx: DataFrame, per_positive: int = 1, seed: int = 42, sampling: str = "random") -> DataFrame:
    """``customer_id, article_id, negative_id, negative_rank``: articles the customer never bought, for each positive pair.

    Every positive draws articles by a hash of (seed, customer, positive, number), twice as many as it needs: from the
    vocabulary for ``random``, from the rows of the log for ``popularity``, alternating for ``mixed``. Bought articles and
    repeats are dropped and the first ``per_positive`` kept. A positive that lacks some then walks the vocabulary from its
    first draw on, as many steps as its customer has bought articles and as it needs, so it has ``per_positive``
    negatives unless there are not so many articles it has not bought. The same seed gives the same draws.
    """
    if per_positive < 1 or sampling not in ("random", "popularity", "mixed"):
        raise ValueError("per_positive must be positive, sampling random, popularity or mixed")
    spark = pairs.sparkSession
    words = materialize(vocabulary(tx, "article_id"), "negative-words")
    size = words.count()
    weights = tx.groupBy("article_id").agg(F.count(F.lit(1)).alias("n"))
    # Popular draws: a position among all rows falls into the article's run of rows.
    runs = words.join(weights, words["item"] == weights["article_id"]).select("idx", "item", "n")
    total = runs.agg(F.sum("n")).first()[0] or 0
    if size == 0:
        return spark.createDataFrame([], "customer_id string, article_id string, negative_id string, negative_rank int")
    keys, hash_of = ["customer_id", "article_id"], lambda *more: F.xxhash64(F.lit(seed), "customer_id", "article_id", *more)
    draws = pairs.select(*keys).withColumn("number", F.explode(F.sequence(F.lit(0), F.lit(2 * per_positive - 1))))
    popular = {"random": F.lit(False), "popularity": F.lit(True), "mixed": F.col("number") % 2 == 1}[sampling]
    h = hash_of("number")
    draws = draws.withColumn("popular", popular).withColumn("idx", F.pmod(h, F.lit(size))).withColumn("spot", F.pmod(h, F.lit(max(1, total))))
    picked = draws.where("NOT popular").join(words, "idx").select(*keys, "number", F.col("item").alias("negative_id"))
    if sampling != "random":
        # Runs longer than a step are listed under each step they cross, so that a spot finds its run by an equi-join.
        step = max(1, total // max(1, size))
        ends = running_sums(runs, "idx", "n", "start").withColumn("end", F.col("start") + F.col("n"))
        listed = ends.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / step), F.floor((F.col("end") - 1) / step)))).select("cell", "start", "end", "item")
        hit = draws.where("popular").withColumn("cell", F.floor(F.col("spot") / step)).join(listed, "cell").where((F.col("spot") >= F.col("start")) & (F.col("spot") < F.col("end")))
        picked = picked.unionByName(hit.select(*keys, "number", F.col("item").alias("negative_id")))
    bought = tx.select("customer_id", F.col("article_id").alias("negative_id")).distinct()

    def clean(rows: DataFrame) -> DataFrame:
        return rows.join(bought, ["customer_id", "negative_id"], "left_anti").groupBy(*keys, "negative_id").agg(F.min("number").alias("number"))

    drawn = materialize(top_by(clean(picked), keys, per_positive, ("number",)).drop("rank"), "negative-draws")
    have = drawn.groupBy(*keys).agg(F.count(F.lit(1)).alias("have"))
    lacking = pairs.select(*keys).join(have, keys, "left").where(F.coalesce("have", F.lit(0)) < per_positive)
    owned = bought.groupBy("customer_id").agg(F.count(F.lit(1)).alias("owned"))
    steps = F.least(F.lit(size), F.coalesce("owned", F.lit(0)) + 2 * per_positive).cast("int")
    walk = lacking.join(owned, "customer_id", "left").withColumn("step", F.explode(F.sequence(F.lit(0), steps - 1)))
    walk = walk.withColumn("idx", F.pmod(hash_of(F.lit(0)) + F.col("step"), F.lit(size))).join(words, "idx").select(*keys, (F.col("step") + 2 * per_positive).alias("number"), F.col("item").alias("negative_id"))
    every = drawn.unionByName(clean(walk)).groupBy(*keys, "negative_id").agg(F.min("number").alias("number"))
    return top_by(every, keys, per_positive, ("number",)).select(*keys, "negative_id", F.col("rank").alias("negative_rank"))


def baskets(tx: DataFrame, by_day: bool = True, least: int = 2) -> DataFrame:
    """Sequences for item embeddings: ``customer_id[, t_dat], items`` in the order of the log, of at least ``least`` items."""
    keys = ["customer_id", "t_dat"] if by_day else ["customer_id"]
    rows = tx.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", "article_id"))).alias("l"))
    return rows.where(F.size("l") >= least).select(*keys, F.transform("l", lambda x: x["article_id"]).alias("items"))


def item_vectors(sentences: DataFrame, dim: int = 64, window: int = 5, least_count: int = 5, rounds: int = 5, seed: int = 7) -> DataFrame:
    """``item, vec`` by skip-gram over baskets (hierarchical softmax)."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    model = Word2Vec(vectorSize=dim, windowSize=window, minCount=least_count, maxIter=rounds, seed=seed, inputCol="items", outputCol="v").fit(sentences.select("items"))
    return model.getVectors().select(F.col("word").alias("item"), vector_to_array("vector").alias("vec"))


def factors(tx: DataFrame, rank: int = 16, rounds: int = 5, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Customer and article factors by implicit alternating least squares: ``(query, vec)`` and ``(item, vec)``."""
    from pyspark.ml.recommendation import ALS

    users, items = vocabulary(tx, "customer_id"), vocabulary(tx, "article_id")
    counts = tx.groupBy("customer_id", "article_id").agg(F.count(F.lit(1)).cast("float").alias("n"))
    coded = counts.join(users.select(F.col("idx").cast("int").alias("u"), F.col("item").alias("customer_id")), "customer_id").join(items.select(F.col("idx").cast("int").alias("i"), F.col("item").alias("article_id")), "article_id")
    model = ALS(rank=rank, maxIter=rounds, implicitPrefs=True, seed=seed, userCol="u", itemCol="i", ratingCol="n").fit(coded.select("u", "i", "n"))
    named = lambda f, words, name: f.join(words, f["id"] == words["idx"]).select(F.col("item").alias(name), F.col("features").cast("array<double>").alias("vec"))
    return named(model.userFactors, users, "query"), named(model.itemFactors, items, "item")


def positive_weight(rows: DataFrame, most: float = 10.0) -> float:
    p, n = rows.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    return min(n / p, most) if p else 1.0


def fit_linear_exact(rows: DataFrame, epochs: int = 3, rate: float = 0.01, l2: float = 0.001, weight: float | None = None, most_rows: int = 200_000) -> list[float]:
    """Weights by sequential stochastic gradient descent in the order (customer, article).

    The order makes it sequential by definition, so it is fitted on a sample in one group: of more than ``most_rows`` rows
    those of the customers that come first by a hash. ``fit_linear`` takes all rows.
    """
    n = rows.count()
    if n > most_rows:
        rows = rows.where(F.pmod(F.xxhash64("customer_id"), F.lit(1_000_000)) < int(1_000_000 * most_rows / n)).limit(most_rows)
    w = positive_weight(rows) if weight is None else weight
    names = linear_names()

    def descend(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["customer_id", "article_id"])
        x, y = pdf[names].to_numpy(float), pdf["label"].to_numpy(float)
        beta, penalty = np.zeros(len(names)), np.full(len(names), l2)
        penalty[0] = 0.0
        for _ in range(epochs):
            for a, t in zip(x, y):
                z = float(a @ beta)
                p = 1 / (1 + np.exp(-z)) if z >= 0 else np.exp(z) / (1 + np.exp(z))
                beta -= rate * ((p - t) * (w if t else 1.0) * a + penalty * beta)
        return pd.DataFrame({"i": range(len(beta)), "w": beta})

    fitted = rows.select("customer_id", "article_id", "label", *names).withColumn("one", F.lit(1)).groupBy("one").applyInPandas(descend, "i int, w double")
    return [r["w"] for r in sorted(fitted.collect(), key=lambda r: r["i"])]


def fit_linear(rows: DataFrame, l2: float = 0.001, rounds: int = 50) -> list[float]:
    """Weights by distributed weighted logistic regression (another optimum than the sequential one's)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    names = linear_names()
    w = positive_weight(rows)
    data = VectorAssembler(inputCols=names[1:], outputCol="x").transform(rows.withColumn("label", F.col("label").cast("double"))).withColumn("w", F.when(F.col("label") == 1, w).otherwise(1.0))
    model = LogisticRegression(featuresCol="x", labelCol="label", weightCol="w", regParam=l2, maxIter=rounds, standardization=False).fit(data.select("x", "label", "w"))
    return [float(model.intercept), *map(float, model.coefficients)]


def linear_score(weights: list[float]):
    """The weighted sum of the 48 inputs as one expression."""
    total = F.lit(0.0)
    for n, w in zip(linear_names(), weights, strict=True):
        if w:
            total = total + F.lit(float(w)) * F.col(n)
    return F.round(total, 9)


def fit_trees(rows: DataFrame, columns: list[str], trees: int = 20, depth: int = 4, seed: int = 42):
    """Gradient-boosted trees on single rows (squared loss on the label), in place of a listwise objective."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    data = VectorAssembler(inputCols=columns, outputCol="x").transform(rows.withColumn("label", F.col("label").cast("double")))
    return GBTRegressor(featuresCol="x", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.1, subsamplingRate=0.9, seed=seed).fit(data.select("x", "label"))


def fit_forest(rows: DataFrame, columns: list[str], trees: int = 20, depth: int = 6, seed: int = 42):
    """A random forest on single rows: another kind of model beside the boosted trees."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    data = VectorAssembler(inputCols=columns, outputCol="x").transform(rows.withColumn("label", F.col("label").cast("double")))
    return RandomForestRegressor(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, subsamplingRate=0.9, seed=seed).fit(data.select("x", "label"))


def tree_scores(model, rows: DataFrame, columns: list[str], name: str = "model_score") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return model.transform(VectorAssembler(inputCols=columns, outputCol="x").transform(rows)).withColumn(name, F.round("prediction", 9)).drop("x", "prediction")


def bagged_scores(rows: DataFrame, target: DataFrame, columns: list[str], seeds: tuple[int, ...] = (1, 2, 3), **options) -> DataFrame:
    """Mean of models that differ in their seed: ``model_score``."""
    out = target
    for s in seeds:
        out = tree_scores(fit_trees(rows, columns, seed=s, **options), out, columns, f"bag_{s}")
    total = sum((F.col(f"bag_{s}") for s in seeds[1:]), F.col(f"bag_{seeds[0]}"))
    return out.withColumn("model_score", F.round(total / len(seeds), 9)).drop(*[f"bag_{s}" for s in seeds])


def log_loss(rows: DataFrame, score, eps: float = 1e-12) -> DataFrame:
    p = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), 1 / (1 + F.exp(-score))))
    return rows.agg(F.avg(F.when(F.col("label") == 1, -F.log(p)).otherwise(-F.log(1 - p))).alias("loss"))


LN2 = log(2.0)
