"""``python -m wickerlane COMMAND --data DIR --output PATH …``: the pipeline's steps from the command line.

``--data`` holds the tables as parquet, or as CSV with a header (``transactions_train``, ``articles``, ``customers``, and what a
step needs besides). A step writes parquet to ``--output``; a report is written as sorted JSON.
"""

from __future__ import annotations

import argparse
import datetime as dt
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wickerlane.functions.text import label
from wickerlane.operators import behavioral, candidates, content, diagnostics, eda, fusion, metrics, popularity, reports, submission, temporal, training, tuning, validate, vectors
from wickerlane.operators import features as ft
from wickerlane.operators.temporal import Split
from wickerlane.workspace import filesystem, materialize, ship

COMMANDS: dict[str, tuple[Callable[[Step], DataFrame], bool]] = {}


class Step:
    """The tables and settings of one call."""

    def __init__(self, spark: SparkSession, a: argparse.Namespace):
        self.spark, self.a, self.k = spark, a, a.k

    def table(self, name: str) -> DataFrame:
        for path, read in ((f"{self.a.data}/{name}.parquet", self.spark.read.parquet), (f"{self.a.data}/{name}.csv", lambda p: self.spark.read.csv(p, header=True))):
            fs, p = filesystem(self.spark, path)
            if fs.exists(p):
                df = read(path)
                return df.toDF(*[c.lower() for c in df.columns])
        raise FileNotFoundError(f"{self.a.data}: no table {name}")

    @cached_property
    def tx(self) -> DataFrame:
        t = self.table("transactions_train")
        seq = F.col("tx_seq") if "tx_seq" in t.columns else F.monotonically_increasing_id()
        return t.select(seq.alias("seq"), F.col("t_dat").cast("date").alias("t_dat"), "customer_id", "article_id", F.col("price").cast("double").alias("price"), F.col("sales_channel_id").cast("int").alias("sales_channel_id")).dropna(subset=["t_dat", "customer_id", "article_id"])

    @cached_property
    def split(self) -> Split:
        cut = self.a.cutoff or popularity.last_day(self.tx) - dt.timedelta(days=self.a.horizon - 1)
        return Split(cut, self.a.horizon)

    @cached_property
    def customers(self) -> DataFrame:
        return self.table("customers")

    @cached_property
    def universe(self) -> DataFrame:
        return self.customers.select("customer_id").distinct()

    @cached_property
    def articles(self) -> DataFrame:
        return self.table("articles")

    def attribute(self, column: str) -> DataFrame:
        return self.articles.select("article_id", label(column).alias("value"))

    def found(self, split: Split | None = None) -> DataFrame:
        return temporal.labels(self.tx, split or self.split)

    def candidates(self, split: Split | None = None, targets: DataFrame | None = None) -> DataFrame:
        split = split or self.split
        who = targets if targets is not None else temporal.label_customers(self.found(split), self.universe)
        return candidates.every_source(self.tx, split.cutoff, who, popularity.age_segments(self.customers, 10, "unknown"), self.attribute("garment_group_name"), self.attribute("product_code"), self.k, self.a.lookback)

    def features(self, split: Split | None = None) -> DataFrame:
        return materialize(ft.with_labels(ft.pair_features(self.candidates(split)), self.found(split)), "features")

    def linear(self, split: Split | None = None) -> DataFrame:
        return self.features(split).select("customer_id", "article_id", "label", "source_count", "best_rank", ft.deterministic_score().alias("deterministic_score"), *ft.linear_vector())

    def matrix(self, split: Split | None = None) -> DataFrame:
        split, rows = split or self.split, self.linear(split)
        return materialize(rows.join(behavioral.features(self.tx, split.cutoff, rows, self.articles), ["customer_id", "article_id"]), "matrix")

    def score(self, ranked: DataFrame, name: str) -> DataFrame:
        return metrics.summary(metrics.per_customer(ranked, self.found(), self.k)).withColumn("ranker", F.lit(name))

    def items(self) -> DataFrame:
        runs = self.table("embedding_runs").select(F.col("embeddings_path").alias("grp"), F.col("vector_dimension").cast("int").alias("dim"))
        every = vectors.newest(self.table("article_vectors"), "embeddings_path", "article_id", "embedding_index", "vector", runs)
        path = self.a.embeddings or runs.agg(F.min("grp")).first()[0]
        return every.where(F.col("grp") == path).select("item", "id", "vec")


def command(name: str, report: bool = False):
    def register(f):
        COMMANDS[name] = (f, report)
        return f

    return register


@command("validate-data-contract", report=True)
def _(s: Step) -> DataFrame:
    out = validate.validate(s.table("transactions_train"), validate.TRANSACTIONS)
    return out.unionByName(validate.validate(s.articles, validate.ARTICLES)).unionByName(validate.validate(s.customers, validate.CUSTOMERS))


@command("eda-report", report=True)
def _(s: Step) -> DataFrame:
    parts = {"months": eda.months(s.tx), "weekdays": eda.weekdays(s.tx), "channels": eda.channels(s.tx), "depth": eda.depth(s.tx, s.universe), "repeats": eda.repeat_purchases(s.tx), "gaps": eda.gaps(s.tx), "customers": eda.customer_metadata(s.customers)}
    out = None
    for name, df in parts.items():
        row = df.select(F.lit(name).alias("section"), F.to_json(F.struct(*df.columns)).alias("row"))
        out = row if out is None else out.unionByName(row)
    return out


@command("pin-baseline-champion", report=True)
def _(s: Step) -> DataFrame:
    """Of a table ``runs`` (name, config as JSON, offline, public)."""
    import json

    runs = [reports.Run(r["name"], json.loads(r["config"]), float(r["offline"]), None if r["public"] is None else float(r["public"])) for r in s.table("runs").collect()]
    best = reports.champion(runs)
    return s.spark.createDataFrame([(best.name, best.key, best.offline, best.public)] if best else [], "name string, key string, offline double, public double")


command("compute-perfect-ranker-ceiling", report=True)(lambda s: metrics.ceiling(s.candidates(), s.found(), s.k))
command("summarize-temporal-split", report=True)(lambda s: temporal.split_summary(s.tx, s.split))
command("validate-submission", report=True)(lambda s: validate.validate_submission(s.table("submission"), s.universe, s.articles, s.k))


def _baseline(s: Step, cutoff: dt.date, who: DataFrame) -> DataFrame:
    return submission.baseline_predictions(s.tx, cutoff, who, s.k, s.a.lookback)


command("evaluate-baseline", report=True)(lambda s: s.score(_baseline(s, s.split.cutoff, temporal.label_customers(s.found(), s.universe)), "baseline"))
command("generate-baseline-submission")(lambda s: submission.as_text(_baseline(s, submission.final_cutoff(s.tx), s.universe), s.universe))


@command("candidate-diagnostics", report=True)
def _(s: Step) -> DataFrame:
    return diagnostics.SourceDiagnostics(s.tx, s.split.cutoff, s.universe, s.found(), days=s.a.lookback).report()


command("export-candidates")(lambda s: s.candidates())


@command("evaluate-ranker-baseline", report=True)
def _(s: Step) -> DataFrame:
    rows = s.features()
    return s.score(ft.deterministic_rank(rows, s.k), "deterministic").unionByName(s.score(ft.source_order(rows, s.k), "source_order"))


@command("tune-deterministic-ranker", report=True)
def _(s: Step) -> DataFrame:
    """The ten best weightings of the window before, with what the best and the default one reach on the evaluation window."""
    tried, before = tuning.trials(), s.split.previous()
    top = tuning.best(tuning.evaluate_trials(s.features(before), s.found(before), tried, s.k)).select(F.lit("selection").alias("window"), "trial", "map", "recall")
    chosen = [tried[r["trial"]] for r in top.orderBy(F.desc("map"), F.desc("recall"), "trial").limit(1).collect()]
    default = {n: ft.Weights().of(n) for n in tried[0]}
    later = tuning.evaluate_trials(s.features(), s.found(), [default, *chosen], s.k)
    return top.unionByName(later.select(F.when(F.col("trial") == 0, "evaluation, default").otherwise("evaluation, selected").alias("window"), "trial", "map", "recall"))


def _linear_rank(s: Step) -> DataFrame:
    weights = training.fit_linear(materialize(s.linear(s.split.previous()), "linear-rows"))
    return ft.rank_by(s.linear().withColumn("score", training.linear_score(weights)), s.k, "score desc").select("customer_id", "article_id", "pos")


command("evaluate-learned-ranker-baseline", report=True)(lambda s: s.score(_linear_rank(s), "linear"))


def _tree_rank(s: Step) -> DataFrame:
    columns = [*ft.linear_names()[1:], "deterministic_score", *behavioral.names()]
    scored = training.tree_scores(training.fit_trees(s.matrix(s.split.previous()), columns), s.matrix(), columns)
    return ft.rank_by(ft.z_blend(scored, "deterministic_score", "model_score"), s.k, "blend desc").select("customer_id", "article_id", "pos")


def _submit(s: Step, ranked: DataFrame) -> DataFrame:
    return submission.as_text(submission.backfilled(ranked, s.tx, s.split.cutoff, s.universe, s.k, s.a.lookback), s.universe)


command("evaluate-lightgbm-behavioral-ranker", report=True)(lambda s: s.score(_tree_rank(s), "trees_blend"))
command("generate-lightgbm-behavioral-submission")(lambda s: _submit(s, _tree_rank(s)))
command("generate-learned-ranker-submission")(lambda s: _submit(s, _linear_rank(s)))


@command("generate-deterministic-ranker-submission")
def _(s: Step) -> DataFrame:
    cut = submission.final_cutoff(s.tx)
    rows = ft.pair_features(s.candidates(Split(cut), s.universe))
    ranked = ft.deterministic_rank(rows, s.k).select("customer_id", "article_id", "pos")
    return submission.as_text(submission.backfilled(ranked, s.tx, cut, s.universe, s.k, s.a.lookback), s.universe)


@command("rolling-ranker-validation", report=True)
def _(s: Step) -> DataFrame:
    splits = [Split(s.split.cutoff - dt.timedelta(days=i * s.a.horizon), s.a.horizon) for i in (2, 1, 0)]
    temporal.check_windows(splits)
    out = None
    for split in splits:
        rows, want = s.features(split), s.found(split)
        for name, ranked in (("deterministic", ft.deterministic_rank(rows, s.k)), ("source_order", ft.source_order(rows, s.k))):
            one = metrics.summary(metrics.per_customer(ranked, want, s.k)).select(F.lit(split.cutoff).alias("cutoff"), F.lit(name).alias("ranker"), "customers", "map", "recall")
            out = one if out is None else out.unionByName(one)
    return out


@command("export-two-tower-examples")
def _(s: Step) -> DataFrame:
    t = temporal.before(s.tx, s.split.cutoff)
    positives = training.positive_pairs(t, "latest_customer")
    no = training.negatives(positives, t, 1)
    return positives.select("customer_id", "article_id", F.lit(1).alias("label")).unionByName(no.select("customer_id", F.col("negative_id").alias("article_id"), F.lit(0).alias("label")))


def _factors(s: Step) -> tuple[DataFrame, DataFrame]:
    return training.factors(temporal.before(s.tx, s.split.cutoff))


@command("evaluate-two-tower-retrieval", report=True)
def _(s: Step) -> DataFrame:
    users, items = _factors(s)
    mine = users.join(temporal.label_customers(s.found(), s.universe).withColumnRenamed("customer_id", "query"), "query", "left_semi")
    near = vectors.exact_search(mine, items, s.k, "dot").select(F.col("query").alias("customer_id"), F.col("item").alias("article_id"), F.col("rank").alias("pos"))
    return s.score(near, "factors")


@command("train-two-tower")
def _(s: Step) -> DataFrame:
    users, items = _factors(s)
    return users.select(F.lit("customer").alias("side"), F.col("query").alias("id"), "vec").unionByName(items.select(F.lit("article").alias("side"), F.col("item").alias("id"), "vec"))


command("score-two-tower-candidates")(lambda s: vectors.pair_dots(s.candidates(), *_factors(s)))
command("inventory-article-images", report=True)(lambda s: content.image_inventory(s.table("article_images").select(F.col("image_relative_path").alias("path")), s.articles).groupBy("state").agg(F.count(F.lit(1)).alias("rows")))


def _content(s: Step) -> DataFrame:
    return content.content(s.articles, s.table("article_images").select("article_id", F.col("image_exists").cast("boolean").alias("there")))


command("export-article-content")(_content)
command("generate-article-embeddings")(lambda s: content.generate_embeddings(_content(s)))


@command("content-similarity-diagnostics", report=True)
def _(s: Step) -> DataFrame:
    who = temporal.label_customers(s.found(), s.universe)
    near = vectors.content_similarity(s.tx, s.split.cutoff, who, s.items(), s.k).withColumnRenamed("rank", "pos")
    return s.score(near, "content")


@command("blend-submissions")
def _(s: Step) -> DataFrame:
    """Fuse tables ``submission_1`` … ``submission_n`` (``--blend n``) by consensus rank fusion."""
    parts = None
    for i in range(1, s.a.blend + 1):
        ids = s.table(f"submission_{i}").select(F.lit(str(i)).alias("ranker"), "customer_id", F.posexplode(F.split("prediction", " ")).alias("p", "article_id"))
        one = ids.where(F.col("article_id") != "").select("ranker", "customer_id", "article_id", (F.col("p") + 1).alias("pos"))
        parts = one if parts is None else parts.unionByName(one)
    return submission.as_text(fusion.consensus_fusion(parts, most=s.k), s.universe)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="wickerlane", description=__doc__)
    p.add_argument("command", choices=sorted(COMMANDS))
    p.add_argument("--data", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--cutoff", type=dt.date.fromisoformat)
    p.add_argument("--horizon", type=int, default=7)
    p.add_argument("--lookback", type=int, default=7)
    p.add_argument("-k", type=int, default=12)
    p.add_argument("--embeddings")
    p.add_argument("--blend", type=int, default=2)
    return p


def run(spark: SparkSession, arguments: list[str]) -> None:
    a = parser().parse_args(arguments)
    ship(spark)
    plan, report = COMMANDS[a.command]
    out = plan(Step(spark, a))
    if report:
        reports.write_report(spark, out, a.output)
    else:
        out.write.mode("overwrite").parquet(a.output)
