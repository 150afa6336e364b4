"""Article content: normalized text, prompts, image inventory, priorities, embedding caches."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wickerlane.functions.text import path_of_image, squeezed
from wickerlane.operators.popularity import article_stats, top
from wickerlane.operators.temporal import before
from wickerlane.workspace import filesystem

# The text fields of a prompt, in order.
TEXT_FIELDS = (
    "prod_name", "product_type_name", "product_group_name", "graphical_appearance_name", "colour_group_name", "perceived_colour_value_name", "perceived_colour_master_name",
    "department_name", "index_name", "index_group_name", "section_name", "garment_group_name", "detail_desc",
)


def content(articles: DataFrame, images: DataFrame, fields: tuple[str, ...] = TEXT_FIELDS) -> DataFrame:
    """``article_id``, the fields with white space squeezed, the prompt ``label: value | …`` of those that are not empty, and the image.

    ``images`` has ``article_id`` and a boolean ``there``; several rows of an article count as one.
    """
    there = images.groupBy("article_id").agg(F.max(F.coalesce("there", F.lit(False))).alias("image_exists"))
    clean = {f: F.coalesce(F.trim(F.regexp_replace(f, r"\s+", " ")), F.lit("")) for f in fields}
    rows = articles.select("article_id", *[c.alias(f) for f, c in clean.items()])
    parts = [F.when(F.col(f) != "", F.concat(F.lit(f.replace("_", " ") + ": "), F.col(f))) for f in fields]
    out = rows.join(there, "article_id", "left").withColumn("image_exists", F.coalesce("image_exists", F.lit(False)))
    return out.withColumn("combined_text", F.concat_ws(" | ", *parts)).withColumn("image_relative_path", F.when(F.col("image_exists"), path_of_image("article_id")).otherwise(""))


def priority(tx: DataFrame, cutoff, most: int) -> DataFrame:
    """Articles most worth embedding first: ``article_id, rank`` by purchases, recency, id."""
    return top(article_stats(before(tx, cutoff)), most).select("article_id", "rank")


def prioritized(rows: DataFrame, ranks: DataFrame, most: int) -> DataFrame:
    """The first ``most`` articles by rank; those without one follow by id."""
    return rows.join(ranks, "article_id", "left").orderBy(F.coalesce("rank", F.lit(2**31 - 1)), "article_id").limit(most)


def image_inventory(found: DataFrame, articles: DataFrame) -> DataFrame:
    """``article_id, path, state`` of articles and image paths: ``matched``, ``missing``, ``extra`` or ``misplaced``.

    ``found`` has ``path``. A path is canonical if it is images/<first three digits>/<article id>.jpg. Articles have one row,
    paths of unknown articles or other places one each; repeated paths count once.
    """
    named = found.select("path").where(F.col("path").isNotNull() & (F.col("path") != "")).distinct()
    named = named.withColumn("article_id", F.regexp_extract("path", r"\Aimages/[0-9]{3}/([0-9]{10})\.jpg\z", 1))
    canonical = named.where((F.col("article_id") != "") & (F.col("path") == path_of_image("article_id")))
    other = named.join(canonical.select("path"), "path", "left_anti").select(F.lit(None).cast("string").alias("article_id"), "path", F.lit("misplaced").alias("state"))
    known = articles.select("article_id").distinct()
    mine = known.join(canonical, "article_id", "left").select("article_id", "path", F.when(F.col("path").isNotNull(), "matched").otherwise("missing").alias("state"))
    extra = canonical.join(known, "article_id", "left_anti").select("article_id", "path", F.lit("extra").alias("state"))
    return mine.unionByName(extra).unionByName(other)


@dataclass(frozen=True)
class EmbeddingManifest:
    provider_name: str
    embedding_kind: str
    metric: str
    vector_dimension: int
    article_count: int
    embedding_count: int
    missing_embedding_count: int

    def __post_init__(self) -> None:
        if self.metric not in ("cosine", "dot", "l2") or self.embedding_kind not in ("image", "text", "multimodal", "item"):
            raise ValueError("unknown metric or kind")
        if self.embedding_count + self.missing_embedding_count != self.article_count or self.vector_dimension < 1:
            raise ValueError("embedded and missing articles must add up to all, the dimension must be positive")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = filesystem(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def hashed_embedding(texts: list[str], dim: int = 64) -> list[list[float]]:
    """A stand-in encoder: signed hashed counts of lower-case words, of unit length."""
    out = []
    for t in texts:
        v = [0.0] * dim
        for w in t.lower().split():
            h = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
            v[h % dim] += 1.0 if h & 0x80000000 else -1.0
        n = sum(x * x for x in v) ** 0.5
        out.append([x / n for x in v] if n else v)
    return out


def generate_embeddings(rows: DataFrame, provider: Callable[[list[str]], list[list[float]]] = hashed_embedding) -> DataFrame:
    """``article_id, vec`` from ``article_id, combined_text`` in Arrow batches; an empty text has no embedding."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[pdf["combined_text"].fillna("") != ""]
            yield pd.DataFrame({"article_id": pdf["article_id"], "vec": provider(pdf["combined_text"].tolist())})

    return rows.select("article_id", "combined_text").mapInPandas(run, "article_id string, vec array<double>")


def write_cache(vectors: DataFrame, articles: int, path: str, provider_name: str, kind: str = "text", metric: str = "cosine") -> EmbeddingManifest:
    """Parquet, or JSON lines for a path that ends in .jsonl, and the manifest beside it."""
    spark = vectors.sparkSession
    (vectors.write.json if path.endswith(".jsonl") else vectors.write.parquet)(path)
    stored = read_vectors(spark, path)
    n, dim = stored.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    manifest = EmbeddingManifest(provider_name, kind, metric, dim or 1, articles, n, articles - n)
    write_text(spark, f"{path}.manifest.json", json.dumps(asdict(manifest), indent=2, sort_keys=True))
    return manifest


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    schema = "article_id string, vec array<double>"
    if path.endswith(".jsonl"):
        return spark.read.schema(schema).json(path)
    if path.endswith(".csv"):
        df = spark.read.csv(path, header=True)
        return df.select("article_id", F.array(*[F.col(c).cast("double") for c in df.columns if c != "article_id"]).alias("vec"))
    if path.endswith(".npy"):
        import numpy as np

        m = np.load(path.removeprefix("file://"))
        mapping = spark.read.csv(path.removesuffix(".npy") + "_mapping.csv", header=True, schema="embedding_index bigint, article_id string")
        rows = spark.createDataFrame(pd.DataFrame({"embedding_index": range(len(m)), "vec": m.astype(float).tolist()}), "embedding_index bigint, vec array<double>")
        return mapping.join(rows, "embedding_index").select("article_id", "vec")
    return spark.read.schema(schema).parquet(path)


def read_cache(spark: SparkSession, path: str) -> tuple[DataFrame, EmbeddingManifest]:
    """The vectors, checked against the manifest: their number and dimension, and one row per article."""
    manifest = EmbeddingManifest(**json.loads(read_text(spark, f"{path}.manifest.json")))
    rows = read_vectors(spark, path)
    n, distinct, wrong = rows.agg(F.count(F.lit(1)), F.count_distinct("article_id"), F.count_if(F.size("vec") != manifest.vector_dimension)).first()
    if n != manifest.embedding_count or distinct != n or wrong:
        raise ValueError(f"{path} does not hold what its manifest says")
    return rows, manifest


__all__ = ["EmbeddingManifest", "content", "generate_embeddings", "hashed_embedding", "image_inventory", "prioritized", "priority", "read_cache", "read_vectors", "squeezed", "write_cache"]
