"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wickerlane.functions.text import label, settled
from wickerlane.llm.cooccur import PairTable
from wickerlane.llm.knn import NeighbourGraph
from wickerlane.llm.mixing import mix
from wickerlane.llm.mojibake import garbled
from wickerlane.llm.packing import pack
from wickerlane.llm.tokens import token_count
from wickerlane.llm.topn import top_n_per_group
from wickerlane.operators.vectors import newest
from wickerlane.sources.tables import table
from wickerlane.workspace import materialize, scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# -- 1: top N in every group -------------------------------------------------------------------------------
TOP_SQL = """
WITH best AS (
  SELECT group_field,
         coalesce(nullif(trim(regexp_replace(group_value, '[ \\t]+', ' ', 'g')), ''), 'unknown') AS group_value,
         article_id, max(score) AS score
  FROM attribute_candidates
  WHERE article_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)
  GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY group_field, group_value ORDER BY score DESC, article_id) AS rank FROM best)
SELECT {columns} FROM ranked WHERE rank <= 12
"""


def _top(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "attribute_candidates").withColumn("group_value", label("group_value"))
    return top_n_per_group(rows, ["group_field", "group_value"], "article_id", "score", n=12)


@query(TOP_SQL.format(columns="group_field, group_value, article_id"))
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d).select("group_field", "group_value", "article_id")


@query(TOP_SQL.format(columns="group_field, group_value, article_id, score, CAST(rank AS INTEGER) AS rank"))
def p1_ranked(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d)


# -- 2: items that appear together -------------------------------------------------------------------------
PAIR_SQL = """
WITH m AS (SELECT DISTINCT customer_id, t_dat, article_id FROM transactions_train
           WHERE customer_id IS NOT NULL AND t_dat IS NOT NULL AND article_id IS NOT NULL),
baskets AS (SELECT count(*) AS n FROM (SELECT DISTINCT customer_id, t_dat FROM m)),
one AS (SELECT article_id, count(*) AS n FROM m GROUP BY 1),
two AS (SELECT a.article_id AS article_id_a, b.article_id AS article_id_b, count(*) AS n_ab
        FROM m a JOIN m b ON a.customer_id = b.customer_id AND a.t_dat = b.t_dat AND a.article_id < b.article_id GROUP BY 1, 2)
SELECT {columns}
FROM two JOIN one x ON x.article_id = article_id_a JOIN one y ON y.article_id = article_id_b, baskets
WHERE {condition}
"""


def _pair_table(spark: SparkSession, d: str, scored_from: int, late_days: int = 30) -> PairTable:
    """The table after two loads: rows on time, then those that arrived in the last ``late_days``."""
    rows = table(spark, d, "transactions_train")
    pairs = PairTable(spark, scratch(spark, "pairs"), ["customer_id", "t_dat"], "article_id", scored_from=scored_from)
    last = rows.agg(F.max("loaded_at")).first()[0]
    if last is None:
        pairs.apply(rows)
        return pairs
    cut = F.lit(last) - F.expr(f"INTERVAL {late_days} DAYS")
    pairs.apply(rows.where(F.col("loaded_at").isNull() | (F.col("loaded_at") <= cut)), number=0)
    pairs.apply(rows.where(F.col("loaded_at") > cut), number=1)
    return pairs


@query(PAIR_SQL.format(columns="article_id_a, article_id_b", condition="n_ab >= 10 AND n_ab::HUGEINT * baskets.n >= 30 * x.n::HUGEINT * y.n"))
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = _pair_table(spark, d, scored_from=10)
    big = lambda c: F.col(c).cast("decimal(19,0)")
    case = big("n_ab") * F.lit(pairs.baskets).cast("decimal(19,0)") >= big("n_a") * big("n_b") * 30
    return pairs.scores().where(case).select(F.col("item_a").alias("article_id_a"), F.col("item_b").alias("article_id_b"))


@query(PAIR_SQL.format(columns="article_id_a, article_id_b, n_ab, x.n AS n_a, y.n AS n_b, round(n_ab * baskets.n::DOUBLE / (x.n::DOUBLE * y.n) + 1e-9, 6) AS lift", condition="true"))
def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pair_table(spark, d, scored_from=1).scores().select(
        F.col("item_a").alias("article_id_a"), F.col("item_b").alias("article_id_b"), "n_ab", "n_a", "n_b", settled("lift").alias("lift")
    )


# -- 10: wrongly decoded text ------------------------------------------------------------------------------
@query()
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled(table(spark, d, "documents")).select("doc_id")


@query()
def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return garbled(table(spark, d, "documents"))


# -- 7: most similar vectors -------------------------------------------------------------------------------
def _vectors(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "embedding_runs").select(F.col("embeddings_path").alias("grp"), F.col("vector_dimension").alias("dim"))
    return newest(table(spark, d, "article_vectors"), "embeddings_path", "article_id", "embedding_index", "vector", runs)


_COSINE = "round(list_cosine_similarity(a.vec, b.vec), 6)"
NEAR_SQL = f"""
WITH v AS (SELECT embeddings_path AS grp, article_id AS item, vector::DOUBLE[] AS vec FROM article_vectors
  JOIN (SELECT DISTINCT embeddings_path, vector_dimension FROM embedding_runs) USING (embeddings_path)
  WHERE article_id IS NOT NULL AND vector IS NOT NULL AND len(vector) = vector_dimension
  AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0
  QUALIFY row_number() OVER (PARTITION BY embeddings_path, article_id ORDER BY embedding_index DESC) = 1),
near AS (SELECT a.grp, a.item, b.item AS other, {_COSINE} AS similarity FROM v a JOIN v b ON a.grp = b.grp AND a.item <> b.item
  QUALIFY row_number() OVER (PARTITION BY a.grp, a.item ORDER BY {_COSINE} DESC, b.item) <= 10)
SELECT DISTINCT grp AS embeddings_path, least(item, other) AS article_id_a, greatest(item, other) AS article_id_b FROM near WHERE similarity >= 0.85
"""


@query(NEAR_SQL)
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    near = NeighbourGraph(_vectors(spark, d)).neighbours(k=10).where(F.col("similarity") >= 0.85)
    return near.select(F.col("grp").alias("embeddings_path"), F.least("item", "other").alias("article_id_a"), F.greatest("item", "other").alias("article_id_b")).distinct()


@query()
def p7_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return NeighbourGraph(_vectors(spark, d)).neighbours(k=10).select(
        F.col("grp").alias("embeddings_path"), F.col("item").alias("article_id"), F.col("other").alias("similar_article_id"), "similarity", "rank"
    )


@query()
def p7_search(spark: SparkSession, d: str) -> DataFrame:
    """Greedy search of the graph with every vector whose ``embedding_index`` is divisible by 50, against all."""
    vectors = _vectors(spark, d)
    graph = NeighbourGraph(vectors)
    asked = graph.vectors.where(F.col("id") % 50 == 0).select(F.col("id").alias("query"), "grp", "vec")
    return graph.search(asked, k=10)


# -- 8: filling containers ---------------------------------------------------------------------------------
def _sized(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "source", token_count("text").alias("tokens"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    kinds = table(spark, d, "container_sizes").select(F.col("container_kind").alias("kind"), F.col("capacity_tokens").alias("capacity"))
    return pack(_sized(spark, d), "doc_id", "tokens", kinds)


@query()
def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).select(F.col("kind").alias("container_kind"), "container", "doc_id", "piece", F.col("size").alias("tokens"))


@query()
def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Per kind the containers used, the least number any packing needs, and the share of room filled."""
    sizes = table(spark, d, "container_sizes").select(F.col("container_kind").alias("kind"), F.col("capacity_tokens").alias("capacity"))
    per = _packed(spark, d).groupBy("kind").agg(F.count_distinct("container").alias("containers"), F.sum("size").alias("tokens"))
    return per.join(F.broadcast(sizes), "kind").select(
        F.col("kind").alias("container_kind"), "containers", F.ceil(F.col("tokens") / F.col("capacity")).alias("least_containers"), (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("fill")
    )


@query(
    """SELECT container_kind, (SELECT count(*) FROM documents) AS documents, 0::BIGINT AS missing, 0::BIGINT AS overfull, 0::BIGINT AS cut_needlessly, 0::BIGINT AS wrong_size, 0::BIGINT AS still_fit_together,
    true AS within_a_hundredth FROM container_sizes"""
)
def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the containers: all documents whole, none too full, only large ones cut, no two that fit together, few in all."""
    sized = materialize(_sized(spark, d).select("doc_id", "tokens"), "sized")
    kinds = table(spark, d, "container_sizes").select(F.col("container_kind").alias("kind"), F.col("capacity_tokens").alias("capacity"))
    placed = materialize(pack(sized, "doc_id", "tokens", kinds), "packed")
    kinds = F.broadcast(kinds)  # a few rows
    per = placed.groupBy("kind", "doc_id").agg(F.sum("size").alias("got"), F.count(F.lit(1)).alias("pieces"))
    fits = sized.join(per, "doc_id").join(kinds, "kind")
    docs = fits.groupBy("kind").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if((F.col("tokens") <= F.col("capacity")) & (F.col("pieces") > 1)).alias("cut_needlessly"), F.count_if(F.col("got") != F.col("tokens")).alias("wrong_size")
    )
    bins = placed.groupBy("kind", "container").agg(F.sum("size").alias("fill")).join(kinds, "kind")
    two = F.slice(F.array_sort(F.collect_list(F.when(F.col("fill") * 2 <= F.col("capacity"), F.col("fill")))), 1, 2)  # after merging at most one container a kind
    full = bins.groupBy("kind", "capacity").agg(F.count_if(F.col("fill") > F.col("capacity")).alias("overfull"), F.greatest(F.size(two) - 1, F.lit(0)).cast("bigint").alias("still_fit_together"), F.count(F.lit(1)).alias("n"), F.sum("fill").alias("total"))
    least = F.ceil(F.col("total") / F.col("capacity"))
    count = sized.count()
    return docs.join(full, "kind").select(
        F.col("kind").alias("container_kind"), F.lit(count).alias("documents"), (F.lit(count) - F.col("documents")).alias("missing"), "overfull", "cut_needlessly", "wrong_size", "still_fit_together",
        (F.col("n") <= F.ceil(least * 1.01)).alias("within_a_hundredth"),
    )


# -- 9: mixing sources -------------------------------------------------------------------------------------
@query()
def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mix(_sized(spark, d), "doc_id", "source", "tokens", table(spark, d, "mix_targets"))[0]


@query()
def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix(_sized(spark, d), "doc_id", "source", "tokens", table(spark, d, "mix_targets"))[1]


@query(
    """SELECT lower(trim(source)) AS source, round(target_share, 9) AS target_share, max_repeats, 0::BIGINT AS used_too_often, 0::BIGINT AS of_another_source, true AS share_within_a_record, true AS places_fit FROM mix_targets"""
)
def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the mixture: caps kept, sources right, shares reached to within one record, blocks whole and in order."""
    sized = materialize(_sized(spark, d), "sized")
    mixed, told = mix(sized, "doc_id", "source", "tokens", table(spark, d, "mix_targets"))
    mixed, told = materialize(mixed, "mixed"), materialize(told, "mixed-report")
    facts = told.select("source", "target_share", "max_repeats", "reachable_share", "actual_share", "tokens")
    own = mixed.join(sized.select("doc_id", F.lower(F.trim("source")).alias("own")), "doc_id")
    uses = own.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("uses"), F.count_if(~F.col("own").eqNullSafe(F.col("source"))).alias("other"))
    uses = uses.join(F.broadcast(facts.select("source", "max_repeats")), "source")  # one row per listed source
    per = uses.groupBy("source").agg(F.count_if(F.col("uses") > F.col("max_repeats")).alias("often"), F.sum("other").alias("other"))
    block = F.expr("place div 2048")
    slots = mixed.groupBy("slot").agg(F.min("source").alias("source"), F.max("source").alias("last"), F.min(block).alias("low"), F.max(block).alias("high"), F.sum("size").alias("laid"))
    slots = slots.groupBy("source").agg(F.sum("laid").alias("laid"), F.count_if((F.col("source") != F.col("last")) | (F.col("low") != F.col("high"))).alias("mixed_up"))
    all_ = told.agg(F.sum("tokens").alias("all")).first()[0] or 0
    longest = sized.where(F.lower(F.trim("source")).isin([r[0] for r in facts.select("source").collect()])).groupBy(F.lower(F.trim("source")).alias("source")).agg(F.max("tokens").alias("largest"))
    one = facts.join(longest, "source", "left").join(per, "source", "left").join(slots, "source", "left")
    every = longest.agg(F.sum("largest")).first()[0] or 0  # the whole may be off by a record of each source
    zero, room = F.lit(0).cast("bigint"), F.coalesce("largest", F.lit(0)) + F.lit(every)
    return one.select(
        "source", F.round("target_share", 9).alias("target_share"), "max_repeats", F.coalesce("often", zero).alias("used_too_often"), F.coalesce("other", zero).alias("of_another_source"),
        (F.abs(F.col("actual_share") - F.col("reachable_share")) * F.lit(all_) <= room).alias("share_within_a_record"),
        ((F.coalesce("laid", zero) == F.col("tokens")) & (F.coalesce("mixed_up", zero) == 0)).alias("places_fit"),
    )
