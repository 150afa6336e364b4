"""Registered plans: pair features, rankers, fusion, behavioral features, tuning and rolling validation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wickerlane.functions.text import settled
from wickerlane.operators import behavioral as bh
from wickerlane.operators import features as ft
from wickerlane.operators import fusion, metrics, tuning
from wickerlane.operators import training as tr
from wickerlane.operators import vectors as vc
from wickerlane.operators.temporal import Split, before, check_windows
from wickerlane.plans import recommend  # noqa: F401  (its CTEs are used here)
from wickerlane.plans.base import query
from wickerlane.plans.fixtures import CUT, K, MORE, SPLIT, all_candidates, found, sql, tx
from wickerlane.sources.tables import table
from wickerlane.workspace import materialize

D, S = DataFrame, SparkSession


def feats(spark: S, d: str, split: Split = SPLIT) -> D:
    return ft.pair_features(all_candidates(spark, d, split))


def labelled(spark: S, d: str, split: Split = SPLIT) -> D:
    return ft.with_labels(feats(spark, d, split), found(spark, d, split))


def r6(df: D, *columns: str) -> D:
    return df.withColumns({c: settled(c) for c in columns})


# -- SQL of the shared steps -----------------------------------------------------------------------------------
def _in(sources) -> str:
    return "(" + ", ".join(f"'{s}'" for s in sources) + ")"


_SOURCE_COLUMNS = ", ".join(
    f"min(source_rank) FILTER (source IN {_in(v[0])}) AS {n}_rank, greatest(0.0, coalesce(max(source_score) FILTER (source IN {_in(v[0])}), 0)) AS {n}_score" for n, v in ft.SOURCES.items()
)
MORE["feats"] = f"SELECT customer_id, article_id, count(*) AS source_count, min(source_rank) AS best_rank, greatest(0.0, max(source_score)) AS max_source_score, {_SOURCE_COLUMNS} FROM candidates GROUP BY 1, 2"


def _value(n: str) -> str:
    return f"ln(1 + {n}_score)" if n in ft.LOGGED else f"{n}_score"


def score_sql(base: str = "0.05::DOUBLE * source_count + 0.05::DOUBLE / best_rank", skip: tuple[str, ...] = ()) -> str:
    parts = [base]
    for n, (_, p, s, _r) in ft.SOURCES.items():
        p, s = (0.0 if f"{n}_presence" in skip else p), (0.0 if f"{n}_score" in skip else s)
        parts.append(f"CASE WHEN {n}_rank IS NOT NULL THEN {p}::DOUBLE + {s}::DOUBLE * {_value(n)} ELSE 0 END")
    return "round(" + " + ".join(parts) + ", 9)"


MORE["det"] = f"SELECT *, {score_sql()} AS score FROM feats"
MORE["detrank"] = "SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, source_count DESC, best_rank, article_id) AS pos FROM det"
MORE["labelled"] = "SELECT d.*, CAST(f.article_id IS NOT NULL AS INTEGER) AS label FROM detrank d LEFT JOIN found f USING (customer_id, article_id)"


def evaluated(ranked: str) -> str:
    """MAP and recall at 12 of a ranking (customer_id, article_id, pos), as SQL."""
    return f"""SELECT count(*) AS customers, round(avg(coalesce(won, 0) / least(labels, 12)) + 1e-9, 6) AS map, round(avg(coalesce(hits, 0) / labels) + 1e-9, 6) AS recall FROM
    (SELECT customer_id, count(*) AS labels FROM found GROUP BY 1) LEFT JOIN (SELECT customer_id, count(*) AS hits, sum(sofar / pos) AS won FROM (SELECT customer_id, pos, row_number() OVER
    (PARTITION BY customer_id ORDER BY pos) AS sofar FROM {ranked} SEMI JOIN found USING (customer_id, article_id) WHERE pos <= 12) GROUP BY 1) USING (customer_id)"""


# -- pair features and deterministic ranking -------------------------------------------------------------------
_ROUNDED = ", ".join(f"{n}_rank, round({n}_score + 1e-9, 6) AS {n}_score" for n in ft.SOURCES)


@query(sql(f"SELECT customer_id, article_id, source_count, best_rank, round(max_source_score + 1e-9, 6) AS max_source_score, {_ROUNDED} FROM feats"))
def D8_pair_features(spark: S, d: str) -> D:
    return r6(feats(spark, d), "max_source_score", *[f"{n}_score" for n in ft.SOURCES])


@query(sql("SELECT customer_id, article_id, round(score + 1e-9, 6) AS score FROM det"))
def J1_deterministic_score(spark: S, d: str) -> D:
    return feats(spark, d).select("customer_id", "article_id", settled(ft.deterministic_score()).alias("score"))


@query(sql("SELECT customer_id, article_id, pos FROM detrank WHERE pos <= 12"))
def E10_deterministic_rank(spark: S, d: str) -> D:
    return ft.deterministic_rank(feats(spark, d), K).select("customer_id", "article_id", "pos")


@query(sql(f"SELECT 'deterministic' AS ranker, * FROM ({evaluated('detrank')}) UNION ALL SELECT 'source_order', * FROM ({evaluated('merged')})"))
def J2_deterministic_evaluation(spark: S, d: str) -> D:
    rows, want = materialize(feats(spark, d), "features"), found(spark, d)
    one = lambda name, ranked: metrics.summary(metrics.per_customer(ranked, want, K)).select(F.lit(name).alias("ranker"), "customers", settled("map").alias("map"), settled("recall").alias("recall"))
    return one("deterministic", ft.deterministic_rank(rows, K)).unionByName(one("source_order", ft.source_order(rows, K)))


@query(sql("SELECT * FROM merged"))
def G2_source_order(spark: S, d: str) -> D:
    return ft.source_order(feats(spark, d), K)


def _vector_sql() -> str:
    values = ["1.0::DOUBLE"]
    for n in ft.SOURCES:
        values += [f"CAST({n}_rank IS NOT NULL AS DOUBLE)", f"round({_value(n)} + 1e-9, 6)", f"round(coalesce(1.0::DOUBLE / {n}_rank, 0) + 1e-9, 6)"]
    values += ["round(source_count / 15.0::DOUBLE + 1e-9, 6)", "round(1.0::DOUBLE / best_rank + 1e-9, 6)"]
    return ", ".join(f"{v} AS {name}" for v, name in zip(values, ft.LINEAR_NAMES, strict=True))


_VECTOR = _vector_sql()


@query(sql(f"SELECT customer_id, article_id, {_VECTOR} FROM feats"))
def J3_linear_vector(spark: S, d: str) -> D:
    out = feats(spark, d).select("customer_id", "article_id", *ft.linear_vector())
    return r6(out, *[c for c in ft.LINEAR_NAMES if c != "bias" and not c.startswith("has_")])


@query(
    sql("""SELECT customer_id, article_id, label, round(score + 1e-9, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY customer_id, label ORDER BY score DESC, article_id) AS place,
    2 * greatest(1, sum(label) OVER (PARTITION BY customer_id)) AS allowed FROM labelled) WHERE label = 1 OR place <= allowed""")
)
def J11_training_sample(spark: S, d: str) -> D:
    """With two negatives per positive, so that the cut shows on small data."""
    return r6(ft.training_sample(labelled(spark, d), 2), "score").select("customer_id", "article_id", "label", "score")


_Z = "({c} - avg({c}) OVER w) / CASE WHEN stddev_pop({c}) OVER w > 1e-9 THEN stddev_pop({c}) OVER w ELSE 1 END"
_ZS, _ZM = _Z.format(c="score"), _Z.format(c="max_source_score")


@query(sql(f"SELECT customer_id, article_id, round({_ZS} + 1e-9, 6) AS z FROM det WINDOW w AS (PARTITION BY customer_id)"))
def E15_customer_z_score(spark: S, d: str) -> D:
    return feats(spark, d).withColumn("score", ft.deterministic_score()).select("customer_id", "article_id", settled(ft.z_score("score")).alias("z"))


MORE["zblend"] = f"SELECT customer_id, article_id, round(({_ZS}) + 0.75::DOUBLE * ({_ZM}), 9) AS blend FROM det WINDOW w AS (PARTITION BY customer_id)"


@query(sql("SELECT customer_id, article_id, row_number() OVER (PARTITION BY customer_id ORDER BY blend DESC, article_id) AS pos FROM zblend QUALIFY pos <= 12"))
def J13_z_blend(spark: S, d: str) -> D:
    out = ft.z_blend(feats(spark, d).withColumn("score", ft.deterministic_score()), "score", "max_source_score", 0.75)
    return ft.rank_by(out, K, "blend desc").select("customer_id", "article_id", "pos")


@query(sql("SELECT round(avg(score) + 1e-9, 6) AS mean, round(stddev_pop(score) + 1e-9, 6) AS std FROM det"))
def D26_global_z_stats(spark: S, d: str) -> D:
    return r6(feats(spark, d).withColumn("score", ft.deterministic_score()).agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std")), "mean", "std")


@query(
    sql(
        "SELECT customer_id, article_id, row_number() OVER (PARTITION BY customer_id ORDER BY blend DESC, article_id) AS pos FROM blended QUALIFY pos <= 12",
        blended="SELECT customer_id, article_id, round(0.75::DOUBLE * (score - a) / b + 0.25::DOUBLE * (max_source_score - c) / e, 9) AS blend FROM det, (SELECT avg(score) AS a, stddev_pop(score) AS b, avg(max_source_score) AS c, stddev_pop(max_source_score) AS e FROM det)",
    )
)
def J21_global_z_blend(spark: S, d: str) -> D:
    out = ft.global_z_blend(feats(spark, d).withColumn("score", ft.deterministic_score()), "score", "max_source_score", 0.25)
    return ft.rank_by(out, K, "blend desc").select("customer_id", "article_id", "pos")


@query(sql("SELECT customer_id, article_id, row_number() OVER (PARTITION BY customer_id ORDER BY max_source_score DESC, article_id) AS pos FROM feats QUALIFY pos <= 12"))
def E11_score_rank(spark: S, d: str) -> D:
    return ft.rank_by(feats(spark, d), K, "max_source_score desc").select("customer_id", "article_id", "pos")


# -- fusion ----------------------------------------------------------------------------------------------------
def slates(spark: S, d: str) -> D:
    """Three rankers' lists: deterministic, co-visitation, repeat."""
    rows = materialize(feats(spark, d), "features")
    det = ft.deterministic_rank(rows, K).select(F.lit("det").alias("ranker"), "customer_id", "article_id", "pos", "score")
    one = lambda name, s: rows.where(F.col(f"{s}_rank").isNotNull()).select(F.lit(name).alias("ranker"), "customer_id", "article_id", F.col(f"{s}_rank").alias("pos"), F.col(f"{s}_score").alias("score"))
    return det.unionByName(one("covis", "co_visitation")).unionByName(one("repeat", "repeat"))


MORE["slates"] = """SELECT 'det' AS ranker, customer_id, article_id, pos, score FROM detrank WHERE pos <= 12
  UNION ALL SELECT 'covis', customer_id, article_id, co_visitation_rank, co_visitation_score FROM feats WHERE co_visitation_rank IS NOT NULL
  UNION ALL SELECT 'repeat', customer_id, article_id, repeat_rank, repeat_score FROM feats WHERE repeat_rank IS NOT NULL"""
_W = "CASE ranker WHEN 'det' THEN 2.0::DOUBLE WHEN 'covis' THEN 1.0 ELSE 0.5 END"
WEIGHTS = {"det": 2.0, "covis": 1.0, "repeat": 0.5}


@query(sql("SELECT customer_id, article_id, row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, article_id) AS pos FROM (SELECT customer_id, article_id, round(sum(1.0::DOUBLE / (60 + pos)), 12) AS score FROM slates GROUP BY 1, 2)"))
def J14_reciprocal_rank_fusion(spark: S, d: str) -> D:
    return fusion.reciprocal_rank_fusion(slates(spark, d)).select("customer_id", "article_id", "pos")


@query(
    sql(f"""SELECT customer_id, article_id, row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, consensus DESC, best, article_id) AS pos FROM
    (SELECT customer_id, article_id, round(sum({_W} / (60 + pos)), 12) AS score, round(sum({_W}), 9) AS consensus, min(pos) AS best FROM slates GROUP BY 1, 2) QUALIFY pos <= 12""")
)
def J16_consensus_fusion(spark: S, d: str) -> D:
    return fusion.consensus_fusion(slates(spark, d), WEIGHTS, most=K).select("customer_id", "article_id", "pos")


@query(
    sql(
        "SELECT customer_id, article_id, round(sum(w * coalesce(z, f)) + 1e-9, 6) AS score FROM floors JOIN everything USING (customer_id) LEFT JOIN zs USING (ranker, customer_id, article_id) GROUP BY 1, 2",
        zs="SELECT ranker, customer_id, article_id, (score - avg(score) OVER w) / CASE WHEN stddev_pop(score) OVER w > 0 THEN stddev_pop(score) OVER w ELSE 1e-9 END AS z FROM slates WINDOW w AS (PARTITION BY ranker, customer_id)",
        floors=f"SELECT ranker, customer_id, min(z) - 1 AS f, any_value({_W}) AS w FROM zs GROUP BY 1, 2",
        everything="SELECT DISTINCT customer_id, article_id FROM zs",
    )
)
def J15_z_score_fusion(spark: S, d: str) -> D:
    return r6(fusion.z_score_fusion(slates(spark, d), WEIGHTS).select("customer_id", "article_id", "score"), "score")


_NEAR = "coalesce(list_max(list_transform(list_filter(l, lambda y: list_contains(taken, y.pos)), lambda y: CASE WHEN x.a IS NULL OR y.a IS NULL THEN 0.0::DOUBLE ELSE list_sum(list_transform([1, 2, 3, 4], lambda i: CASE WHEN x.a[i] IS NOT DISTINCT FROM y.a[i] THEN 1 ELSE 0 END)) / 4.0::DOUBLE END)), 0.0::DOUBLE)"


@query(
    sql(
        f"""SELECT customer_id, l[p].article_id AS article_id, i AS pos FROM (SELECT customer_id, l, unnest(taken) AS p, generate_subscripts(taken, 1) AS i FROM (WITH RECURSIVE step AS (
        SELECT customer_id, l, [1]::BIGINT[] AS taken FROM mmr_lists UNION ALL
        SELECT customer_id, l, list_append(taken, best.p) FROM (SELECT customer_id, l, taken, list_sort(list_transform(list_filter(l, lambda x: NOT list_contains(taken, x.pos)),
          lambda x: {{'v': -(0.7::DOUBLE * x.score - (1 - 0.7::DOUBLE) * {_NEAR}), 'p': x.pos}}))[1] AS best FROM step WHERE len(taken) < least(12, len(l)))) SELECT * FROM step WHERE len(taken) = least(12, len(l))))""",
        mmr_lists="""SELECT customer_id, list({'pos': pos, 'article_id': article_id, 'score': score, 'a': CASE WHEN art.article_id IS NOT NULL THEN [product_type_name, colour_group_name, garment_group_name, section_name] END} ORDER BY pos) AS l
          FROM (SELECT customer_id, article_id, pos, score FROM detrank WHERE pos <= 50) LEFT JOIN articles art USING (article_id) GROUP BY 1""",
    )
)
def J17_diversity_rerank(spark: S, d: str) -> D:
    articles = table(spark, d, "articles").select("article_id", "product_type_name", "colour_group_name", "garment_group_name", "section_name")
    return fusion.diversify(ft.deterministic_rank(feats(spark, d), 50), articles, K)


# -- behavioral features ---------------------------------------------------------------------------------------
def _behavioral_sql() -> dict[str, str]:
    def counts(days) -> str:
        return "count(*) AS n, " + ", ".join(f"count(*) FILTER (t_dat >= DATE '{CUT}' - {n}) AS n{n}" for n in days)

    money = "sum(price) AS s, count(price) AS v, count(*) FILTER (sales_channel_id = 2) AS c2, max(t_dat) AS last"
    tags = " UNION ALL ".join(f"SELECT article_id, '{x}' AS attr, {c} AS value FROM articles WHERE coalesce({c}, '') <> ''" for x, c in bh.ATTRIBUTES.items())
    pick = ", ".join(f"max(coalesce(own.n, 0)) FILTER (attr = '{x}') AS own_{x}" for x in bh.ATTRIBUTES)
    pick += ", " + ", ".join(
        f"max(coalesce(own.n30, 0)) FILTER (attr = '{x}') AS own30_{x}, max(coalesce(DATE '{CUT}' - own.last, 999)) FILTER (attr = '{x}') AS ownlast_{x}, "
        f"max(coalesce(trend.n7, 0)) FILTER (attr = '{x}') AS t7_{x}, max(coalesce(trend.n30, 0)) FILTER (attr = '{x}') AS t30_{x}" for x in bh.WINDOWED
    )
    n = lambda x: f"coalesce({x}, 0)"
    log = lambda x: f"ln(1 + {n(x)})"
    share = lambda a, b: f"coalesce({n(a)}::DOUBLE / nullif({n(b)}, 0), 0)"
    days = lambda x: f"coalesce(DATE '{CUT}' - {x}, 999)::DOUBLE"
    delta = lambda a, b, i, k: f"({n(a)} - {n(b)} * {i} / {k}.0::DOUBLE)"
    cp, ap, c2, a2 = share("c.s", "c.v"), share("a.s", "a.v"), share("c.c2", "c.n"), share("a.c2", "a.n")
    cols = [log("c.n"), log("c.articles"), *[log(f"c.n{x}") for x in (1, 3, 7, 30)], share("c.n1", "c.n7"), share("c.n3", "c.n7"), share("c.n7", "c.n30"), share("c.n30", "c.n"), days("c.last"), f"ln(1 + {days('c.first')})"]
    cols += [log("a.n"), *[log(f"a.n{x}") for x in (1, 3, 7, 14, 30)], share("a.n1", "a.n7"), share("a.n3", "a.n14"), share("a.n7", "a.n30"), share("a.n7", "a.n")]
    cols += [delta("a.n1", "a.n7", 1, 7), delta("a.n3", "a.n14", 3, 14), delta("a.n7", "a.n30", 7, 30), days("a.last"), log("p.n"), days("p.last")]
    cols += [cp, ap, f"({ap} - {cp})", f"coalesce({ap} / nullif({cp}, 0), 0)", c2, a2, f"abs({a2} - {c2})"]
    w = bh.WINDOWED
    cols += [log(f"own_{x}") for x in bh.ATTRIBUTES] + [log(f"own30_{x}") for x in w] + [share(f"own30_{x}", f"own_{x}") for x in w] + [f"coalesce(ownlast_{x}, 999)" for x in w]
    cols += [log(f"t7_{x}") for x in w] + [log(f"t30_{x}") for x in w] + [share(f"t7_{x}", f"t30_{x}") for x in w]
    return {
        "bpairs": "SELECT DISTINCT customer_id, article_id FROM candidates",
        "bmine": "SELECT * FROM past SEMI JOIN bpairs USING (customer_id)",
        "bcust": f"SELECT customer_id, {counts((1, 3, 7, 30))}, {money}, min(t_dat) AS first, count(DISTINCT article_id) AS articles FROM bmine GROUP BY 1",
        "bart": f"SELECT article_id, {counts((1, 3, 7, 14, 30))}, {money} FROM past SEMI JOIN bpairs USING (article_id) GROUP BY 1",
        "bpair": "SELECT customer_id, article_id, count(*) AS n, max(t_dat) AS last FROM bmine GROUP BY 1, 2",
        "btags": tags,
        "own": f"SELECT customer_id, attr, value, {counts((30,))}, max(t_dat) AS last FROM bmine JOIN btags USING (article_id) GROUP BY 1, 2, 3",
        "trend": f"SELECT attr, value, {counts((7, 30))} FROM past JOIN btags USING (article_id) WHERE attr IN {_in(w)} GROUP BY 1, 2",
        "bvalue": f"SELECT customer_id, article_id, {pick} FROM bpairs JOIN btags USING (article_id) LEFT JOIN own USING (customer_id, attr, value) LEFT JOIN trend USING (attr, value) GROUP BY 1, 2",
        "behavior": "SELECT customer_id, article_id, "
        + ", ".join(f"round({x} + 1e-9, 6) AS {name}" for x, name in zip(cols, bh.names(), strict=True))
        + " FROM bpairs LEFT JOIN bcust c USING (customer_id) LEFT JOIN bart a USING (article_id) LEFT JOIN bpair p USING (customer_id, article_id) LEFT JOIN bvalue USING (customer_id, article_id)",
    }


MORE.update(_behavioral_sql())


@query(sql("SELECT * FROM behavior"))
def J9_behavioral_features(spark: S, d: str) -> D:
    pairs = materialize(all_candidates(spark, d).select("customer_id", "article_id").distinct(), "pairs")
    return r6(bh.features(tx(spark, d), CUT, pairs, table(spark, d, "articles")), *bh.names())


def _stores(spark: S, d: str) -> dict[str, D]:
    return bh.stores(tx(spark, d), CUT, materialize(all_candidates(spark, d).select("customer_id", "article_id").distinct(), "pairs"), table(spark, d, "articles"))


@query(sql("SELECT customer_id, n, n1, n3, n7, n30, articles, first, last, c2, round(s + 1e-9, 6) AS s FROM bcust"))
def D9_customer_store(spark: S, d: str) -> D:
    return _stores(spark, d)["customer"].select("customer_id", "n", "n1", "n3", "n7", "n30", "articles", "first", "last", "c2", settled("s").alias("s"))


@query(sql("SELECT article_id, n, n1, n3, n7, n14, n30, last, c2, round(s / v + 1e-9, 6) AS mean_price, round(c2 / n + 1e-9, 6) AS channel2 FROM bart"))
def D10_article_shares(spark: S, d: str) -> D:
    from wickerlane.functions.text import ratio

    out = _stores(spark, d)["article"]
    return out.select("article_id", "n", "n1", "n3", "n7", "n14", "n30", "last", "c2", settled(F.when(F.col("v") > 0, ratio("s", "v"))).alias("mean_price"), settled(ratio("c2", "n")).alias("channel2"))


@query(sql("SELECT * FROM own"))
def C8_attribute_store(spark: S, d: str) -> D:
    return _stores(spark, d)["own"]


SIDECARS = ("two_tower_score", "content_user_cosine")


def content_cosines(spark: S, d: str, pairs: D, split: Split = SPLIT) -> D:
    """``customer_id, article_id, content_user_cosine``: the mean of the history's text vectors against the article's."""
    from wickerlane.plans.vectors import text_vectors

    items = text_vectors(spark, d)
    _, queries = vc.history_vectors(tx(spark, d), split.cutoff, pairs.select("customer_id").distinct(), items)
    return vc.pair_scores(pairs, queries, items, name="content_user_cosine")


def ltr(spark: S, d: str, split: Split = SPLIT, factors: bool = True) -> D:
    """Label, the 48 linear inputs, the deterministic score, the 60 behavioral features and the two sidecars.

    The factors behind ``two_tower_score`` and the histories behind ``content_user_cosine`` lie before the cutoff.
    """
    rows, keys = materialize(labelled(spark, d, split), "features"), ["customer_id", "article_id"]
    linear = rows.select(*keys, "label", *ft.linear_vector(), ft.deterministic_score().alias("deterministic_score"))
    out = linear.join(bh.features(tx(spark, d), split.cutoff, rows, table(spark, d, "articles")), keys).join(content_cosines(spark, d, rows, split), keys)
    if factors:
        users, items = tr.factors(before(tx(spark, d), split.cutoff))
        out = out.join(vc.pair_dots(rows, users, items), keys)
    return out


@query()
def J10_learning_to_rank_matrix(spark: S, d: str) -> D:
    """All 111 columns; those that SQL can say are told by ``J10_without_factors``."""
    return ltr(spark, d)


_COSINES = f"SELECT customer_id, article_id, round(coalesce(list_cosine_similarity(q.vec, t.vec), 0) + 1e-9, 6) AS content_user_cosine FROM feats LEFT JOIN vmean q USING (customer_id) LEFT JOIN textvec t ON item = article_id"


def _matrix_sql() -> str:
    from wickerlane.plans import vectors  # noqa: F401  (its CTEs are used here)

    return sql(f"SELECT * FROM (SELECT customer_id, article_id, label, round(score + 1e-9, 6) AS deterministic_score, {_VECTOR} FROM labelled) JOIN behavior USING (customer_id, article_id) JOIN ({_COSINES}) USING (customer_id, article_id)")


def J10_without_factors(spark: S, d: str) -> D:
    """The matrix without the one column that is fitted."""
    out = ltr(spark, d, factors=False)
    return r6(out, *[c for c in out.columns if c not in ("customer_id", "article_id", "label")])


# -- tuning and rolling validation -----------------------------------------------------------------------------
def _grid_sql() -> str:
    g = tuning.GRID
    names = list(g)
    skip = tuple(n for n in names if n not in ("source_count", "best_rank"))
    base = score_sql(base="w.source_count::DOUBLE * f.source_count + w.best_rank::DOUBLE / f.best_rank", skip=skip)[len("round(") : -len(", 9)")]
    for s in ("garment_group_popularity", "age_segment_popularity"):
        base += f" + CASE WHEN {s}_rank IS NOT NULL THEN w.{s}_presence::DOUBLE + w.{s}_score::DOUBLE * f.{s}_score ELSE 0 END"
    # Names of weights and scores clash, hence the prefixes.
    base = base.replace("* source_count", "* f.source_count")
    for n in ft.SOURCES:
        base = base.replace(f"* {n}_score", f"* f.{n}_score")
    values = ", ".join("(" + ", ".join(str(x) for x in (i, *t.values())) + ")" for i, t in enumerate(tuning.trials()))
    return f"""WITH grid AS (SELECT * FROM (VALUES {values}) w(trial, {", ".join(names)})), sizes AS (SELECT customer_id, count(*) AS labels FROM found GROUP BY 1),
    ranked AS (SELECT w.trial, f.customer_id, f.article_id, f.label, row_number() OVER (PARTITION BY w.trial, f.customer_id ORDER BY round({base}, 9) DESC, f.source_count DESC, f.best_rank, f.article_id) AS pos FROM labelled f, grid w),
    hits AS (SELECT *, row_number() OVER (PARTITION BY trial, customer_id ORDER BY pos) AS sofar FROM ranked WHERE pos <= 12 AND label = 1),
    per AS (SELECT trial, customer_id, sum(sofar / pos) AS won, count(*) AS n FROM hits GROUP BY 1, 2),
    total AS (SELECT g.trial, coalesce(sum(won / least(labels, 12)), 0) / (SELECT count(*) FROM sizes) AS map, coalesce(sum(n / labels), 0) / (SELECT count(*) FROM sizes) AS recall FROM grid g LEFT JOIN (per JOIN sizes USING (customer_id)) USING (trial) GROUP BY 1)
    SELECT trial, round(map + 1e-9, 6) AS map, round(recall + 1e-9, 6) AS recall, row_number() OVER (ORDER BY round(map, 9) DESC, round(recall, 9) DESC, trial) AS rank FROM total QUALIFY rank <= 10"""


@query(sql("SELECT * FROM (" + _grid_sql() + ")"))
def J8_grid_tuning(spark: S, d: str) -> D:
    rows = materialize(labelled(spark, d), "features")
    return r6(tuning.best(tuning.evaluate_trials(rows, found(spark, d), tuning.trials(), K)), "map", "recall")


ROLLING = [Split(CUT - dt.timedelta(days=7 * i), 7) for i in (2, 1, 0)]


def _window_sql(split: Split) -> str:
    return f"SELECT DATE '{split.cutoff}' AS cutoff, (SELECT map FROM ({evaluated('merged')})) AS baseline, (SELECT map FROM ({evaluated('detrank')})) AS ranked"


@query(" UNION ALL ".join(f"SELECT * FROM ({sql(_window_sql(s), s)})" for s in ROLLING))
def J7_rolling_validation(spark: S, d: str) -> D:
    return rolling(spark, d)


def rolling(spark: S, d: str) -> D:
    check_windows(ROLLING)
    out = None
    for split in ROLLING:
        rows, want = materialize(feats(spark, d, split), "features"), found(spark, d, split)
        score = lambda ranked: metrics.summary(metrics.per_customer(ranked, want, K))  # noqa: B023, E731
        a, b = score(ft.source_order(rows, K)), score(ft.deterministic_rank(rows, K))
        one = a.select(F.lit(split.cutoff).alias("cutoff"), settled("map").alias("baseline")).join(F.broadcast(b.select(settled("map").alias("ranked"))), F.lit(True))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "SELECT count(*) AS windows, round(avg(ranked - baseline) + 1e-9, 6) AS mean_gain, round(min(ranked - baseline) + 1e-9, 6) AS least_gain, round(max(ranked - baseline) + 1e-9, 6) AS greatest_gain, count(*) FILTER (ranked > baseline) AS improved FROM ("
    + " UNION ALL ".join(f"SELECT * FROM ({sql(_window_sql(s), s)})" for s in ROLLING)
    + ")"
)
def D16_rolling_summary(spark: S, d: str) -> D:
    return r6(tuning.rolling_summary(rolling(spark, d)), "mean_gain", "least_gain", "greatest_gain")
