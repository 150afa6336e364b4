"""Registered plans: diagnostics of sources and blends, ablation, tuning reported on a later window, further submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wickerlane.functions.text import packed_customer, settled, unpacked_customer
from wickerlane.operators import diagnostics as dg
from wickerlane.operators import features as ft
from wickerlane.operators import submission, tuning
from wickerlane.operators import training as tr
from wickerlane.operators import metrics
from wickerlane.operators.temporal import Split, check_windows
from wickerlane.plans import ranking, reports
from wickerlane.plans.base import query
from wickerlane.plans.fixtures import CUT, DAYS, K, MORE, SPLIT, all_candidates, ctes, found, sql, targets, tx
from wickerlane.plans.ranking import labelled, r6
from wickerlane.plans.training import _linear_rows
from wickerlane.sources.tables import table
from wickerlane.workspace import materialize, release

D, S = DataFrame, SparkSession

# -- candidate diagnostics -------------------------------------------------------------------------------------
_DEEP = {n: q.replace("QUALIFY rank <= 12", "QUALIFY rank <= 100") for n, q in ctes().items() if n in ("repeats", "top7", "topall", "covis")}
_DEEP["targets"] = "SELECT DISTINCT customer_id FROM customers WHERE customer_id IS NOT NULL"
_DEEP["wanted"] = "SELECT f.* FROM found f SEMI JOIN targets USING (customer_id)"
_DEEP["fill"] = "SELECT article_id, row_number() OVER (ORDER BY p, rank) AS rank FROM (SELECT article_id, p, rank FROM (SELECT article_id, 0 AS p, rank FROM top7 UNION ALL SELECT article_id, 1, rank FROM topall) QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY p, rank) = 1) QUALIFY rank <= 100"
_PLACES = {
    "repeat_popularity_blend": {"repeat": 0, "fill": 1},
    "repeat_co_visitation_popularity_blend": {"repeat": 0, "covis": 1, "fill": 2},
    "repeat_popularity_co_visitation_blend": {"repeat": 0, "fill": 1, "covis": 2},
}
_PARTS = {"repeat": "SELECT customer_id, article_id, {p} AS p, rank FROM repeats", "fill": "SELECT customer_id, article_id, {p}, rank FROM targets, fill", "covis": "SELECT customer_id, article_id, {p}, rank FROM covis"}


def _merged_sql(name: str) -> str:
    every = " UNION ALL ".join(_PARTS[n].format(p=p) for n, p in _PLACES[name].items())
    return (
        f"SELECT '{name}' AS source, customer_id, article_id, row_number() OVER (PARTITION BY customer_id ORDER BY p, rank, article_id) AS pos FROM "
        f"(SELECT * FROM ({every}) QUALIFY row_number() OVER (PARTITION BY customer_id, article_id ORDER BY p, rank) = 1) QUALIFY pos <= 100"
    )


_DEEP["lists"] = " UNION ALL ".join(
    [
        "SELECT 'repeat' AS source, customer_id, article_id, rank AS pos FROM repeats",
        "SELECT 'recent_popularity', customer_id, article_id, rank FROM targets, top7",
        "SELECT 'all_time_popularity', customer_id, article_id, rank FROM targets, topall",
        "SELECT 'co_visitation', customer_id, article_id, rank FROM covis",
        *(_merged_sql(n) for n in _PLACES),
    ]
)
_DEEP["names"] = "SELECT DISTINCT source FROM lists"
_DEEP["sofar_"] = "SELECT source, customer_id, pos, row_number() OVER (PARTITION BY source, customer_id ORDER BY pos) AS sofar FROM lists SEMI JOIN wanted USING (customer_id, article_id)"
_DEEP["perc"] = """SELECT source, customer_id, coalesce(won, 0) / least(labels, 12) AS ap, coalesce(h12, 0) / labels AS r12, coalesce(h50, 0) / labels AS r50, coalesce(h100, 0) / labels AS r100
  FROM (SELECT customer_id, count(*) AS labels FROM wanted GROUP BY 1) CROSS JOIN names LEFT JOIN (SELECT source, customer_id, sum(sofar / pos) FILTER (pos <= 12) AS won, count(*) FILTER (pos <= 12) AS h12,
  count(*) FILTER (pos <= 50) AS h50, count(*) AS h100 FROM sofar_ GROUP BY 1, 2) USING (source, customer_id)"""
_DEEP["sizes_"] = "SELECT source, customer_id, coalesce(n, 0) AS n FROM targets CROSS JOIN names LEFT JOIN (SELECT source, customer_id, count(*) AS n FROM lists GROUP BY 1, 2) USING (source, customer_id)"
_DEEP["reach"] = "SELECT DISTINCT other_id AS article_id FROM near SEMI JOIN (SELECT article_id FROM history SEMI JOIN targets USING (customer_id)) USING (article_id)"
_DEEP["arts"] = "SELECT 'repeat' AS part, article_id FROM repeats UNION SELECT 'fill', article_id FROM fill UNION SELECT 'covis', article_id FROM reach UNION SELECT 'top7', article_id FROM top7 UNION SELECT 'topall', article_id FROM topall"
_WHERE = {"repeat": ("repeat",), "recent_popularity": ("top7",), "all_time_popularity": ("topall",), "co_visitation": ("covis",)} | {n: tuple(p) for n, p in _PLACES.items()}
_DEEP["cover"] = " UNION ALL ".join(f"SELECT '{n}' AS source, count(DISTINCT article_id) AS articles FROM arts WHERE part IN ({', '.join(repr(x) for x in p)})" for n, p in _WHERE.items())


def _diagnosed(spark: S, d: str) -> dg.SourceDiagnostics:
    return dg.SourceDiagnostics(tx(spark, d), CUT, table(spark, d, "customers"), found(spark, d), days=DAYS)


@query(
    sql(
        """SELECT source, evaluated_customers, map_at_12, recall_at_12, recall_at_50, recall_at_100, target_customers, rows_with_candidates, candidate_coverage, rows_with_all, articles, minimum, p50, p90, p95, p99, maximum, mean FROM
        (SELECT source, count(*) AS evaluated_customers, round(avg(ap) + 1e-9, 6) AS map_at_12, round(avg(r12) + 1e-9, 6) AS recall_at_12, round(avg(r50) + 1e-9, 6) AS recall_at_50, round(avg(r100) + 1e-9, 6) AS recall_at_100 FROM perc GROUP BY 1)
        JOIN (SELECT source, count(*) AS target_customers, count(*) FILTER (n > 0) AS rows_with_candidates, round(count(*) FILTER (n > 0) / count(*) + 1e-9, 6) AS candidate_coverage, count(*) FILTER (n >= 100) AS rows_with_all,
        min(n) AS minimum, quantile_disc(n, 0.5) AS p50, quantile_disc(n, 0.9) AS p90, quantile_disc(n, 0.95) AS p95, quantile_disc(n, 0.99) AS p99, max(n) AS maximum, round(avg(n) + 1e-9, 6) AS mean FROM sizes_ GROUP BY 1) USING (source)
        JOIN cover USING (source)""",
        **_DEEP,
    )
)
def L5_candidate_diagnostics(spark: S, d: str) -> D:
    """Four sources and three blends at depths 12, 50 and 100, for all customers."""
    return r6(_diagnosed(spark, d).report(), "map_at_12", "recall_at_12", "recall_at_50", "recall_at_100", "candidate_coverage", "mean")


@query(
    sql(
        """SELECT source, CASE WHEN coalesce(n, 0) = 0 THEN '0' WHEN n <= 2 THEN '1-2' WHEN n <= 10 THEN '3-10' ELSE '11+' END AS bucket, count(*) AS customers, round(avg(ap) + 1e-9, 6) AS map_at_12, round(avg(r12) + 1e-9, 6) AS recall_at_12
        FROM perc LEFT JOIN (SELECT customer_id, count(*) AS n FROM past GROUP BY 1) USING (customer_id) GROUP BY 1, 2""",
        **_DEEP,
    )
)
def L5_by_history(spark: S, d: str) -> D:
    return r6(_diagnosed(spark, d).by_history(), "map_at_12", "recall_at_12")


@query(sql("SELECT count(DISTINCT article_id) AS articles FROM reach", reach="SELECT DISTINCT other_id AS article_id FROM near SEMI JOIN (SELECT article_id FROM history SEMI JOIN targets USING (customer_id)) USING (article_id)"))
def I16_reachable_articles(spark: S, d: str) -> D:
    """Articles that co-visitation can reach from the targets' histories."""
    from wickerlane.operators import history, temporal
    from wickerlane.plans.recommend import near

    mine = history.recent_unique(temporal.before(tx(spark, d), CUT)).join(targets(spark, d), "customer_id", "left_semi").select("article_id").distinct()
    return near(spark, d).join(mine, "article_id", "left_semi").agg(F.count_distinct("other_id").alias("articles"))


# -- ablation --------------------------------------------------------------------------------------------------
BASE = ("repeat", "recent_popularity", "all_time_popularity", "co_visitation", "garment_group_popularity", "product_code_popularity", "age_segment_popularity")
ADDED = ("recent_popularity_1d", "recent_popularity_3d", "seasonal_popularity")


def _sets_sql() -> str:
    sets = {"baseline": BASE, **{f"-{s}": [x for x in BASE if x != s] for s in BASE}, **{f"+{s}": [*BASE, s] for s in ADDED}}
    return ", ".join(f"('{v}', '{s}')" for v, names in sets.items() for s in names)


_SWAP = {"vfeats": ("feats", {"candidates": "vcand"}), "vdet": ("det", {"feats": "vfeats"}), "vdetrank": ("detrank", {"det": "vdet"})}


def _renamed(text: str, names: dict[str, str]) -> str:
    for a, b in names.items():
        text = text.replace(f"FROM {a}", f"FROM {b}")
    return text


@query(
    sql(
        """SELECT variant, round(map + 1e-9, 6) AS map, round(map - max(map) FILTER (variant = 'baseline') OVER () + 1e-9, 6) AS delta FROM (SELECT string_split(customer_id, '|')[1] AS variant, avg(coalesce(won, 0) / least(labels, 12)) AS map FROM
        (SELECT customer_id, count(*) AS labels FROM vfound GROUP BY 1) LEFT JOIN (SELECT customer_id, sum(sofar / pos) AS won FROM (SELECT customer_id, pos, row_number() OVER (PARTITION BY customer_id ORDER BY pos) AS sofar
        FROM vdetrank SEMI JOIN vfound USING (customer_id, article_id) WHERE pos <= 12) GROUP BY 1) USING (customer_id) GROUP BY 1)""",
        sets_=f"SELECT * FROM (VALUES {_sets_sql()}) s(variant, source)",
        vcand="SELECT variant || '|' || customer_id AS customer_id, article_id, source, source_rank, source_score FROM candidates JOIN sets_ USING (source)",
        vfound="SELECT variant || '|' || customer_id AS customer_id, article_id FROM found, (SELECT DISTINCT variant FROM sets_)",
        **{new: _renamed(MORE[old], names) for new, (old, names) in _SWAP.items()},
    )
)
def L9_source_ablation(spark: S, d: str) -> D:
    """Seven sources: without each (-), and with each of three more (+)."""
    return r6(dg.ablation(all_candidates(spark, d), found(spark, d), BASE, ADDED, K), "map", "delta")


# -- tuning on one window, reported on the next ----------------------------------------------------------------
def _all_trials(split: Split, columns: str) -> str:
    inner = ranking._grid_sql().replace(" QUALIFY rank <= 10", "")
    return f"SELECT {columns} FROM ({sql('SELECT * FROM (' + inner + ')', split)})"


_DEFAULT = next(i for i, t in enumerate(tuning.trials()) if all(abs(v - ft.Weights().of(n)) < 1e-12 for n, v in t.items()))


@query(
    f"""WITH a AS MATERIALIZED ({_all_trials(SPLIT.previous(), 'trial, map, recall, rank')}), b AS MATERIALIZED ({_all_trials(SPLIT, 'trial, map, recall')})
    SELECT a.trial AS selected_trial, a.map AS train_map, a.recall AS train_recall, e.map AS evaluation_map, e.recall AS evaluation_recall, f.map AS default_map, f.recall AS default_recall,
    round(e.map - f.map + 1e-9, 6) AS gain_map, round(e.recall - f.recall + 1e-9, 6) AS gain_recall FROM a JOIN b e ON e.trial = a.trial JOIN b f ON f.trial = {_DEFAULT} WHERE a.rank = 1"""
)
def J8_tuned_on_a_later_window(spark: S, d: str) -> D:
    """The weights that do best on the window before, measured on the evaluation window beside the default ones."""
    tried = tuning.trials()
    chosen = tuning.best(tuning.evaluate_trials(materialize(labelled(spark, d, SPLIT.previous()), "features"), found(spark, d, SPLIT.previous()), tried, K), 1).first()
    pair = {"evaluation": tried[chosen["trial"]], "default": tried[_DEFAULT]}
    later = {r["trial"]: r for r in tuning.evaluate_trials(materialize(labelled(spark, d), "features"), found(spark, d), list(pair.values()), K).collect()}
    near = lambda x: round(x + 1e-9, 6)
    e, f = later[0], later[1]
    row = (chosen["trial"], near(chosen["map"]), near(chosen["recall"]), near(e["map"]), near(e["recall"]), near(f["map"]), near(f["recall"]))
    out = spark.createDataFrame([row], "selected_trial int, train_map double, train_recall double, evaluation_map double, evaluation_recall double, default_map double, default_recall double")
    return out.withColumns({f"gain_{m}": settled(F.col(f"evaluation_{m}") - F.col(f"default_{m}")) for m in ("map", "recall")})


# -- rolling validation with the learned ranker ----------------------------------------------------------------
@query()
def J7_rolling_learned(spark: S, d: str) -> D:
    """Each window's source order, deterministic and linear ranking, the linear one fitted on the window before it."""
    check_windows(ranking.ROLLING)
    out = None
    for split in ranking.ROLLING:
        train, target = _linear_rows(spark, d, split.previous()), _linear_rows(spark, d, split)
        want = found(spark, d, split)
        arms = {
            "source_order": ft.source_order(target, K),
            "deterministic": ft.rank_by(target, K, "deterministic_score desc", "source_count desc", "best_rank"),
            "linear": ft.rank_by(target.withColumn("score", tr.linear_score(tr.fit_linear(train))), K, "score desc"),
        }
        for name, ranked in arms.items():
            one = metrics.summary(metrics.per_customer(ranked.select("customer_id", "article_id", "pos"), want, K)).select(F.lit(split.cutoff).alias("cutoff"), F.lit(name).alias("ranker"), "customers", "map", "recall")
            out = one if out is None else out.unionByName(one)
    return out


# -- submissions of the other rankers --------------------------------------------------------------------------
def _packed(df: D) -> D:
    return df.withColumn("customer_id", packed_customer("customer_id"))


def _packed_features(spark: S, d: str, cutoff, who: D) -> D:
    from wickerlane.operators import candidates as c
    from wickerlane.plans.fixtures import attribute, segments

    parts = c.source_parts(_packed(tx(spark, d)), cutoff, _packed(who), _packed(segments(spark, d)), attribute(spark, d, "garment_group_name"), attribute(spark, d, "product_code"), K, DAYS)
    return ft.pair_features(parts.by_customer(), placed=True)


def _final_features(spark: S, d: str) -> D:
    """Of all customers, their ids packed until ``_submitted`` gives them back."""
    return _packed_features(spark, d, submission.final_cutoff(tx(spark, d)), reports._everyone(spark, d))


def _submitted(spark: S, d: str, ranked: D) -> D:
    t, who = tx(spark, d), reports._everyone(spark, d)
    out = submission.backfilled_text(ranked.select("customer_id", "article_id", "pos"), t, submission.final_cutoff(t), _packed(who), K)
    return out.withColumn("customer_id", unpacked_customer("customer_id"))


_FILLED = """SELECT customer_id, article_id, row_number() OVER (PARTITION BY customer_id ORDER BY p, rank, article_id) AS pos FROM (SELECT * FROM (
  SELECT customer_id, article_id, 0 AS p, pos AS rank FROM detrank WHERE pos <= 12 UNION ALL SELECT customer_id, article_id, 1, rank FROM targets, top7 UNION ALL SELECT customer_id, article_id, 2, rank FROM targets, topall)
  QUALIFY row_number() OVER (PARTITION BY customer_id, article_id ORDER BY p, rank) = 1) QUALIFY pos <= 12"""


@query(sql(reports._TEXT.format(m="filled"), reports.FINAL, targets=reports._ALL, filled=_FILLED))
def J23_deterministic_submission(spark: S, d: str) -> D:
    return _submitted(spark, d, ft.deterministic_rank(_final_features(spark, d), K))


@query()
def J23_linear_submission(spark: S, d: str) -> D:
    """Fitted on the evaluation window, applied to the day after the log."""
    known = ft.with_labels(_packed_features(spark, d, CUT, targets(spark, d)), _packed(found(spark, d)))
    train = materialize(known.select("label", *ft.linear_vector()), "linear-rows")
    release(known)
    rows = _final_features(spark, d).select("customer_id", "article_id", *ft.linear_vector())
    return _submitted(spark, d, ft.rank_by(rows.withColumn("score", tr.linear_score(tr.fit_linear(train))), K, "score desc"))


