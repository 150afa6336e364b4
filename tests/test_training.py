"""Negatives, the small two-tower model, tuning, adapters and registries: defined cases against brute force."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from wickerlane.operators import diagnostics, features, metrics, reports, temporal, training, tuning, two_tower, vectors

LOG = "customer_id string, article_id string, seq bigint, t_dat date, price double, sales_channel_id int"


def log(spark, rows):
    return spark.createDataFrame([(c, a, i, dt.date(2023, 1, 1), 1.0, 1) for i, (c, a) in enumerate(rows)], LOG)


@pytest.mark.parametrize("sampling", ["random", "popularity", "mixed"])
def test_negatives_are_complete(spark, sampling):
    """Also of customers who bought nearly everything, or all, of a small vocabulary."""
    words = [f"a{i:02d}" for i in range(12)]
    rows = [("most", w) for w in words[:-2]] + [("all", w) for w in words] + [("one", "a00")] + [("hot", "a01")] * 200
    t = log(spark, rows)
    got = training.negatives(training.positive_pairs(t), t, 3, sampling=sampling).collect()
    own = defaultdict(set)
    for c, a in rows:
        own[c].add(a)
    per = Counter((r["customer_id"], r["article_id"]) for r in got)
    assert all(r["negative_id"] not in own[r["customer_id"]] for r in got)
    assert len({(r["customer_id"], r["article_id"], r["negative_id"]) for r in got}) == len(got)
    assert {k: n for k, n in per.items()} == {(c, a): min(3, 12 - len(own[c])) for c in own for a in own[c] if len(own[c]) < 12}
    assert training.negatives(training.positive_pairs(log(spark, [])), log(spark, []), 3, sampling=sampling).count() == 0


def test_training_config_refuses():
    for bad in ({"dim": 0}, {"objective": "other"}, {"log_q": 2.0}, {"half_life_days": 0}, {"rate": 0}):
        with pytest.raises(ValueError):
            two_tower.TrainingConfig(**bad)


@pytest.mark.parametrize("objective", ["logistic", "bpr"])
def test_two_tower_learns_two_tastes(spark, objective):
    rnd = random.Random(1)
    rows = []
    for u in range(40):
        for _ in range(12):
            a = rnd.randrange(20)
            rows.append((f"u{u}", f"i{a}", int(a % 2 == u % 2), dt.date(2023, 1, rnd.randrange(1, 28)) if u else None))
    df = spark.createDataFrame(rows, "customer_id string, article_id string, label int, day date")
    fitted = two_tower.train(df, two_tower.TrainingConfig(objective=objective, epochs=30, rate=0.2, half_life_days=20.0)).collect()
    side = lambda s: {r["id"]: np.array(r["vec"]) for r in fitted if r["side"] == s}
    users, items, loss = side("customer"), side("article"), side("loss")
    assert loss["29"][0] < loss["0"][0] and len(users) == 40 and len(items) == 20
    right = [users[u] @ items[a] > users[u] @ items[b] for u in users for a in items for b in items if int(a[1:]) % 2 == int(u[1:]) % 2 != int(b[1:]) % 2]
    assert sum(right) > 0.9 * len(right)


def test_retrieval_with_prior_and_pool(spark):
    users = spark.createDataFrame([("u", [1.0, 0.0])], "query string, vec array<double>")
    items = spark.createDataFrame([("a", [0.5, 0.0]), ("b", [0.4, 0.0]), ("c", [9.0, 0.0])], "item string, vec array<double>")
    prior = spark.createDataFrame([("a", 0.1), ("b", 1.0)], "article_id string, score double")
    got = [(r["article_id"], r["score"]) for r in two_tower.retrieve(users, items, 2, prior, 0.5, 2).orderBy("pos").collect()]
    assert got == [("b", 0.9), ("a", 0.55)]
    with pytest.raises(ValueError):
        two_tower.retrieve(users, items, 2, None, 0.5)


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_exchanged_and_broadcast_blocks_agree(spark, metric):
    rng = np.random.default_rng(3)
    rows = [(f"i{n:03d}", [float(x) for x in rng.integers(-2, 3, 4)]) for n in range(150)]  # small whole numbers: many ties
    items = spark.createDataFrame([r for r in rows if any(r[1])], "item string, vec array<double>")
    asked = items.limit(40).withColumnRenamed("item", "query")
    one = {tuple(r) for r in vectors.exact_search(asked, items, 7, metric).collect()}
    assert one == {tuple(r) for r in vectors.exact_search(asked, items, 7, metric, block=16, sent_whole=0).collect()} and len(one) == 280


def test_percentiles_of_a_continuous_column(spark):
    values = [random.Random(2).gauss(0, 1) for _ in range(501)]
    got = metrics.distribution(spark.createDataFrame([(v,) for v in values], "n double")).first()
    s = sorted(values)
    assert (got["minimum"], got["p50"], got["p90"], got["maximum"]) == (s[0], s[250], s[450], s[-1])


def test_tuning_equals_ranking_one_by_one(spark):
    rnd = random.Random(5)
    rows = [(f"c{c}", f"a{a:02d}", s, rnd.randrange(1, 5), rnd.random()) for c in range(30) for a in range(25) for s in rnd.sample(list(features.SOURCES)[:10], 2)]
    cand = spark.createDataFrame(rows, "customer_id string, article_id string, source string, source_rank int, source_score double")
    found = spark.createDataFrame(sorted({(f"c{rnd.randrange(35)}", f"a{rnd.randrange(25):02d}") for _ in range(60)}), "customer_id string, article_id string")
    rows = features.with_labels(features.pair_features(cand), found)
    tried = tuning.trials({"garment_group_popularity_presence": (0.2, 0.8), "source_count": (0.0, 0.1), "best_rank": (0.0, 0.05)})
    got = {r["trial"]: (r["map"], r["recall"]) for r in tuning.evaluate_trials(rows, found, tried, 5).collect()}
    for i in (0, 3, 7):
        one = metrics.summary(metrics.per_customer(features.deterministic_rank(rows, 5, features.Weights(tried[i])), found, 5)).first()
        assert got[i] == pytest.approx((one["map"], one["recall"]), abs=1e-8)


def test_adapters_and_discovery(spark):
    cand = spark.createDataFrame([("c", "a", "repeat", 1, 1.0), ("c", "b", "recent_popularity", 1, 1.0)], "customer_id string, article_id string, source string, source_rank int, source_score double")
    rows = features.pair_features(cand)
    weights = [0.0] * 48
    weights[list(features.LINEAR_NAMES).index("has_recent_popularity")] = 1.0
    order = lambda r: [x["article_id"] for x in r.rank(rows, 2).orderBy("pos").collect()]
    assert order(reports.DeterministicRanker()) == ["a", "b"] and order(reports.LinearRanker(tuple(weights))) == ["b", "a"]
    runs, warnings = reports.discover([
        {"config": {"k": 12}, "windows": [{"cutoff": "1", "x": 0.1, "y": 0.3}, {"cutoff": "1", "x": 0.2, "y": 0.1}]},
        {"windows": []},
        {"windows": [{"cutoff": "1", "x": 0.5}, {"cutoff": "2", "y": 0.1, "x": None}]},
    ])
    assert [(r.name, round(r.offline, 6)) for r in runs] == [("y", 0.2)] and len(warnings) == 4
    assert "**y**" in reports.champion_page(runs, warnings)


def test_guards(spark):
    split = temporal.Split(dt.date(2023, 1, 1))
    late = temporal.leakage(log(spark, [("c", "a")]), spark.createDataFrame([("c", "a")], "customer_id string, article_id string"), split).first()
    assert (late["late_rows"], late["labels"]) == (1, 1)
    assert temporal.comparable([{"k": 1, "cutoff": 1}, {"k": 1, "cutoff": 2}]) == [] and temporal.comparable([{"k": 1}, {"k": 2}]) == ["k"]
    with pytest.raises(ValueError):
        temporal.assert_before({"cutoff": "2023-01-02"}, dt.date(2023, 1, 1))


def test_diagnostics_with_short_lists(spark):
    """Where the backfill is short, blends have as many candidates as there are distinct ones; nothing gives zeros."""
    day = lambda d: dt.date(2023, 1, d)
    t = spark.createDataFrame([("a", "x", 1, day(1)), ("a", "y", 2, day(2)), ("b", "x", 3, day(3)), ("b", "z", 4, day(9))], "customer_id string, article_id string, seq bigint, t_dat date")
    who = spark.createDataFrame([("a",), ("b",), ("new",)], "customer_id string")
    found = spark.createDataFrame([("a", "z"), ("b", "y"), ("other", "x")], "customer_id string, article_id string")
    got = {r["source"]: r for r in diagnostics.SourceDiagnostics(t, day(10), who, found, (2, 12)).report().collect()}
    assert set(got) == {"repeat", "recent_popularity", "all_time_popularity", "co_visitation", *diagnostics.BLENDS}
    assert (got["repeat"]["minimum"], got["repeat"]["maximum"], got["repeat"]["rows_with_candidates"], got["repeat"]["recall_at_12"]) == (0, 2, 2, 0.0)
    assert got["repeat_popularity_blend"]["minimum"] == 3 and got["repeat_popularity_blend"]["recall_at_12"] == 1.0
    assert all(r["target_customers"] == 3 and r["evaluated_customers"] == 2 for r in got.values())
    empty = diagnostics.SourceDiagnostics(t.limit(0), day(10), who.limit(0), found.limit(0), (2, 12)).report().collect()
    assert all(r["map_at_12"] == 0 and r["target_customers"] == 0 for r in empty)


def test_ablation_by_hand(spark):
    cand = spark.createDataFrame([("c", "a", "repeat", 1, 1.0), ("c", "b", "recent_popularity", 1, 1.0)], "customer_id string, article_id string, source string, source_rank int, source_score double")
    found = spark.createDataFrame([("c", "b")], "customer_id string, article_id string")
    got = {r["variant"]: (r["map"], r["delta"]) for r in diagnostics.ablation(cand, found, ("repeat",), ("recent_popularity",), 12).collect()}
    assert got == {"baseline": (0.0, 0.0), "-repeat": (0.0, 0.0), "+recent_popularity": (0.5, 0.5)}
