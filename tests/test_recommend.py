"""Hand-computed cases of the recommendation operators."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wickerlane.functions import text
from wickerlane.operators import behavioral, candidates, features, fusion, history, metrics, popularity, submission, temporal, training, tuning, validate, vectors
from wickerlane.operators.reports import Run, champion, config_hash, merge_runs, report_text

D = lambda n: dt.date(2020, 1, n)


def log(spark, rows):
    return spark.createDataFrame([(i, D(day), c, str(a)) for i, (c, a, day) in enumerate(rows)], "seq bigint, t_dat date, customer_id string, article_id string")


def people(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "customer_id string")


def lists(df, key="customer_id", by="rank", value="article_id"):
    out: dict = {}
    for r in sorted(df.collect(), key=lambda r: r[by]):
        out.setdefault(r[key], []).append(r[value])
    return out


def test_popularity_order(spark):
    tx = log(spark, [("a", 2, 1), ("b", 2, 1), ("a", 1, 2), ("b", 1, 1), ("c", 3, 9)])
    assert [r["article_id"] for r in sorted(popularity.top(popularity.article_stats(tx), 5).collect(), key=lambda r: r["rank"])] == ["1", "2", "3"]
    with pytest.raises(ValueError):
        popularity.top(popularity.article_stats(tx), 0)


def test_merge_of_repeats_and_popularity(spark):
    tx = log(spark, [("a", 1, 1), ("b", 3, 2), ("b", 3, 3), ("a", 2, 6), ("a", 1, 7)])
    who = people(spark, "a", "c")
    got = candidates.merge_ranked(candidates.union([candidates.repeat_source(tx, D(8), who, 3), candidates.recent_source(tx, D(8), who, 3), candidates.all_time_source(tx, D(8), who, 3)]), ["repeat", "recent_popularity", "all_time_popularity"], 3)
    assert lists(got, by="pos") == {"a": ["1", "2", "3"], "c": ["1", "3", "2"]}


def test_a_union_of_parts_by_customer_is_exchanged_before_it_is_grouped(spark):
    parts = [candidates.as_source(people(spark, "a", "b").withColumns({"article_id": F.lit(str(i)), "rank": F.lit(1)}).repartition("customer_id"), "repeat") for i in range(3)]
    one = candidates.union(parts).groupBy("customer_id").agg(F.count("article_id").alias("n"))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan[: plan.index("Union")]
    assert {r["customer_id"]: r["n"] for r in one.collect()} == {"a": 3, "b": 3}


def test_co_visitation(spark):
    tx = log(spark, [("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("b", 2, 1), ("b", 3, 2), ("b", 9, 12)])
    assert lists(history.recent_unique(temporal.before(tx, D(10))), by="position")["a"] == ["3", "2", "1"]
    got = lists(history.co_visitation(tx, D(10), people(spark, "a")))
    assert got == {"a": ["2", "1", "3"]}  # article 9 lies after the cutoff


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_candidates_are_not_exchanged_after_they_are_made(spark):
    rows = candidates.as_source(people(spark, "a", "b").withColumns({"article_id": F.lit("1"), "rank": F.lit(1)}), "repeat")
    assert plan_of(features.deterministic_rank(features.pair_features(rows), 3)).count("Exchange") == 1
    met = spark.createDataFrame([("1", "2", 3, 1), ("1", "3", 3, 2), ("2", "3", 1, 1)], "article_id string, other_id string, n bigint, rank int")
    seen = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("b", "2", 1)], "customer_id string, article_id string, position int")
    got = history.co_visitation_scores(seen, met, 2)
    assert "hashpartitioning(customer_id" not in plan_of(got) and lists(got) == {"a": ["3", "2"], "b": ["3"]}


def test_neighbours_travel_as_one_row_an_article_and_numbers_give_ids_back(spark):
    met = spark.createDataFrame([("1", "0000000020", 3, 1), ("1", "0000000003", 3, 2), ("2", "0000000003", 1, 1)], "article_id string, other_id string, n bigint, rank int")
    seen = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("b", "2", 1)], "customer_id string, article_id string, position int")
    assert history.ten_digits(met) and not history.ten_digits(met.withColumn("other_id", F.lit("123456789a"))) and not history.ten_digits(met.withColumn("other_id", F.lit("12")))
    assert {r["article_id"]: r["others"] for r in history.neighbour_lists(met).collect()} == {"1": ["0000000020", "0000000003"], "2": ["0000000003"]}
    rows = [sorted(map(tuple, history.co_visitation_scores(seen, met, 2, digits=x).collect())) for x in (True, False)]
    assert rows[0] == rows[1] == [("a", "0000000003", 3.5, 1), ("a", "0000000020", 3.0, 2), ("b", "0000000003", 1.0, 1)]


def test_lists_that_all_targets_get_are_not_exchanged(spark):
    schema = "customer_id string, article_id string, source string, source_rank int, source_score double"
    own = spark.createDataFrame([("a", "1", "repeat", 1, 1.0), ("a", "7", "repeat", 2, 0.5)], schema)
    common = spark.createDataFrame([("", str(i), "recent_popularity", i, 1.0 / i) for i in range(1, 6)], schema).drop("customer_id")
    by_segment = spark.createDataFrame([("", "7", "age_segment_popularity", 1, 0.9)], schema).drop("customer_id").withColumn("segment", F.lit("x"))
    segments = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y"), ("b", None), ("z", "x")], "customer_id string, segment string")
    parts = candidates.Parts([own], people(spark, "a", "b", "c"), [common], segments, by_segment)
    wanted, got = features.pair_features(parts.rows()), features.pair_features(parts.by_customer(), placed=True)
    assert got.count() == wanted.count() == 16 and got.exceptAll(wanted).isEmpty()
    plan = plan_of(features.rank_by(got, 3, "max_source_score desc")).split("Generate inline")
    assert "Exchange" not in plan[0] and "Exchange" in plan[1]


def test_linear_submission_removes_tables_that_nothing_reads_any_more(spark):
    from wickerlane.plans import registry
    from wickerlane.workspace import children, shared_root

    kept = lambda: {p.rsplit("/", 1)[1] for p in children(spark, f"{shared_root(spark)}/wickerlane")}
    before = kept()
    assert registry.QUERIES["J23_linear_submission"](spark, "/root/testdata/sf0.001").count() == 150
    names = [x.rsplit("-", 1)[0] for x in kept() - before]
    assert names.count("purchase-state") == 1 and names.count("co-visitation") == 1 and not {"neighbours", "recent-values", "value-lists"} & set(names)


def test_values_that_meet_short_lists_keep_their_partitions(spark):
    lists_ = spark.createDataFrame([("v", "1", 1.0, 1)], "value string, article_id string, score double, rank int")
    mine = spark.createDataFrame([(c, "v", 1) for c in "abcdefgh"], "customer_id string, value string, position int")
    assert history.value_scores(mine, lists_).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_submission_text_is_filled_up_and_ids_come_back(spark):
    tx = log(spark, [("a", 1, 1), ("b", 3, 2), ("b", 3, 3), ("a", 2, 6), ("a", 1, 7)])
    own, who = predictions(spark, a=["9", "3"]), people(spark, "a", "c")
    want = {r["customer_id"]: r["prediction"] for r in submission.as_text(submission.backfilled(own, tx, D(8), who, 4, 3), who).collect()}
    assert {r["customer_id"]: r["prediction"] for r in submission.backfilled_text(own, tx, D(8), who, 4, 3).collect()} == want
    ids = people(spark, "ab" * 32, "AB" * 32, "a" * 32, "61" * 32, "", "é", None)
    packed = ids.select("customer_id", text.packed_customer("customer_id").alias("p"))
    assert all(r[0] == r[1] for r in packed.select("customer_id", text.unpacked_customer("p")).collect())
    assert packed.select("p").distinct().count() == 7


def test_attribute_affinity(spark):
    tx = log(spark, [("a", 1, 10), ("b", 2, 11), ("a", 3, 12), ("b", 4, 16)])
    kinds = spark.createDataFrame([("1", "Trousers"), ("2", "Trousers"), ("4", "Trousers"), ("3", "Shirts")], "article_id string, value string")
    assert lists(history.attribute_affinity(tx, D(16), people(spark, "a"), kinds)) == {"a": ["3", "1", "2"]}


def test_segments_and_season(spark):
    tx = log(spark, [("a", 1, 10), ("b", 2, 11), ("b", 3, 1), ("b", 3, 16)])
    seg = spark.createDataFrame([("a", "s"), ("b", "s")], "customer_id string, segment string")
    assert [r["article_id"] for r in sorted(popularity.segment_popularity(tx, D(16), seg, 7).collect(), key=lambda r: r["rank"])] == ["1", "2"]
    season = popularity.seasonal(log(spark, [("a", 1, 2), ("b", 1, 3), ("a", 2, 4), ("a", 4, 9)]), dt.date(2021, 1, 2), shift_days=366)
    assert [r["article_id"] for r in sorted(season.collect(), key=lambda r: r["rank"])] == ["1", "2"]
    with pytest.raises(ValueError):
        temporal.shifted(tx, D(9), 3, 7)


def test_age_segments(spark):
    ages = spark.createDataFrame([("a", "34"), ("b", ""), ("c", None), ("d", "25.0"), ("e", "0")], "customer_id string, age string")
    got = {r[0]: r[1] for r in popularity.age_segments(ages, 10, "unknown").collect()}
    assert got == {"a": "age_30_39", "b": "age_unknown", "c": "age_unknown", "d": "age_unknown", "e": "age_unknown"}
    with pytest.raises(Exception, match="invalid age"):
        popularity.age_segments(ages, 5).collect()


def predictions(spark, **lists_):
    return spark.createDataFrame([(c, a, i + 1) for c, l in lists_.items() for i, a in enumerate(l)], "customer_id string, article_id string, pos int")


def want(spark, **sets):
    return spark.createDataFrame([(c, a) for c, s in sets.items() for a in s], "customer_id string, article_id string").distinct()


@pytest.mark.parametrize("actual, predicted, k, ap", [("ab", "acb", 12, (1 + 2 / 3) / 2), ("ab", "aab", 12, (1 + 2 / 3) / 2), ("b", "aab", 2, 0.0), ("a", "", 12, 0.0)])
def test_average_precision(spark, actual, predicted, k, ap):
    got = metrics.per_customer(predictions(spark, x=predicted or "z"), want(spark, x=actual), k).first()
    assert got["ap"] == pytest.approx(ap)


def test_recall_cuts_before_it_drops_repeats(spark):
    assert metrics.per_customer(predictions(spark, x="aazb"), want(spark, x="aabc"), 3).first()["recall"] == pytest.approx(1 / 3)
    none = metrics.summary(metrics.per_customer(predictions(spark, x="a"), want(spark, x="a").limit(0), 3)).first()
    assert (none["customers"], none["map"]) == (0, 0.0)


def test_ceiling(spark):
    rows = spark.createDataFrame([("c", a) for a in "xaybz"], "customer_id string, article_id string")
    assert metrics.ceiling(rows, want(spark, c="abc")).first()["oracle_map"] == pytest.approx(2 / 3)


def test_percentiles(spark):
    df = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "n int")
    got = metrics.distribution(df).first()
    assert (got["minimum"], got["p50"], got["p90"], got["maximum"], got["mean"]) == (1, 2, 4, 4, 2.5)
    assert {r["percent"]: r["value"] for r in metrics.rounded_index_percentiles(df, "n", (50, 90)).collect()} == {50: 3, 90: 4}  # 1.5 rounds to 2


def test_feature_names_and_floor(spark):
    assert len(features.linear_names()) == len(features.linear_vector()) == 48
    assert len(behavioral.names()) == len(set(behavioral.names())) == 60
    rows = spark.createDataFrame([("c", "1", "text_similarity", 2, -0.5), ("c", "1", "repeat", 1, 1.0)], "customer_id string, article_id string, source string, source_rank int, source_score double")
    f = features.pair_features(rows).first()
    assert (f["source_count"], f["best_rank"], f["content_similarity_rank"], f["content_similarity_score"], f["text_similarity_rank"]) == (2, 1, 2, 0.0, 2)
    score = features.pair_features(rows).select(features.deterministic_score()).first()[0]
    assert score == pytest.approx(0.05 * 2 + 0.05 + 3.0 + 2.0 + 0.10)


def test_behavioral_features(spark):
    rows = [("c1", "1", 10), ("c1", "1", 15), ("c1", "2", 14), ("c1", "2", 17)]
    tx = log(spark, rows).withColumns({"price": F.lit(1.0), "sales_channel_id": F.lit(2)})
    arts = spark.createDataFrame([("1",), ("2",), ("3",)], "article_id string").withColumns({c: F.lit("v") for c in behavioral.ATTRIBUTES.values()})
    pairs = spark.createDataFrame([("c1", "1"), ("c9", "3")], "customer_id string, article_id string")
    got = {(r["customer_id"], r["article_id"]): r for r in behavioral.features(tx, D(16), pairs, arts).collect()}
    import math

    r = got["c1", "1"]
    assert (r["customer_transaction_count_log"], r["customer_unique_article_count_log"], r["article_1d_purchase_count_log"], r["article_7d_purchase_count_log"], r["article_days_since_last_purchase"]) == tuple(map(pytest.approx, (math.log1p(3), math.log1p(2), math.log1p(1), math.log1p(2), 1.0)))
    lone = got["c9", "3"]
    assert (lone["customer_transaction_count_log"], lone["customer_days_since_last_purchase"], lone["user_article_days_since_last_purchase"], lone["customer_tenure_days_log"]) == (0.0, 999.0, 999.0, pytest.approx(math.log1p(999)))


def slate(spark, rows):
    return spark.createDataFrame(rows, "ranker string, customer_id string, article_id string, pos int, score double")


def test_fusion(spark):
    s = slate(spark, [("strong", "c", "A", 1, 2.0), ("strong", "c", "B", 2, 1.0), ("weak", "c", "B", 1, 2.0), ("weak", "c", "A", 2, 1.0)])
    for fuse in (fusion.reciprocal_rank_fusion, fusion.consensus_fusion, fusion.z_score_fusion):
        assert lists(fuse(s, {"strong": 2.0}), by="pos")["c"][0] == "A"
    with pytest.raises(ValueError):
        fusion.reciprocal_rank_fusion(s, {"weak": -1.0})


def test_diversity(spark):
    ranked = spark.createDataFrame([("c", "A", 1.0, 1), ("c", "B", 0.95, 2), ("c", "C", 0.9, 3)], "customer_id string, article_id string, score double, pos int")
    tags = spark.createDataFrame([("A", "x", "y"), ("B", "x", "y"), ("C", "p", "q")], "article_id string, t1 string, t2 string")
    assert lists(fusion.diversify(ranked, tags, 2, 0.4), by="pos") == {"c": ["A", "C"]}


def test_tuning_equals_ranking_each_trial(spark):
    rows = spark.createDataFrame(
        [("c", "1", "garment_group_popularity", 1, 0.9), ("c", "2", "repeat", 1, 1.0), ("c", "3", "garment_group_popularity", 2, 0.5), ("d", "1", "repeat", 3, 0.3), ("d", "3", "garment_group_popularity", 1, 1.0)],
        "customer_id string, article_id string, source string, source_rank int, source_score double",
    )
    truth = want(spark, c="13", d="3")
    f = features.with_labels(features.pair_features(rows), truth)
    tried = tuning.trials({"garment_group_popularity_presence": (0.0, 9.0), "source_count": (0.0, 0.05)})
    got = {r["trial"]: r["map"] for r in tuning.evaluate_trials(f, truth, tried, 2).collect()}
    for i, t in enumerate(tried):
        ranked = features.deterministic_rank(f, 2, features.Weights(t))
        assert got[i] == pytest.approx(metrics.summary(metrics.per_customer(ranked, truth, 2)).first()["map"])
    assert tuning.best(tuning.evaluate_trials(f, truth, tried, 2), 1).first()["map"] == max(got.values())


def test_training_pairs_and_negatives(spark):
    tx = log(spark, [("a", i % 5, 1 + i) for i in range(9)] + [("b", 1, 12), ("b", 1, 13)])
    pos = training.positive_pairs(tx, "latest_customer")
    assert {r["customer_id"]: (r["article_id"], r["n"]) for r in pos.collect()} == {"a": ("3", 2), "b": ("1", 2)}
    bought = {(r["customer_id"], r["article_id"]) for r in tx.collect()}
    for how in ("random", "popularity", "mixed"):
        no = training.negatives(pos, tx, 2, sampling=how).collect()
        assert no and all((r["customer_id"], r["negative_id"]) not in bought for r in no)
        assert no == training.negatives(pos, tx, 2, sampling=how).collect() or sorted(no) == sorted(training.negatives(pos, tx, 2, sampling=how).collect())
    words = {r["item"]: r["idx"] for r in training.vocabulary(tx, "article_id").collect()}
    assert words == {str(i): i for i in range(5)}


def test_exact_search(spark):
    items = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", [0.0, 1.0])], "item string, vec array<double>")
    asked = spark.createDataFrame([("q", [1.0, 0.0])], "query string, vec array<double>")
    first = lambda m: [r["item"] for r in sorted(vectors.exact_search(asked, items, 3, m).collect(), key=lambda r: r["rank"])]
    assert (first("cosine"), first("dot"), first("l2")) == (["a", "b", "c"], ["b", "a", "c"], ["a", "b", "c"])
    with pytest.raises(ValueError):
        vectors.exact_search(asked, items, 3, "angle")


def test_submission_round_trip(spark, tmp_path):
    who = people(spark, "b" * 64, "a" * 64).withColumn("ord", F.when(F.col("customer_id").startswith("b"), 0).otherwise(1))
    rows = submission.as_text(predictions(spark, **{"b" * 64: ["0000000001", "0000000002"]}), who)
    submission.write_submission(rows, "ord", str(tmp_path / "s"))
    text = next((tmp_path / "s").glob("*.csv")).read_text().splitlines()
    assert text[0] == "customer_id,prediction" and text[1] == f"{'b' * 64},0000000001 0000000002" and text[2].startswith("a" * 64)
    known = spark.createDataFrame([("0000000001",)], "article_id string")
    bad = spark.createDataFrame([("b" * 64, "0000000001 0000000001"), ("b" * 64, "x"), ("zz", "")], "customer_id string, prediction string")
    got = {r["measure"]: r["value"] for r in validate.validate_submission(bad, who.select("customer_id"), known, 2).collect()}
    assert got == {"rows": 3, "malformed": 2, "unknown_customers": 1, "repeated_customers": 1, "missing_customers": 1, "too_many": 0, "too_few": 2, "repeated_articles": 1, "unknown_articles": 1}
    with pytest.raises(ValueError):
        validate.validate_submission(bad.drop("prediction"), who, known)


def test_contract(spark):
    df = spark.createDataFrame([("0000000001", "x"), ("0000000001", ""), ("7", None)], "article_id string, prod_name string")
    got = {(r["column"], r["measure"]): r["value"] for r in validate.validate(df, validate.ARTICLES).collect()}
    assert got["article_id", "invalid"] == 1 and got["article_id", "repeated"] == 1 and got["prod_name", "blank"] == 2 and got["product_code", "missing_column"] == 1
    assert validate.failures(validate.validate(df, validate.ARTICLES), validate.ARTICLES).count() == 3


def test_candidate_csv_header(spark, tmp_path):
    df = spark.createDataFrame([("c", "1", "repeat", 1, 1 / 3, 0.5)], "customer_id string, article_id string, source string, source_rank int, source_score double, content_user_cosine double")
    submission.write_candidates(df, str(tmp_path / "c"))
    back = submission.read_candidates(spark, str(tmp_path / "c")).first()
    assert (back["source_score"], back["content_user_cosine"], back["two_tower_score"]) == (0.3333333333, 0.5, 0.0)
    df.select("article_id", "customer_id").write.csv(str(tmp_path / "bad"), header=True)
    with pytest.raises(ValueError):
        submission.read_candidates(spark, str(tmp_path / "bad"))


def test_runs(spark):
    a, b, c = Run("a", {"x": 1}, 0.03, 0.0221), Run("b", {"x": 2}, 0.05, 0.03), Run("c", {"x": 3}, 0.09)
    assert champion([a, b, c]) is a and champion([b, c]) is b and champion([c]) is c and champion([]) is None
    merged = merge_runs([a], [Run("a", {"x": 1}, 0.04)])
    assert merged[0].offline == 0.04 and merged[0].public == 0.0221 and len(config_hash({"x": 1})) == 8
    assert report_text({"b": 1, "a": D(1)}).startswith('{\n  "a": "2020-01-01"')


def test_clock_rule():
    s = temporal.Split(D(15), 7)
    assert s.previous().end == s.cutoff
    for bad in (lambda: temporal.Split(D(1), 0), lambda: temporal.check_windows([s, s]), lambda: temporal.assert_before({"cutoff": "2020-02-01"}, D(1))):
        with pytest.raises(ValueError):
            bad()


def test_bad_grid():
    with pytest.raises(ValueError):
        tuning.trials({})
