"""Entity features, eager aggregation, trailing totals and broken lines: defined cases against brute force."""

from __future__ import annotations

import datetime as dt
from collections import defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from wickerlane.operators.eager import eager_join, key_states, roll_up
from wickerlane.operators.quarantine import REASONS, parse_transactions
from wickerlane.operators.rolling import trailing_totals
from wickerlane.sources.layered import Manifest, UpsertedTable
from wickerlane.streaming.entity_features import EntityFeatures, parquet_stream

D = dt.date
TX = "customer_id string, t_dat date, sales_channel_id int, price decimal(18,12), entity string, day string, n_all int"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# -- entity features -------------------------------------------------------------------------------------------
def events(spark, data):
    return spark.createDataFrame([(*r, "x", "y", 9) for r in data], TX)


def stream_of(spark, tmp_path, *batches):
    for i, b in enumerate(batches):
        events(spark, b).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return parquet_stream(spark, str(tmp_path / "in"), batches=len(batches))


EVENTS = [
    ("a", D(2023, 1, 1), 1, Decimal("1.5")),
    ("a", D(2023, 1, 9), 2, None),
    ("a", D(2023, 1, 10), 2, Decimal("2.5")),
    ("a", D(2023, 1, 10), 2, Decimal("2.5")),
    ("b", None, None, Decimal("4")),
    ("b", D(2023, 1, 4), 7, Decimal("-1")),
    (None, D(2023, 1, 4), 1, Decimal("1")),
    ("c", D(2023, 2, 1), 1, Decimal("1")),
]


DAY = D(2023, 1, 10)


def features(**kw):
    return EntityFeatures("customer_id", "t_dat", "sales_channel_id", "price", [1, 2], (7,), **kw)


def test_features_over_batches(spark, tmp_path):
    stream = stream_of(spark, tmp_path, EVENTS[:3], EVENTS[3:6], EVENTS[6:])
    out = {r["customer_id"]: r for r in features().run(spark, stream, str(tmp_path / "out"), str(tmp_path / "check"), DAY).collect()}
    assert set(out) == {"a", "b"}  # null entity and events after the day are left out
    a, b = out["a"], out["b"]
    assert (a["n_all"], a["n_type1"], a["n_type2"], a["n_all_7d"], a["n_type1_7d"]) == (4, 1, 3, 3, 0)
    assert (a["total_all"], a["mean_all"], a["total_type2_7d"], a["mean_type1_7d"]) == (6.5, 6.5 / 3, 5.0, None)
    assert (a["days_since_first_all"], a["days_since_last_type1"], a["days_since_last_type2"]) == (9, 9, 0)
    assert (b["n_all"], b["n_type1"], b["n_all_7d"], b["total_all"], b["days_since_last_all"], b["days_since_last_type1"]) == (2, 0, 1, 3.0, 6, None)


def test_features_go_on_after_a_restart_and_a_later_day(spark, tmp_path):
    """Runs with the same checkpoint, by a driver that knows no table, equal one batch of all events, as of any day."""
    f, where = features(), (str(tmp_path / "out"), str(tmp_path / "check"))
    f.run(spark, stream_of(spark, tmp_path, EVENTS[:2], EVENTS[2:3]), *where, DAY).collect()
    steps = [(EVENTS[4:6], DAY), ([], D(2023, 1, 14)), ([("a", D(2023, 1, 12), 1, Decimal("8"))], D(2023, 1, 20)), (EVENTS[3:4] + EVENTS[7:], D(2023, 2, 3))]
    seen = EVENTS[:3]
    for data, day in steps:  # another entity; nothing new, but a later day; the first entity again; a late event
        seen = seen + data
        for t in spark.catalog.listTables():
            if t.name.startswith("wickerlane_"):
                spark.sql(f"DROP TABLE {t.name}")
        stream = stream_of(spark, tmp_path, data) if data else parquet_stream(spark, str(tmp_path / "in"))
        got = f.run(spark, stream, *where, day)
        assert rows(got) == rows(f.features(f.counters(events(spark, seen)), day))


def test_features_of_nothing(spark, tmp_path):
    out = features().run(spark, stream_of(spark, tmp_path, []), str(tmp_path / "out"), str(tmp_path / "check"), DAY)
    assert out.count() == 0 and "mean_type2_7d" in out.columns
    with pytest.raises(ValueError):
        EntityFeatures("a", "b", "c", "d", [], (0,))


def test_hundreds_of_types(spark):
    kinds = list(range(300))
    f = EntityFeatures("customer_id", "t_dat", "sales_channel_id", "price", kinds, (7, 30))
    data = [(f"c{i % 5}", D(2023, 1, 1 + i % 10), i % 310, Decimal(i)) for i in range(2000)]
    got = {r["customer_id"]: r for r in f.features(f.counters(events(spark, data)), DAY).collect()}
    for c in ("c0", "c3"):
        mine = [x for x in data if x[0] == c]
        assert got[c]["n_all"] == len(mine) and got[c]["total_all_7d"] == float(sum(x[3] for x in mine if x[1] > D(2023, 1, 3)))
        for k in (0, 3, 13, 299):
            own = [x for x in mine if x[2] == k]
            assert (got[c][f"n_type{k}"], got[c][f"total_type{k}"]) == (len(own), float(sum(x[3] for x in own)))
            assert got[c][f"days_since_last_type{k}"] == (min((DAY - x[1]).days for x in own) if own else None)


def test_a_hot_entity_with_many_events_is_a_few_rows(spark, tmp_path):
    data = [("hot", D(2023, 1, 1 + i % 9), i % 2 + 1, Decimal(1)) for i in range(2000)]
    f = features()
    got = f.run(spark, stream_of(spark, tmp_path, data[:900], data[900:]), str(tmp_path / "out"), str(tmp_path / "check"), DAY)
    assert [r["n_all"] for r in got.collect()] == [2000]
    assert UpsertedTable(spark, str(tmp_path / "out"), f.counters(events(spark, [])).schema, list(f.KEYS)).read().count() == 18


# -- layered tables --------------------------------------------------------------------------------------------
def test_upserts_are_kept_once_and_fold(spark, tmp_path):
    path, keys = str(tmp_path / "t"), ["k"]
    want = {}
    for number, batch in enumerate([[(i, i) for i in range(100)], [(1, 7), (500, 1)], [(1, 8)], [], [(i, -i) for i in range(60)]]):
        t = UpsertedTable(spark, path, "k bigint, v bigint", keys, buckets=3)
        df = spark.createDataFrame(batch, "k bigint, v bigint")
        before = {f: f.stat().st_size for f in (tmp_path / "t").rglob("*.parquet")}
        assert t.upsert(df, "s", number) and not t.upsert(df, "s", number)
        if number == 1:
            new = [f for f in (tmp_path / "t").rglob("*.parquet") if f not in before]
            assert before and all(f.exists() for f in before) and len(new) <= 2, "a small batch writes a small layer"
        want |= dict(batch)
        assert {r["k"]: r["v"] for r in UpsertedTable(spark, path, "k bigint, v bigint", keys).read().collect()} == want
    assert len(t.state["layers"]) <= 2


def test_a_manifest_that_was_not_finished_does_not_count(spark, tmp_path):
    m = Manifest(spark, str(tmp_path))
    assert m.read() is None
    m.write({"a": 1})
    m.write({"a": 2})
    (tmp_path / "manifest" / "new-x").write_text("{")
    assert Manifest(spark, str(tmp_path)).read() == {"a": 2}


# -- eager aggregation -----------------------------------------------------------------------------------------
LEFT = [("a", "x", 1.0, 3, 7), ("a", "y", 2.0, 9, 7), ("a", "x", None, 1, 7), ("b", None, 5.0, 2, 7), ("c", "z", 1.0, 1, 7), (None, "z", 1.0, 1, 7)]
RIGHT = [("a", "g1", 10), ("a", "g2", 20), ("a", "g1", None), ("b", "g2", 5), (None, "g1", 1), ("z", "g1", 1)]


def frames(spark):
    left = spark.createDataFrame(LEFT, "k string, who string, x double, day int, n int")  # n clashes with the state's name
    return left, spark.createDataFrame(RIGHT, "k string, g string, y int")


def test_eager_join_equals_the_join(spark):
    left, right = frames(spark)
    got = eager_join(key_states(left, "k", ["x"], ["day"], "who"), key_states(right, "k", ["y"]), "k")
    raw = left.join(right, "k").groupBy("k").agg(F.count(F.lit(1)), F.sum("x"), F.sum("y"), F.max("day"), F.count_distinct("who"))
    assert rows(got.select("k", "rows", "left_s_x", "right_s_y", "left_m_day", "left_d")) == rows(raw)


def test_eager_roll_up_equals_the_join(spark):
    left, right = frames(spark)
    got = roll_up(eager_join(key_states(left, "k", ["x"], ["day"]), key_states(right, "k", ["y"], also=["g"]), "k", by=["g"]), ["g"])
    raw = left.join(right, "k").groupBy("g").agg(F.count(F.lit(1)), F.sum("x"), F.sum("y"), F.max("day"))
    assert rows(got.select("g", "rows", "left_s_x", "right_s_y", "left_m_day")) == rows(raw)


def test_eager_left_join_keeps_lonely_keys(spark):
    left, right = frames(spark)
    got = eager_join(key_states(left, "k"), key_states(right, "k"), "k", "left")
    assert rows(got.select("k", "n_left", "n_right", "rows")) == [("a", 3, 3, 9), ("b", 1, 1, 1), ("c", 1, None, 1)]
    empty = left.limit(0)
    assert eager_join(key_states(empty, "k", ["x"]), key_states(right, "k"), "k").count() == 0
    assert eager_join(key_states(left, "k"), key_states(right.limit(0), "k"), "k", "left").count() == 3
    with pytest.raises(ValueError):
        eager_join(left, right, "k", "full")


# -- trailing totals -------------------------------------------------------------------------------------------
SALES = [("a", D(2023, 1, 1), 2.0), ("a", D(2023, 1, 1), 4.0), ("a", D(2023, 1, 3), None), ("b", D(2023, 1, 5), -1.0), (None, D(2023, 1, 5), 1.0), ("b", None, 1.0)]


def brute(data, periods, first, last):
    out = {}
    for e in {r[0] for r in data if r[0] and r[1]}:
        for i in range((last - first).days + 1):
            day = first + dt.timedelta(days=i)
            cell = []
            for p in periods:
                inside = [r for r in data if r[0] == e and r[1] and day - dt.timedelta(days=p) < r[1] <= day]
                v = [r[2] for r in inside if r[2] is not None]
                cell += [len(inside), sum(v, 0.0), sum(v) / len(v) if v else None]
            out[e, day] = tuple(cell)
    return out


def test_trailing_totals_match_brute_force(spark):
    df = spark.createDataFrame([(*r, 1, 2) for r in SALES], "entity string, day date, value double, n int, ahead int")
    got = {(r[0], r[1]): tuple(r[2:]) for r in trailing_totals(df, "entity", "day", "value", (2, 4)).collect()}
    assert got == brute(SALES, (2, 4), D(2023, 1, 1), D(2023, 1, 5))


def test_trailing_totals_of_given_entities_and_of_nothing(spark):
    df = spark.createDataFrame(SALES, "e string, d date, v double")
    want = spark.createDataFrame([("a",), ("q",), ("a",), (None,)], "e string")
    got = trailing_totals(df, "e", "d", "v", (3,), entities=want)
    assert {r["e"] for r in got.collect()} == {"a", "q"} and got.count() == 10
    assert got.where("e = 'q'").agg(F.sum("rows_3")).first()[0] == 0
    assert trailing_totals(df.limit(0), "e", "d", "v").count() == 0
    with pytest.raises(ValueError):
        trailing_totals(df, "e", "d", "v", ())


def test_trailing_totals_never_broadcast_the_days_of_few_entities(spark):
    df = spark.createDataFrame([(str(i), D(2023, 1, 1 + i % 9), 1.0) for i in range(200)], "e string, d date, v double").repartition(3)
    want = df.select("e").where("e < '3'")
    out = trailing_totals(df, "e", "d", "v", entities=want, span=(D(2021, 1, 1), D(2023, 12, 31))).where("rows_30 >= 1 AND rows_7 = 0")
    assert len(out.collect()) == sum(1 for i in range(200) if str(i) < "3") * 23
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and not [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "day#" in line]


# -- broken lines ----------------------------------------------------------------------------------------------
C, A = "ab" * 32, "0123456789"
GOOD = f"2023-05-06,{C},{A},0.5,1"
LINES = [
    (GOOD, None), (GOOD + "\r", None), (f'"2023-05-06","{C}","{A}","0.5","1"', None), (f'2023-05-06,"{C}",{A},12,2', None), (GOOD, None),
    ("", "column_count"), (None, "column_count"), ("\r", "column_count"), (GOOD + ",", "column_count"), (GOOD.replace(",", ";"), "column_count"),
    (f'2023-05-06,"{C},{A},0.5,1', "quoting"), (f'2023-05-06,{C}",{A},0.5,1', "quoting"), (f'2023-05-06,"{C}" ,{A},0.5,1', "quoting"), (f'"a"b",{GOOD}', "quoting"), ('"', "quoting"),
    (f'2023-05-06,"{C},{A}",0.5,1', "column_count"), (f'2023-05-06,"{C},",{A},0.5,1', "customer_id"), (f'2023-05-06,"{C}""",{A},0.5,1', "customer_id"), (f'"",{C},{A},0.5,1', "t_dat"),
    (f"2023-02-30,{C},{A},0.5,1", "t_dat"), (f"2023-5-6,{C},{A},0.5,1", "t_dat"), (f" {GOOD}", "t_dat"), (f"２０２３-05-06,{C},{A},0.5,1", "t_dat"), (f"0000-01-01,{C},{A},1,1", "t_dat"), (f"2024-02-29,{C},{A},1,1", None),
    (f"2023-05-06,{C.upper()},{A},0.5,1", "customer_id"), (f"2023-05-06,{C}0,{A},0.5,1", "customer_id"), (f"2023-05-06,,{A},0.5,1", "customer_id"),
    (f"2023-05-06,{C},{A}1,0.5,1", "article_id"), (f"2023-05-06,{C}, {A},0.5,1", "article_id"), (f"2023-05-06,{C},1.0E+08,0.5,1", "article_id"),
    *[(f"2023-05-06,{C},{A},{p},1", "price") for p in ("", "-1", "+1", ".5", "5.", "1e3", "NaN", "0.5 ", "$1")],
    *[(f"2023-05-06,{C},{A},0.5,{c}", "sales_channel_id") for c in ("", "3", "1.0", " 1", "01")],
    (f"{GOOD}\n", "sales_channel_id"), (f"{GOOD}\r\r", "sales_channel_id"), ("x" * 200_000, "column_count"), ('"' * 100_001, "quoting"), ("," * 100_000, "column_count"), ('""' * 50_000 + ",", "column_count"),
]


def test_every_reason(spark):
    df = spark.createDataFrame([(i, line, "r", "c") for i, (line, _) in enumerate(LINES)], "raw_id bigint, raw_line string, reason string, line string")
    got = {r["raw_id"]: r for r in parse_transactions(df).collect()}
    assert {i: r["reason"] for i, r in got.items()} == {i: why for i, (_, why) in enumerate(LINES)}
    for i, (_, why) in enumerate(LINES):
        fields = [got[i][c] for c in ("t_dat", "customer_id", "article_id", "price", "sales_channel_id")]
        assert all(f is None for f in fields) if why else None not in fields
    assert tuple(got[0])[1:6] == (D(2023, 5, 6), C, A, Decimal("0.500000000000"), 1)
    assert got[2]["customer_id"] == C and got[3]["price"] == 12
    assert {r["reason"] for r in got.values()} - {None} == set(REASONS)


def test_lines_of_extreme_prices_and_of_nothing(spark):
    df = spark.createDataFrame([(1, f"2023-05-06,{C},{A},{'9' * 40}.5,1"), (2, f"2023-05-06,{C},{A},0.{'1' * 40},1")], "raw_id bigint, raw_line string")
    got = {r["raw_id"]: r for r in parse_transactions(df).collect()}
    assert (got[1]["reason"], got[1]["price"], got[1]["article_id"]) == (None, None, A) and got[2]["price"] == Decimal("0.111111111111")
    assert parse_transactions(df.limit(0)).count() == 0


def test_hot_key_is_spread(spark):
    """One key with most rows: the first exchange of the distinct count is by key and value."""
    df = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), (F.col("id") % 1000).alias("who"))
    state = key_states(df, "k", distinct="who").where("k = 'hot'").first()
    counted = defaultdict(set)
    for i in range(20_000):
        if i % 3:
            counted["hot"].add(i % 1000)
    assert (state["n"], state["d"]) == (sum(1 for i in range(20_000) if i % 3), len(counted["hot"]))
