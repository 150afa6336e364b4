"""Top-N per group and the pair table against brute force, with the defined cases."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from wickerlane.llm.cooccur import PairTable
from wickerlane.llm.topn import top_n_per_group

NAN, INF = float("nan"), float("inf")


def brute_top(data, n):
    best = defaultdict(dict)
    for g, i, s in data:
        if i is not None and s is not None and not math.isnan(s):
            best[g][i] = max(best[g].get(i, -INF), s + 0.0)
    return {(g, i, s, r) for g, d in best.items() for r, (i, s) in enumerate(sorted(d.items(), key=lambda x: (-x[1], x[0]))[:n], 1)}


def top(spark, data, n, **kw):
    df = spark.createDataFrame([(*r, 5, "e", 1) for r in data], "grp string, item string, score double, rank int, g0 string, salt int")
    return {tuple(r) for r in top_n_per_group(df, ["grp"], "item", "score", n, **kw).collect()}


@pytest.mark.parametrize("kw", [{}, {"units": 1}, {"units": 40}, {"units": 100_000}])
def test_top_n(spark, kw):
    rnd = random.Random(3)
    data = [(rnd.choice(["a", "b", "hot", "hot", "hot", None]), f"i{rnd.randrange(40)}", rnd.choice([0.5, -0.0, 0.0, 1.0, -2.0, INF, None, NAN])) for _ in range(900)]
    data += [("one", "i1", 1.0), ("gone", None, 1.0), ("gone", "i", NAN), ("", "i" * 10_000, 2.0)]
    assert top(spark, data, 4, **kw) == brute_top(data, 4)


def test_large_groups_have_several_salts(spark):
    """The largest group of the table with sf0.01 rows is ranked in several subgroups."""
    rows = spark.read.parquet("/root/testdata/sf0.01/attribute_candidates.parquet")
    plan = top_n_per_group(rows, ["group_field", "group_value"])
    first = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "salt" in first
    size = rows.groupBy("group_field", "group_value").count().agg({"count": "max"}).first()[0]
    units = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert size * units > rows.count(), "the largest group holds more than one unit"


def test_top_n_of_nothing(spark):
    assert top(spark, [], 3) == set()
    with pytest.raises(ValueError):
        top(spark, [], 0)


def brute_pairs(rows):
    baskets = defaultdict(set)
    for c, d, i in rows:
        if None not in (c, d, i):
            baskets[c, d].add(i)
    one, two = Counter(), Counter()
    for s in baskets.values():
        one.update(s)
        two.update(combinations(sorted(s), 2))
    return len(baskets), one, two


SCHEMA = "c string, d int, item string, n bigint, was int, basket string, k0 int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], SCHEMA)


def state(table):
    return table.baskets, Counter({r["item"]: r["n"] for r in table.items().collect()}), Counter({(r["item_a"], r["item_b"]): r["n"] for r in table.pairs().collect()})


def some(seed, n=300):
    rnd = random.Random(seed)
    return [(rnd.choice(["a", "b", "hot", None, ""]), rnd.choice([1, 2, 3, None]), rnd.choice([*"pqrstuvw", None, "y" * 500])) for _ in range(n)]


@pytest.mark.parametrize("block", [512, 2])
def test_pair_table_over_batches(spark, tmp_path, block):
    """Additions over three batches, then withdrawals, equal counting what is left; blocks of two items force the blocked path."""
    a, b, c = some(1), some(2, 40), some(3, 40)
    t = PairTable(spark, f"file://{tmp_path}/t", ["c", "d"], "item", block_items=block)
    t.apply(frame(spark, a))
    assert state(t) == brute_pairs(a)
    t.apply(frame(spark, b))
    t.apply(frame(spark, []))
    t.apply(frame(spark, c))
    assert state(t) == brute_pairs(a + b + c)
    t.apply(frame(spark, b), sign=-1)
    assert state(t) == brute_pairs(a + c)
    check_scores(t, a + c)
    t.apply(frame(spark, a), sign=-1)
    again = PairTable(spark, f"file://{tmp_path}/t", ["c", "d"], "item", block_items=block)
    assert state(again) == brute_pairs(c)
    check_scores(again, c)


def check_scores(table, rows):
    n, one, two = brute_pairs(rows)
    got = {(r["item_a"], r["item_b"]): r for r in table.scores(2).collect()}
    assert set(got) == {p for p, k in two.items() if k >= 2}
    for (x, y), r in got.items():
        assert (r["n_ab"], r["n_a"], r["n_b"]) == (two[x, y], one[x], one[y])
        assert r["lift"] == pytest.approx(two[x, y] * n / (one[x] * one[y]))


def test_scores_follow_the_batches(spark, tmp_path):
    """Scores read between batches are those of all rows so far, also of pairs that fell below the threshold."""
    a, b = some(5), some(6, 60)
    t = PairTable(spark, f"file://{tmp_path}/t", ["c", "d"], "item", scored_from=2)
    rows = []
    for batch, sign in ((a, 1), (b, 1), (b, -1), (a[100:], -1), (a[:3], 1)):
        t.apply(frame(spark, batch), sign)
        if sign > 0:
            rows = rows + batch
        else:
            for r in batch:
                rows.remove(r)
        check_scores(t, rows)
    with pytest.raises(ValueError):
        t.scores(1)


def test_a_small_batch_is_small_work_and_counts_once(spark, tmp_path):
    """A batch of one basket after many writes a few rows, reads the members of its own basket, and its retry changes nothing."""
    path = tmp_path / "t"
    t = PairTable(spark, f"file://{path}", ["c", "d"], "item")
    first = [(f"c{i}", i % 7, x) for i in range(4000) for x in ("p", "q", f"r{i % 50}")]
    assert t.apply(frame(spark, first), number=0)
    files = {f: f.stat().st_mtime_ns for f in path.rglob("*.parquet")}
    second = [("c1", 1, "s"), ("c1", 1, "p"), ("new", 1, "q")]
    assert t.apply(frame(spark, second), number=1) and not t.apply(frame(spark, second), number=1)
    added = [f for f in path.rglob("*.parquet") if f not in files]
    assert all(f.exists() and f.stat().st_mtime_ns == n for f, n in files.items()), "held files are left as they are"
    assert sum(f.stat().st_size for f in added) < 0.1 * sum(f.stat().st_size for f in files)
    assert [x[1] for x in t.state["members"]] == [4000, 2]
    again = PairTable(spark, f"file://{path}", ["c", "d"], "item")
    assert not again.apply(frame(spark, second), number=1) and state(again) == brute_pairs(first + second)


def test_early_withdrawal_waits_and_nothing_gives_nothing(spark, tmp_path):
    t = PairTable(spark, f"file://{tmp_path}/t", ["c", "d"], "item")
    t.apply(frame(spark, []))
    assert state(t) == (0, Counter(), Counter()) and t.scores().count() == 0
    t.apply(frame(spark, [("a", 1, "p"), ("a", 1, "q")]), sign=-1)
    assert state(t)[0] == 0
    t.apply(frame(spark, [("a", 1, "p"), ("a", 1, "q"), ("a", 1, "q")]))
    assert state(t) == (1, Counter({"q": 1}), Counter())
    with pytest.raises(ValueError):
        PairTable(spark, str(tmp_path), [], "item")
