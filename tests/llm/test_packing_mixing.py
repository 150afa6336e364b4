"""Containers and mixtures: what must hold of every result."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wickerlane.llm.mixing import best_total, mix, pfair, reachable, stray
from wickerlane.llm.packing import best_fit, pack
from wickerlane.llm.tokens import encoder, token_count


# -- packing ---------------------------------------------------------------------------------------------------
@given(st.lists(st.integers(0, 50), max_size=80))
@settings(max_examples=60, deadline=None)
def test_best_fit_takes_the_tightest_bin(sizes):
    where, fills = best_fit(sizes, 50)
    open_: list[int] = []
    for s, b in zip(sizes, where):
        fitting = [50 - u for u in open_ if 50 - u >= s]
        if b == len(open_):
            assert not fitting
            open_.append(0)
        else:
            assert 50 - open_[b] == min(fitting)
        open_[b] += s
    assert open_ == fills and all(u <= 50 for u in fills)


def packed(spark, sizes, capacities, **kw):
    df = spark.createDataFrame([(i, s, "x", 1) for i, s in sizes], "doc bigint, size bigint, kind string, capacity int")
    kinds = spark.createDataFrame(capacities, "kind string, capacity int")
    return pack(df, "doc", "size", kinds, **kw).collect()


@pytest.mark.parametrize("task_items", [8192, 40])
def test_containers(spark, task_items):
    rnd = random.Random(task_items)
    sizes = [(i, rnd.choice([None, 0, -5, 1, 7, 30, 55, 99, 100, 101, 250, 300])) for i in range(400)] + [(5, 30), (5, 30), (None, 20)]
    rows = packed(spark, sizes, [("small", 100), ("large", 1000)], task_items=task_items)
    for kind, cap in (("small", 100), ("large", 1000)):
        mine = [r for r in rows if r["kind"] == kind]
        fill = defaultdict(int)
        for r in mine:
            fill[r["container"]] += r["size"]
        assert all(0 <= u <= cap for u in fill.values())
        whole = lambda s: max(0, s or 0)
        total = sum(whole(s) for _, s in sizes)
        assert sum(fill.values()) == total
        assert Counter(r["doc"] for r in mine) == Counter(i for i, s in sizes for _ in range(max(1, -(-whole(s) // cap))))
        for i, s in sizes:  # only what is larger than the capacity is cut
            if whole(s) <= cap:
                assert any(r["doc"] == i and r["size"] == whole(s) and r["piece"] == 0 for r in mine)
        assert total / (len(fill) * cap) > (0.85 if task_items == 40 else 0.9)
        least = sorted(fill.values())[:2]
        assert len(fill) == 1 or sum(least) > cap or task_items == 40, "no two containers fit together"


def test_containers_are_merged_to_the_end(spark):
    """A thousandth of the items are small, and their tasks can't place them: later rounds put all of them away."""
    rnd = random.Random(2)
    sizes = [(i, 60) for i in range(3000)] + [(-i, 41) for i in range(1, 40)] + [(i, 3) for i in range(5000, 5040)]
    rnd.shuffle(sizes)
    fill = defaultdict(int)
    for r in packed(spark, sizes, [("a", 100)], task_items=50):
        fill[r["container"]] += r["size"]
    assert len(fill) == 3000 + 20 and sum(2 * u <= 100 for u in fill.values()) <= 1


def test_no_containers(spark):
    assert packed(spark, [], [("a", 10)]) == []
    assert [r["size"] for r in packed(spark, [(1, 0)], [("a", 10)])] == [0]
    with pytest.raises(ValueError):
        packed(spark, [(1, 1)], [("a", 0)])


def test_token_counts(spark):
    texts = [(0, None), (1, ""), (2, "hello world"), (3, "слово " * 2000), (4, "日本語😀"), (5, "a" * 60_000)]
    got = {r[0]: r[1] for r in spark.createDataFrame(texts, "i int, text string").select("i", token_count("text")).collect()}
    encode = encoder("/opt/tokenizers/byte_bpe_50k.tiktoken")
    assert got == {i: len(encode([t])[0]) if t else 0 for i, t in texts} and got[2] == 2


def test_two_files_of_one_vocabulary_agree():
    texts = ["Soft cotton, 42 cm; it’s warm.", "Größe 38 fällt aus wie üblich"]
    a, b = encoder("/opt/tokenizers/byte_bpe_50k.tiktoken")(texts), encoder("/opt/tokenizers/byte_bpe_50k.json")(texts)
    assert [list(x) for x in a] == [list(x) for x in b]
    assert all(encoder("/opt/tokenizers/piece_bpe_32k.model")(texts))


# -- mixing ----------------------------------------------------------------------------------------------------
@given(st.dictionaries(st.sampled_from("abcdef"), st.integers(0, 40), min_size=1), st.integers(1, 4))
@settings(max_examples=120, deadline=None)
def test_pfair_stays_within_one_block(blocks, segments):
    segments = max(1, min(segments, sum(blocks.values()) // (8 * len(blocks))))
    order = [x for k in range(segments) for x in pfair(blocks, segments, k)]
    total, seen = sum(blocks.values()), Counter()
    assert Counter((s, i) for s, i, _ in order) == Counter((s, i) for s, n in blocks.items() for i in range(n))
    few = sum(0 < n < 3 * segments for n in blocks.values()) if segments > 1 else 0
    for t, (s, i, slot) in enumerate(order, 1):
        assert seen[s] == i and slot == t - 1
        seen[s] += 1
        assert all(abs(seen[x] - t * n / total) < (1 if segments == 1 else 2 + few) for x, n in blocks.items())


def test_shares_within_caps():
    targets, most = {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 100, "b": 1000, "c": 0}
    assert reachable(80, targets, most) == pytest.approx({"a": 50, "b": 30, "c": 0})
    assert reachable(400, targets, most) == pytest.approx({"a": 100, "b": 300, "c": 0})
    assert reachable(9999, targets, most) == pytest.approx({"a": 100, "b": 1000, "c": 0})
    assert best_total(targets, most, 0.0) == pytest.approx(200) and best_total(targets, most, 1.0) == 1100
    assert best_total(targets, {s: 0 for s in most}, 0.1) == 0 and stray({"a": 0.0}, {"a": 1.0}) == 1.0
    # Coarse records make a larger total better, fine ones hardly move it.
    assert best_total(targets, most, 0.0, {"a": 60.0, "b": 60.0}) > best_total(targets, most, 0.0, {"a": 1e-6, "b": 1e-6}) == pytest.approx(200, rel=1e-2)
    t = best_total(targets, most, 0.05)
    assert stray(reachable(t, targets, most), targets) <= stray(reachable(200, targets, most), targets) + 0.051


def mixed(spark, records, targets, **kw):
    df = spark.createDataFrame([(*r, 1, "s") for r in records], "doc bigint, source string, size bigint, repeat int, strand string")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    a, b = mix(df, "doc", "source", "size", t, **kw)
    return sorted(a.collect(), key=lambda r: (r["slot"], r["place"])), {r["source"]: r for r in b.collect()}


def test_mixture(spark):
    rnd = random.Random(1)
    records = [(i, rnd.choice(["big", " BIG", "big", "small", "rare", None, "other"]), rnd.randrange(0, 60)) for i in range(3000)]
    targets = [("big", 0.5, 1), ("small", 0.4, 3), ("rare", 0.05, 2), ("none", 0.05, 4)]
    rows, told = mixed(spark, records, targets, block=200, strand_rows=300)
    name = {i: (s or "").strip().lower() for i, s, _ in records}
    size = {i: n for i, _, n in records}
    assert all(name[r["doc"]] == r["source"] and size[r["doc"]] == r["size"] > 0 for r in rows)
    uses = Counter(r["doc"] for r in rows)
    caps = {s: m for s, _, m in targets}
    assert all(n <= caps[name[i]] for i, n in uses.items()) and set(told) == set(caps)
    assert max(uses.values()) > 1 and len({(r["doc"], r["repeat"]) for r in rows}) == len(rows)
    total = sum(r["size"] for r in rows)
    for s, r in told.items():
        assert r["tokens"] == sum(x["size"] for x in rows if x["source"] == s)
        assert r["actual_share"] == pytest.approx(r["tokens"] / total) and abs(r["actual_share"] * total - r["reachable_share"] * total) <= 120
    sofar, at, share = Counter(), 0, {s: r["tokens"] / total for s, r in told.items()}
    for r in rows:
        sofar[r["source"]] += r["size"]
        at += r["size"]
        assert all(abs(sofar[s] - share[s] * at) < 2 * 200 + 60 for s in share)


def test_mixture_of_several_segments(spark):
    """Blocks keep their size when the mixture outgrows one segment; shares hold to within one block and a fraction at any place."""
    rnd = random.Random(4)
    records = [(i, rnd.choice("aaaaaabbbc"), 10) for i in range(6000)] + [(-1, "tiny", 10)]
    targets = [("a", 0.6, 1), ("b", 0.3, 1), ("c", 0.1, 1), ("tiny", 0.0005, 1)]
    rows, _ = mixed(spark, records, targets, block=10, segment=100)
    one, _ = mixed(spark, records, targets, block=10)
    assert Counter(r["source"] for r in rows) == Counter(r["source"] for r in one)
    n, seen = Counter(r["source"] for r in rows), Counter()
    assert len({r["slot"] for r in rows}) == len(rows) > 1000 and n["tiny"] == 1
    for t, r in enumerate(rows, 1):
        seen[r["source"]] += 1
        assert all(abs(seen[s] - t * n[s] / len(rows)) < 1 + 0.6 for s in n)  # one source has a block in all


def test_blocks_keep_their_size(spark):
    """A hundred times the records give a hundred times the blocks, each of the same size."""
    def blocks(n):
        rows, _ = mixed(spark, [(i, "ab"[i % 2], 10) for i in range(n)], [("a", 0.5, 1), ("b", 0.5, 1)], block=100, segment=64, strand_rows=100)
        return Counter(r["slot"] for r in rows)
    few, many = blocks(200), blocks(20_000)
    assert len(many) == 100 * len(few) and set(few.values()) == set(many.values()) == {10}


def test_mixture_of_a_given_total_and_of_nothing(spark):
    records = [(i, "a" if i % 3 else "b", 10) for i in range(300)]
    rows, told = mixed(spark, records, [("a", 0.5, 1), ("b", 0.5, 1)], total=1000, block=50)
    assert sum(r["size"] for r in rows) == 1000 and told["a"]["tokens"] == told["b"]["tokens"] == 500
    rows, told = mixed(spark, [], [("a", 1.0, 2)])
    assert rows == [] and told["a"]["actual_share"] == 0.0
    with pytest.raises(ValueError):
        mixed(spark, records, [("a", 1.0, 1)], block=0)


def test_one_repeated_id(spark):
    rows, _ = mixed(spark, [(7, "a", 5)] * 100, [("a", 1.0, 1)], block=20)
    assert sum(r["size"] for r in rows) == 500
