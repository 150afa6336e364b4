"""The neighbour graph against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wickerlane.llm.knn import NeighbourGraph
from wickerlane.operators.vectors import newest

VECTORS = "embeddings_path string, article_id string, embedding_index bigint, vector array<float>, grp int, vec int"


def rows_of(n, dim, seed, clusters=12):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, dim))
    m = centres[rng.integers(0, clusters, n)] + 0.25 * rng.standard_normal((n, dim))
    return m * rng.uniform(0.01, 100, (n, 1))


def usable(spark, data, dims):
    df = spark.createDataFrame([(*r, 1, 2) for r in data], VECTORS)
    return newest(df, "embeddings_path", "article_id", "embedding_index", "vector", spark.createDataFrame(dims, "grp string, dim int"))


def brute(items, m, k):
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -9)
    order = np.argsort(items)
    return {items[i]: [(items[j], s[i, j]) for j in sorted(order, key=lambda j: -s[i, j])[:k] if j != i] for i in range(len(items))}


@pytest.fixture(scope="module")
def graph(spark):
    m, o = rows_of(500, 16, 1).astype(np.float32), rows_of(60, 8, 2).astype(np.float32)
    data = [("p", f"{i:010d}", i, m[i].tolist()) for i in range(500)] + [("q", f"{i:010d}", 1000 + i, o[i].tolist()) for i in range(60)]
    data += [("p", f"{i:010d}", 600 + i, m[i].tolist()) for i in range(5)]  # newer rows of the same articles
    data += [("p", "x", 700, None), ("p", "y", 701, [1.0] * 15), ("p", "z", 702, [0.0] * 16), ("p", "w", 703, [float("nan")] * 16), ("p", "v", 704, [float("inf")] * 16), (None, "u", 705, [1.0] * 16)]
    return NeighbourGraph(usable(spark, data, [("p", 16), ("q", 8), ("none", 4)]), leaf=40), m, o


def test_recall_and_exact_similarities(graph):
    g, m, o = graph
    got: dict = {}
    for r in sorted(g.neighbours(10).collect(), key=lambda r: r["rank"]):
        got.setdefault((r["grp"], r["item"]), []).append((r["other"], r["similarity"]))
    hits = total = 0
    for grp, x in (("p", m), ("q", o)):
        names = [f"{i:010d}" for i in range(len(x))]
        for item, best in brute(names, x.astype(float), 10).items():
            mine = dict(got[grp, item])
            hits += len(mine.keys() & dict(best).keys())
            total += 10
            for other, s in best:
                if other in mine:
                    assert mine[other] == pytest.approx(s, abs=2e-6)
    assert len(got) == 560 and hits / total >= 0.95


def test_search_recall(graph, spark):
    g, m, _ = graph
    asked = g.vectors.where((F.col("grp") == "p") & (F.col("id") % 25 == 0)).select(F.col("id").alias("query"), "grp", "vec")
    found: dict = {}
    for r in g.search(asked, 10).collect():
        found.setdefault(r["query"], set()).add(r["id"])
    u = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    true = lambda q: {600 + j if j < 5 else j for j in np.argsort(-(u @ u[q]), kind="stable")[:10]}
    recall = np.mean([len(found[q] & true(q if q < 600 else q - 600)) / 10 for q in found])
    assert len(found) == asked.count() and recall >= 0.9


def test_copies_of_a_third(spark):
    """A third of the rows are one vector: each of them has the first ten others by name, at 1."""
    m = rows_of(120, 8, 5).astype(np.float32)
    m[:40] = m[0]
    g = NeighbourGraph(usable(spark, [("p", f"{i:03d}", i, m[i].tolist()) for i in range(120)], [("p", 8)]), leaf=16)
    got: dict = {}
    for r in g.neighbours(10).collect():
        got.setdefault(r["item"], {})[r["other"]] = r["similarity"]
    for i in range(40):
        assert got[f"{i:03d}"] == {f"{j:03d}": 1.0 for j in range(11) if j != i} or i > 10 and got[f"{i:03d}"] == {f"{j:03d}": 1.0 for j in range(10)}


def test_search_finds_copies(spark):
    """A query whose direction a third of the rows share gets ten of them; one of another class its true ones."""
    m = rows_of(120, 8, 5).astype(np.float32)
    m[:40] = m[0]
    g = NeighbourGraph(usable(spark, [("p", f"{i:03d}", 500 - i, m[i].tolist()) for i in range(120)], [("p", 8)]), leaf=16)
    asked = g.vectors.where(F.col("id").isin(490, 500, 400)).select(F.col("id").alias("query"), "grp", "vec")
    found: dict = {}
    for r in g.search(asked, 10).collect():
        found.setdefault(r["query"], {})[r["id"]] = r["similarity"]
    assert found[490] == found[500] == {500 - j: 1.0 for j in range(10)}
    want = {500 - int(i) for i, _ in brute([f"{i:03d}" for i in range(120)], m.astype(float), 10)["100"]}
    assert len(found[400]) == 10 and len(want & found[400].keys()) >= 8


@pytest.mark.parametrize("noise", [0.045, 0.001])
def test_recall_in_a_tight_group(spark, noise):
    """Near copies: at cosine 0.998 the gaps, at 0.999999 nothing but ties by item, decide the list."""
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(64) / 8
    m = (centre + noise / 8 * rng.standard_normal((500, 64))).astype(np.float32)
    order = rng.permutation(500)  # ids run against the order of items
    g = NeighbourGraph(usable(spark, [("p", f"{i:03d}", int(order[i]), m[i].tolist()) for i in range(500)], [("p", 64)]))
    got: dict = {}
    for r in g.neighbours(10).collect():
        got.setdefault(r["item"], set()).add(r["other"])
    want = brute([f"{i:03d}" for i in range(500)], m.astype(float), 11)
    hits = sum(len(got[i] & {o for o, _ in [x for x in best if x[0] != i][:10]}) for i, best in want.items())
    assert hits / 5000 >= 0.95


def test_none_and_one(spark):
    g = NeighbourGraph(usable(spark, [("p", "a", 1, [1.0, 2.0])], [("p", 2)]))
    assert g.neighbours(10).count() == 0
    assert NeighbourGraph(usable(spark, [], [("p", 2)])).neighbours(10).count() == 0
    with pytest.raises(ValueError):
        NeighbourGraph(usable(spark, [], [("p", 2)]), k=1)
