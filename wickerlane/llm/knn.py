"""Most similar vectors for every vector: a neighbour graph by NN-descent, searched greedily."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wickerlane.workspace import materialize, release

TABLES = 8
EDGE = "id bigint, nbr bigint, sim double, fresh boolean"


# -- arrays in Arrow batches -----------------------------------------------------------------------------------
def _by_key(batches: Iterator[pa.RecordBatch], more: tuple[str, ...] = ()) -> Iterator[tuple[int, dict[str, list]]]:
    """The rows of one key (and of one value of the columns ``more``) after the other, from batches sorted by them."""
    key, held = None, {}
    for b in batches:
        if not b.num_rows:
            continue
        cols = {n: b.column(n) for n in b.schema.names}
        keys = np.stack([cols.pop(n).to_numpy(zero_copy_only=False) for n in ("key", *more)])
        cuts = np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1
        lists = {n: c.to_pylist() if n == "raw" else c.to_numpy(zero_copy_only=False) for n, c in cols.items()}
        for a, z in zip(np.r_[0, cuts], np.r_[cuts, keys.shape[1]]):
            part = {n: v[a:z] for n, v in lists.items()}
            if key == tuple(keys[:, a]) and held:
                held = {n: held[n] + part[n] if isinstance(part[n], list) else np.concatenate([held[n], part[n]]) for n in held}
                continue
            if held:
                yield key[0], held
            key, held = tuple(keys[:, a]), part
    if held:
        yield key[0], held


def _packed(v: np.ndarray) -> bytes:
    """A vector as bytes: single precision where that loses nothing, told by the first byte."""
    single = v.astype(np.float32)
    return b"f" + single.tobytes() if np.array_equal(single.astype(np.float64), v) else b"d" + v.tobytes()


def _unit_rows(raw: list[bytes]) -> np.ndarray:
    """Unit vectors in double precision from their bytes."""
    if len({(len(r), r[:1]) for r in raw}) == 1:
        m = np.frombuffer(b"".join(raw), dtype=np.uint8).reshape(len(raw), -1)[:, 1:].copy().view(np.float32 if raw[0][:1] == b"f" else np.float64).astype(np.float64)
    else:
        m = np.array([np.frombuffer(r[1:], dtype=np.float32 if r[:1] == b"f" else np.float64).astype(np.float64) for r in raw])
    m /= np.abs(m).max(axis=1, keepdims=True)
    m /= np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m


def _cosines(raw: list[bytes]) -> np.ndarray:
    """All cosines among the vectors, as results give them: to 6 decimals."""
    m = _unit_rows(raw)
    return np.round(m @ m.T, 6)


class _Edges:
    """Directed edges, gathered and handed out in batches of bounded size, of each node's the ``k`` best."""

    def __init__(self, k: int, rows: int = 1_000_000):
        self.parts, self.n, self.k, self.rows = [], 0, k, rows

    def add(self, ids: np.ndarray, nbrs: np.ndarray, sims: np.ndarray) -> None:
        self.parts.append((ids, nbrs, sims))
        self.n += len(ids)

    def flush(self, force: bool = False) -> Iterator[pa.RecordBatch]:
        if self.n and (force or self.n >= self.rows):
            i, n, s = (np.concatenate(x) for x in zip(*self.parts))
            self.parts, self.n = [], 0
            o = np.lexsort((n, -s, i))
            i, n, s = i[o], n[o], s[o]
            new = np.r_[True, (i[1:] != i[:-1]) | (n[1:] != n[:-1])]
            i, n, s = i[new], n[new], s[new]
            start = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
            near = np.arange(len(i)) - np.repeat(start, np.diff(np.r_[start, len(i)])) < self.k
            i, n, s = i[near], n[near], s[near]
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(n, pa.int64()), pa.array(s), pa.array(np.ones(len(i), bool))], names=["id", "nbr", "sim", "fresh"])


def _leaf_edges(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Edges(k)
        for _, rows in _by_key(batches):
            n = len(rows["id"])
            if n < 2:
                continue
            s = _cosines(rows["raw"])
            np.fill_diagonal(s, -np.inf)
            top = np.argpartition(-s, min(k, n - 1) - 1, axis=1)[:, : min(k, n - 1)]
            a = np.repeat(np.arange(n), top.shape[1])
            b = top.ravel()
            out.add(rows["id"][a], rows["id"][b], s[a, b])
            yield from out.flush()
        yield from out.flush(True)

    return run


def _local_join(k: int) -> Callable:
    """In each node's list, compare fresh members with all others; keep what beats a member's present worst neighbour.

    Lists come by cell, behind the vectors of all their members (``kind`` 0), each of which is sent to a cell once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Edges(k)
        for _, rows in _by_key(batches):
            n = int((rows["kind"] == 0).sum())
            order = np.argsort(rows["id"][:n])
            known, worst, last = rows["id"][:n][order], rows["worst"][:n][order], rows["last"][:n][order]
            unit = _unit_rows([rows["raw"][i] for i in order])
            node, member, fresh = rows["node"][n:], np.searchsorted(known, rows["id"][n:]), rows["fresh"][n:].astype(bool)
            cuts = np.flatnonzero(np.diff(node)) + 1
            for a, z in zip(np.r_[0, cuts], np.r_[cuts, len(node)]):
                at, new = member[a:z], fresh[a:z]
                if z - a < 2 or not new.any():
                    continue
                s = np.round(unit[at] @ unit[at].T, 6)
                w, ids = worst[at][:, None], known[at]
                allowed = (s > w) | (s == w) & (ids[None, :] < last[at][:, None])
                if not new.all():
                    allowed &= new[:, None] | new[None, :]
                np.fill_diagonal(allowed, False)
                x, y = np.nonzero(allowed)
                out.add(ids[x], ids[y], s[x, y])
            yield from out.flush()
        yield from out.flush(True)

    return run


def _encode(bits: dict[str, int], seed: int) -> Callable:
    """Bytes, direction key and hash signatures of each vector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for pdf in batches:
            keys, signs, raws = [], [], []
            for g, v in zip(pdf["grp"], pdf["vec"]):
                u = np.asarray(v, dtype=np.float64)
                raws.append(_packed(u))
                u = u / np.abs(u).max()  # so that the norm can neither overflow nor vanish
                u = u / np.sqrt((u * u).sum())
                keys.append(np.round(u, 6).__add__(0.0).astype(np.float32).tobytes())
                b = bits.get(g, 1)
                if (len(u), b) not in planes:
                    planes[len(u), b] = np.random.default_rng(seed + len(u)).standard_normal((TABLES * b, len(u)))
                s = (planes[len(u), b] @ u > 0).reshape(TABLES, b)
                signs.append((s * (1 << np.arange(b))).sum(axis=1).tolist())
            yield pd.DataFrame({"grp": pdf["grp"], "item": pdf["item"], "id": pdf["id"], "direction": keys, "signs": signs, "raw": raws})

    return run


class NeighbourGraph:
    """A k-nearest-neighbour graph per group, built by NN-descent.

    ``vectors`` are rows as ``usable_vectors`` gives them, ``id`` unique. Vectors of the same direction (to 6 decimals) form
    a class; the graph links one representative per class, and results are expanded to members again, so that copies,
    however many, neither crowd a list nor a task.

    Start: in each of ``TABLES`` random-hyperplane tables, vectors of the same signature (in chunks of ``leaf``) are
    compared among themselves. Then each round joins every node's neighbours, forward and (sampled) reverse, with one
    another: neighbours of neighbours. Only pairs with a fresh member are compared, and only what beats a node's worst
    neighbour is sent on. Rounds work by cells, the chunks of the first table: nodes of a cell share most of their
    neighbours, so a vector travels once to a cell and not once to each list, and a pair met in several lists is sent on
    once. It ends after ``rounds`` rounds, or when a round changes less than ``settle`` of the edges.

    Edges are compared and kept as results are ranked: by cosines in double precision to 6 decimals, ties by item, for
    which vectors are numbered in the order of their items. A shorter code would lose the true neighbours in a tight
    group, whose gaps are smaller than its noise. ``k`` should be about twice what is asked for.
    """

    def __init__(self, vectors: DataFrame, k: int = 24, sample: int = 12, leaf: int = 160, rounds: int = 6, settle: float = 0.02, seed: int = 17):
        if k < 2 or sample < 1 or leaf < 2:
            raise ValueError("k and leaf must be at least 2, sample positive")
        self.k, self.sample, self.leaf, self.rounds, self.settle, self.seed = k, sample, leaf, rounds, settle, seed
        self.vectors = materialize(vectors.select("grp", "item", "id", "vec"), "knn-vectors")
        sizes = {r["grp"]: r["n"] for r in self.vectors.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per group of the index
        self.bits = {g: max(1, int(np.ceil(np.log2(max(2, n) / (leaf / 2))))) for g, n in sizes.items()}
        kind = dict(self.vectors.dtypes)
        # From here on ``id`` is the number of a vector in the order of items; ``members`` has the id given as ``given``.
        order = self.vectors.select("item", F.col("id").alias("given")).orderBy("item", "given")
        numbered = materialize(order.withColumn("id", F.monotonically_increasing_id()).select("id", "given"), "knn-numbered")
        coded = self.vectors.withColumnRenamed("id", "given").join(numbered, "given").select("grp", "item", "id", "vec").mapInPandas(_encode(self.bits, seed), f"grp {kind['grp']}, item {kind['item']}, id bigint, direction binary, signs array<bigint>, raw binary")
        self.coded = materialize(coded, "knn-codes")
        first = self.coded.groupBy("grp", "direction").agg(F.min("id").alias("rep"))
        members = self.coded.select("grp", "item", "id", "direction").join(first, ["grp", "direction"]).join(numbered.select("id", "given"), "id")
        self.members = materialize(members.select("grp", "item", "id", "given", "rep"), "knn-members")
        nodes = self.coded.join(self.members.where("id = rep").select("id"), "id", "left_semi").select("grp", "id", "raw", "signs", F.col("signs")[0].alias("sign"))
        sizes = nodes.groupBy("grp", "sign").agg(F.count(F.lit(1)).alias("n"))
        cell = F.xxhash64("grp", "sign", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / leaf)))
        self.nodes = materialize(nodes.join(sizes, ["grp", "sign"]).select("grp", "id", "raw", "signs", cell.alias("cell")), "knn-nodes")
        self.edges = self._descend()

    # -- building ------------------------------------------------------------------------------------------
    def _leaves(self) -> DataFrame:
        tabled = self.nodes.select("grp", "id", F.posexplode("signs").alias("tab", "sign"))
        sizes = tabled.groupBy("grp", "tab", "sign").agg(F.count(F.lit(1)).alias("n"))
        chunked = tabled.join(sizes, ["grp", "tab", "sign"]).withColumn("chunk", F.pmod(F.xxhash64("id", "tab"), F.ceil(F.col("n") / self.leaf)))
        # The vectors join last, so that they move once a table.
        keyed = chunked.select("id", F.xxhash64("grp", "tab", "sign", "chunk").alias("key")).join(self.nodes.select("id", "raw"), "id")
        return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_leaf_edges(max(2, self.k // 2)), EDGE)

    def _best(self, edges: DataFrame) -> DataFrame:
        one = edges.groupBy("id", "nbr").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
        rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "nbr"))
        return one.withColumn("r", rank).where(F.col("r") <= self.k)

    def _round(self, graph: DataFrame) -> DataFrame:
        """Candidate edges of one round over ``graph`` (id, nbr, sim, fresh, r)."""
        fwd = graph.select(F.col("id").alias("node"), F.col("nbr").alias("id"), "fresh", F.lit(0).alias("back"), F.col("r").cast("bigint").alias("o"))
        back = graph.select(F.col("nbr").alias("node"), "id", "fresh", F.lit(1).alias("back"), F.xxhash64("id", "nbr").alias("o"))
        # One exchange by node serves all of the following.
        lists = fwd.unionByName(back).repartition("node")
        pick = F.row_number().over(Window.partitionBy("node", "back", "fresh").orderBy("o"))
        lists = lists.withColumn("p", pick).where(F.col("p") <= self.sample).groupBy("node", "id").agg(F.max("fresh").alias("fresh"))
        lists = lists.withColumn("busy", F.max("fresh").over(Window.partitionBy("node"))).where("busy")
        cells = self.nodes.select(F.col("id").alias("node"), "cell")
        lists = materialize(lists.join(cells, "node").select("cell", "node", "id", "fresh"), "knn-lists")
        full = lambda c, other: F.coalesce(F.max(F.when(F.col("r") == self.k, F.col(c))), F.lit(other))
        worst = graph.groupBy("id").agg(full("sim", -2.0).alias("worst"), full("nbr", 0).cast("bigint").alias("last"))
        sent = lists.select("cell", "id").repartition("id").distinct().join(self.nodes.select("id", "raw"), "id").join(worst, "id", "left").fillna({"worst": -2.0, "last": 0})
        none = lambda t: F.lit(None).cast(t)
        vectors = sent.select(F.col("cell").alias("key"), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("node"), "id", F.lit(False).alias("fresh"), "worst", "last", "raw")
        entries = lists.select(F.col("cell").alias("key"), F.lit(1).alias("kind"), "node", "id", "fresh", F.lit(0.0).alias("worst"), F.lit(0).cast("bigint").alias("last"), none("binary").alias("raw"))
        rows = vectors.unionByName(entries).repartition("key").sortWithinPartitions("key", "kind", "node")
        return rows.mapInArrow(_local_join(self.k), EDGE)

    def _descend(self) -> DataFrame:
        graph = materialize(self._best(self._leaves()), "knn-graph")
        for _ in range(self.rounds):
            # Sampled fresh edges turn old by being joined; the candidates come in as fresh ones.
            old = graph.withColumn("fresh", F.col("fresh") & (F.col("r") > self.sample))
            after = materialize(self._best(old.select("id", "nbr", "sim", "fresh").unionByName(self._round(graph))), "knn-graph")
            release(graph)
            graph = after
            moved = graph.agg(F.avg((F.col("fresh") & (F.col("r") <= self.sample)).cast("int"))).first()[0]
            if not moved or moved < self.settle:
                break
        return graph.select("id", "nbr", "sim", "r")

    # -- results -------------------------------------------------------------------------------------------
    def _shown(self, k: int) -> DataFrame:
        """Per class the ``k + 1`` members that come first by item: no list of ``k`` can hold others."""
        rank = F.row_number().over(Window.partitionBy("rep").orderBy("item"))
        return self.members.withColumn("p", rank).where(F.col("p") <= k + 1).select("rep", F.col("id").alias("other"))

    def exact(self, pairs: DataFrame, most: int = 4_096) -> DataFrame:
        """``a, b, similarity`` of pairs of ids, as cosines in double precision rounded to 6 decimals.

        The pairs of an ``a`` are split into as many parts as they have ``most`` rows, so that a vector in many pairs is no
        single task or buffer.
        """
        vec = self.coded.select(F.col("id").alias("b"), "raw")
        once = pairs.select("a", "b").distinct().withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("a")))
        once = once.select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / most)).cast("int").alias("part"))
        rows = once.join(vec, "b").select("a", "part", F.col("b"), F.lit(1).alias("place"), "raw")
        own = once.select("a", "part").distinct().withColumn("b", F.col("a")).join(vec, "b").select("a", "part", F.col("b"), F.lit(0).alias("place"), "raw")
        both = rows.unionByName(own).repartition("a", "part").sortWithinPartitions("a", "part", "place")
        return both.select(F.col("a").alias("key"), "part", "b", "place", "raw").mapInArrow(_exact, "a bigint, b bigint, similarity double")

    def neighbours(self, k: int = 10) -> DataFrame:
        """``grp, item, other, similarity, rank``: the ``k`` most similar other items of each item, ties by item."""
        # Edges carry exact similarities of representatives, and a class has at least one member to show, so none beyond
        # the k-th can matter. Only pairs with another member of a class are compared here.
        edges = self.edges.where(F.col("r") <= k)
        direct = edges.select("id", F.col("nbr").alias("other_id"), F.col("sim").alias("similarity"))
        near = edges.select(F.col("id").alias("rep"), F.col("nbr").alias("near"))
        near = near.unionByName(self.members.select("rep", F.col("rep").alias("near")).distinct())
        several = self.members.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rep", F.lit(True).alias("several"))
        near = near.join(several, "rep", "left").join(several.select(F.col("rep").alias("near"), F.col("several").alias("several_near")), "near", "left").where("several OR several_near")
        pairs = self.members.select("id", "rep").join(near, "rep").join(self._shown(k).withColumnRenamed("rep", "near"), "near").where("id <> other AND (id <> rep OR other <> near)")
        sims = self.exact(pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")))
        both = sims.select(F.col("a").alias("id"), F.col("b").alias("other_id"), "similarity").unionByName(sims.select(F.col("b").alias("id"), F.col("a").alias("other_id"), "similarity"))
        both = both.unionByName(direct)
        name = self.members.select("grp", "item", "id")
        named = both.join(name, "id").join(name.select(F.col("id").alias("other_id"), F.col("item").alias("other")), "other_id")
        rank = F.row_number().over(Window.partitionBy("grp", "item").orderBy(F.desc("similarity"), "other"))
        return named.withColumn("rank", rank).where(F.col("rank") <= k).select("grp", "item", "other", "similarity", "rank")

    def search(self, queries: DataFrame, k: int = 10, beam: int = 32, rounds: int = 8, entries: int = 6) -> DataFrame:
        """``query, id, similarity, rank``: the ``k`` most similar vectors, ties by item, by greedy search of the graph.

        ``queries`` have ``query`` (unique), ``grp`` and ``vec``. A search enters at up to ``entries`` nodes that share a
        signature in each table, then in each round expands the unexpanded nodes of its beam to their neighbours and
        keeps the best ``beam`` (at least ``k``); it ends when no beam changes, or after ``rounds``. The classes of the last
        beam are expanded to their members. A query vector is not left out of its own result. Queries of unknown groups give nothing.
        """
        beam = max(beam, k)
        shaped = queries.select("grp", F.col("query").cast("string").alias("item"), F.xxhash64(F.col("query").cast("string")).alias("id"), "vec")
        keyed = queries.select(F.xxhash64(F.col("query").cast("string")).alias("q"), "query")
        kind = dict(shaped.dtypes)
        coded = shaped.mapInPandas(_encode(self.bits, self.seed), f"grp {kind['grp']}, item string, id bigint, direction binary, signs array<bigint>, raw binary")
        coded = materialize(coded.select("grp", F.col("id").alias("q"), "signs", "raw"), "knn-queries")
        tabled = self.nodes.select("grp", "id", F.posexplode("signs").alias("tab", "sign"))
        doors = tabled.withColumn("p", F.row_number().over(Window.partitionBy("grp", "tab", "sign").orderBy(F.xxhash64("id")))).where(F.col("p") <= entries)
        flips = F.expr("concat(array(sign), transform(sequence(0, 3), i -> sign ^ shiftleft(1L, i)))")
        probes = coded.select("grp", "q", F.posexplode("signs").alias("tab", "sign")).select("grp", "q", "tab", F.explode(flips).alias("sign"))
        start = probes.join(doors, ["grp", "tab", "sign"]).select("q", "id").distinct()
        beamed = materialize(self._score(start, coded, beam, None), "knn-beam")
        for _ in range(rounds):
            step = beamed.where("NOT done").join(self.edges.select("id", "nbr"), "id").select("q", F.col("nbr").alias("id")).distinct()
            step = step.join(beamed.select("q", "id"), ["q", "id"], "left_anti")
            beamed = materialize(self._score(step, coded, beam, beamed.withColumn("done", F.lit(True))), "knn-beam")
            if beamed.where("NOT done").limit(1).count() == 0:
                break
        met = beamed.select("q", F.col("id").alias("rep")).join(self._shown(k), "rep").select("q", F.col("other").alias("id"))
        sims = self._exact_queries(met, coded)
        last = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("similarity"), "id"))
        return sims.withColumn("rank", last).where(F.col("rank") <= k).join(keyed, "q").join(self.members.select("id", "given"), "id").select("query", F.col("given").alias("id"), "similarity", "rank")

    def _score(self, pairs: DataFrame, coded: DataFrame, beam: int, held: DataFrame | None) -> DataFrame:
        rows = pairs.join(self.nodes.select("id", "raw"), "id").join(coded.select("q", F.col("raw").alias("own")), "q")
        scored = rows.mapInArrow(_score_pairs, "q bigint, id bigint, sim double").withColumn("done", F.lit(False))
        if held is not None:
            scored = scored.unionByName(held)
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "id"))
        return scored.withColumn("p", rank).where(F.col("p") <= beam).drop("p")

    def _exact_queries(self, pairs: DataFrame, coded: DataFrame) -> DataFrame:
        rows = pairs.join(self.coded.select("id", "raw"), "id").select(F.col("q").alias("key"), F.lit(0).alias("part"), F.col("id").alias("b"), F.lit(1).alias("place"), "raw")
        own = coded.select(F.col("q").alias("key"), F.lit(0).alias("part"), F.col("q").alias("b"), F.lit(0).alias("place"), "raw")
        sims = rows.unionByName(own).repartition("key").sortWithinPartitions("key", "place").mapInArrow(_exact, "a bigint, b bigint, similarity double")
        return sims.select(F.col("a").alias("q"), F.col("b").alias("id"), "similarity")


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cosines of each key's own vector (``place`` 0, sorted first) with the others."""
    out_a, out_b, out_s, n = [], [], [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_a, out_b, out_s)], names=["a", "b", "similarity"])

    for key, rows in _by_key(batches, ("part",)):
        b = rows["b"]
        if rows["place"][0] or len(b) < 2:
            continue
        m = _unit_rows(rows["raw"])
        out_a.append(np.full(len(b) - 1, key, dtype=np.int64))
        out_b.append(b[1:])
        out_s.append(np.round(m[1:] @ m[0], 6) + 0.0)
        n += len(b)
        if n > 100_000:
            yield batch()
            out_a, out_b, out_s, n = [], [], [], 0
    if n:
        yield batch()


def _score_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw, own = b.column("raw").to_pylist(), b.column("own").to_pylist()
        sims = np.empty(len(raw))
        sizes = np.array([(len(r) - 1) // (4 if r[:1] == b"f" else 8) for r in raw])
        for n in np.unique(sizes):
            at = np.flatnonzero(sizes == n)
            sims[at] = (_unit_rows([raw[i] for i in at]) * _unit_rows([own[i] for i in at])).sum(axis=1)
        yield pa.RecordBatch.from_arrays([b.column("q"), b.column("id"), pa.array(np.round(sims, 6))], names=["q", "id", "sim"])
