"""Items that appear together: a pair table kept up to date by signed deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wickerlane.sources.layered import LayeredTable, Manifest, newest
from wickerlane.workspace import materialize, release


class PairTable:
    """Counts of baskets per item and per pair of items, persistent under ``path``.

    All tables are bucketed by a hash of their key and grow by layers (see ``LayeredTable``): a batch writes its own rows
    and moves none that are held. ``items`` (item, n) and ``pairs`` (item_a < item_b, n) hold signed deltas, whose sums are
    the counts. ``members`` holds one row per basket (blocks of ``block_items`` for larger ones), of which the newest layer
    counts. Layers are folded when several have grown to half of the one below. A manifest names the layers in use and is
    replaced last, so a job that dies half way leaves the former state valid.

    ``apply`` takes rows that were added (``sign`` 1) or withdrawn (-1). Only touched baskets are compared, old against
    new; the comparison emits signed deltas of pairs and marginals. Of few touched baskets the keys are handed to the scan,
    which then skips what does not hold them. A batch with a ``number`` counts once, however often it is retried.

    ``scored`` holds the counts that association scores are made of, for the pairs in at least ``scored_from`` baskets.
    Reading scores recomputes those that batches since the last reading have affected: pairs whose count or one of whose
    marginals changed. The number of all baskets, which every score depends on, is applied on reading.

    Pairs in a basket of more than ``block_items`` items are formed by pairs of blocks, spread over tasks; none is left
    out. A basket is known by the 128-bit MD5 digest of its key columns.

    Defined cases: rows with a null in a basket column or the item do not count; an item is in a basket once however
    many rows it has there, and leaves it when its last row is withdrawn; a withdrawal without an addition waits for it;
    an empty batch changes nothing; other columns, whatever their names, are ignored. Items of any orderable type.
    """

    FEW = 1_000  # touched baskets whose keys are handed to the scan as literals

    def __init__(self, spark: SparkSession, path: str, basket: list[str], item: str, buckets: int | None = None, block_items: int = 512, scored_from: int = 1):
        if not basket or block_items < 2 or scored_from < 1:
            raise ValueError("a basket needs key columns, a block at least two items, a scored pair at least one basket")
        self.spark, self.path, self.basket, self.item, self.block_items = spark, path.rstrip("/"), basket, item, block_items
        self.manifest = Manifest(spark, self.path)
        fresh = {"buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "type": None, "baskets": 0, "applied": {}, "scored_from": scored_from}
        self.state = self.manifest.read() or fresh | {name: [] for name in ("members", "items", "pairs", "scored", "new_items", "new_pairs")}
        if self.state["scored_from"] != scored_from:
            raise ValueError(f"the table scores pairs from {self.state['scored_from']} baskets on")

    # -- storage -------------------------------------------------------------------------------------------
    def _table(self, name: str) -> LayeredTable:
        t = self.state["type"] or "string"
        pair = f"item_a {t}, item_b {t}"
        schema, by = {
            "members": (f"basket binary, parts int, part int, items array<struct<item: {t}, n: bigint, was: bigint>>", ["basket"]),
            "items": (f"item {t}, n bigint", ["item"]),
            "pairs": (f"{pair}, n bigint", ["item_a", "item_b"]),
            "scored": (f"{pair}, n_ab bigint, n_a bigint, n_b bigint", ["item_a", "item_b"]),
        }[name]
        return LayeredTable(self.spark, f"{self.path}/{name}", schema, by, self.state["buckets"])

    def _fold(self, name: str, layers: list) -> list:
        keys = self._table(name).by
        how = {
            "members": lambda rows: self._newest_members(rows),
            "items": lambda rows: self._summed(rows, keys),
            "pairs": lambda rows: self._summed(rows, keys),
            "scored": lambda rows: newest(rows, keys),
        }[name]
        return self._table(name).fold(layers, how)

    def _commit(self, **changes) -> None:
        before, state = self.state, self.state | changes
        for name in ("members", "items", "pairs", "scored"):
            state[name] = self._fold(name, state[name])
        self.manifest.write(state)
        self.state = state
        for name, more in (("members", None), ("items", "new_items"), ("pairs", "new_pairs"), ("scored", None)):
            held = [x for x in [*before[name], *changes.get(name, []), *(before[more] if more else [])]]
            used = [*state[name], *(state[more] if more else [])]
            self._table(name).drop([list(x) for x in {tuple(x) for x in held} - {tuple(x) for x in used}])

    @staticmethod
    def _summed(rows: DataFrame, keys: list[str]) -> DataFrame:
        return rows.groupBy(*keys).agg(F.sum("n").alias("n")).where(F.col("n") != 0)

    @staticmethod
    def _newest_members(rows: DataFrame) -> DataFrame:
        top = F.max("layer").over(Window.partitionBy("basket"))
        return rows.withColumn("top", top).where(F.col("top") == F.col("layer")).drop("top", "layer")

    # -- update --------------------------------------------------------------------------------------------
    def apply(self, rows: DataFrame, sign: int = 1, number: int | None = None, source: str = "") -> bool:
        """Merge a batch of added (or, with ``sign`` -1, withdrawn) rows; false if this ``number`` of the source was merged before."""
        done = self.state["applied"].get(source)
        if number is not None and done is not None and number <= done:
            return False
        names = {c: f"`{c}`" for c in [*self.basket, self.item]}
        batch = rows.select(*[F.col(names[c]).alias(f"k{i}") for i, c in enumerate(self.basket)], F.col(names[self.item]).alias("item")).dropna()
        digest = F.md5(F.concat_ws("\u0001", *[F.concat(F.length(F.col(f"k{i}").cast("string")), F.lit(":"), F.col(f"k{i}").cast("string")) for i in range(len(self.basket))]))
        batch = batch.select(F.unhex(digest).alias("basket"), "item")
        self.state["type"] = self.state["type"] or dict(batch.dtypes)["item"]
        members = self._table("members")
        zero = F.lit(0).cast("bigint")
        scratch = None
        if self.state["members"]:
            batch = scratch = materialize(batch, "pair-batch")
        flow = batch.select("basket", "item", F.lit(sign).cast("bigint").alias("d"), zero.alias("was"))
        if self.state["members"]:
            held, touched = members.read(self.state["members"]), batch.select("basket").distinct()
            few = touched.limit(self.FEW + 1).collect()
            if len(few) <= self.FEW:
                held = held.where(f"basket IN ({', '.join(f"X'{bytes(r[0]).hex()}'" for r in few) or 'NULL'})")
            else:
                held = held.join(touched, "basket", "left_semi")
            flow = flow.unionByName(self._newest_members(held).select("basket", F.inline("items")).select("basket", "item", zero.alias("d"), F.col("n").alias("was")))
        # Rows are combined first: a basket that holds a third of all rows then has at most one per item. The second
        # exchange is by basket; sizing, gathering and writing below keep it.
        flow = flow.groupBy("basket", "item").agg(F.sum("was").alias("was"), F.sum("d").alias("d")).repartition(self.state["buckets"], "basket")
        flow = flow.withColumn("parts", F.ceil(F.count(F.lit(1)).over(Window.partitionBy("basket")) / self.block_items).cast("int"))
        flow = flow.groupBy("basket", "parts", F.pmod(F.hash("item"), F.col("parts")).alias("part")).agg(
            F.array_sort(F.collect_list(F.struct("item", (F.col("was") + F.col("d")).alias("n"), "was"))).alias("items")
        )
        layer = members.write(flow, placed=True)
        if scratch is not None:
            release(scratch)
        applied = self.state["applied"] | ({} if number is None else {source: number})
        if not layer[1]:
            members.drop([layer])
            self._commit(applied=applied)
            return True
        now = members.read([layer]).drop("layer")
        items, pairs = self._table("items").write(self._item_deltas(now), placed=True), self._table("pairs").write(self._pair_deltas(now), placed=True)
        self._commit(
            applied=applied, baskets=self.state["baskets"] + self._basket_delta(now), members=[*self.state["members"], layer], items=[*self.state["items"], items],
            pairs=[*self.state["pairs"], pairs], new_items=[*self.state["new_items"], items], new_pairs=[*self.state["new_pairs"], pairs],
        )
        return True

    @staticmethod
    def _basket_delta(now: DataFrame) -> int:
        there = lambda c: F.exists("items", lambda x: x[c] > 0).cast("int")
        flags = now.select("basket", "parts", there("n").alias("n"), there("was").alias("was"))
        large = flags.where("parts > 1").groupBy("basket").agg(F.max("n").alias("n"), F.max("was").alias("was"))
        total = flags.where("parts = 1").select("n", "was").unionByName(large.select("n", "was")).agg(F.sum(F.col("n") - F.col("was")))
        return total.first()[0] or 0

    @staticmethod
    def _item_deltas(now: DataFrame) -> DataFrame:
        change = (F.col("n") > 0).cast("bigint") - (F.col("was") > 0).cast("bigint")
        return now.select(F.inline("items")).groupBy("item").agg(F.sum(change).alias("n")).where(F.col("n") != 0)

    @staticmethod
    def _pair_deltas(now: DataFrame) -> DataFrame:
        changed = now.withColumn("changed", F.exists("items", lambda x: (x["n"] > 0) != (x["was"] > 0)))
        both = lambda c: ((F.col(f"x.{c}") > 0) & (F.col(f"y.{c}") > 0)).cast("bigint")
        # Within a block: each item with those after it.
        inner = changed.where("changed").select("items", F.posexplode("items").alias("i", "x"))
        inner = inner.select("x", F.explode(F.expr("slice(items, i + 2, size(items))")).alias("y"))
        # Across the blocks of a large basket: block pair (p, q) gathers exactly two bounded arrays.
        large = changed.where("parts > 1").select(
            "basket", "part", "items", "changed", F.explode(F.expr("transform(sequence(0, parts - 1), q -> struct(least(part, q) AS p, greatest(part, q) AS q))")).alias("pq")
        )
        met = large.where("pq.p <> pq.q").groupBy("basket", "pq").agg(
            F.max("changed").alias("changed"), F.max(F.when(F.col("part") == F.col("pq.p"), F.col("items"))).alias("left"), F.max(F.when(F.col("part") == F.col("pq.q"), F.col("items"))).alias("right")
        )
        outer = met.where("changed").select("right", F.explode("left").alias("x")).select("x", F.explode("right").alias("y"))
        every = inner.unionByName(outer).select(
            F.least("x.item", "y.item").alias("item_a"), F.greatest("x.item", "y.item").alias("item_b"), (both("n") - both("was")).alias("n")
        )
        return every.where(F.col("n") != 0).groupBy("item_a", "item_b").agg(F.sum("n").alias("n")).where(F.col("n") != 0)

    def rescore(self) -> None:
        """Recompute what the batches since the last call have affected."""
        s = self.state
        if not (s["new_items"] or s["new_pairs"]):
            return
        base = self.pairs().where(F.col("n") >= s["scored_from"]).withColumnRenamed("n", "n_ab")
        if not s["scored"]:
            rows = self._with_marginals(base, self.items())
        else:
            flag = F.lit(True)
            items = self.items().join(self._table("items").read(s["new_items"]).select("item").distinct().withColumn("moved", flag), "item", "left")
            moved = self._table("pairs").read(s["new_pairs"]).select("item_a", "item_b").distinct()
            marked = base.join(moved.withColumn("moved", flag), ["item_a", "item_b"], "left")
            rows = self._with_marginals(marked, items).where("moved OR moved_a OR moved_b")
            gone = moved.join(base, ["item_a", "item_b"], "left_anti")  # fell below the threshold
            rows = rows.select("item_a", "item_b", "n_ab", "n_a", "n_b").unionByName(gone.select("item_a", "item_b", *[F.lit(0).cast("bigint").alias(c) for c in ("n_ab", "n_a", "n_b")]))
        self._commit(scored=[*s["scored"], self._table("scored").write(rows)], new_items=[], new_pairs=[])

    @staticmethod
    def _with_marginals(pairs: DataFrame, items: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(items.select([F.col(c).alias({"item": f"item_{side}"}.get(c, f"{c}_{side}")) for c in items.columns]), f"item_{side}")
        return pairs

    # -- reading -------------------------------------------------------------------------------------------
    @property
    def baskets(self) -> int:
        return self.state["baskets"]

    def _counts(self, name: str) -> DataFrame:
        return self._summed(self._table(name).read(self.state[name]), self._table(name).by)

    def items(self) -> DataFrame:
        return self._counts("items")

    def pairs(self) -> DataFrame:
        return self._counts("pairs")

    def scores(self, min_count: int | None = None) -> DataFrame:
        """``item_a, item_b, n_ab, n_a, n_b, lift, pmi`` of the pairs in at least ``min_count`` (by default ``scored_from``) baskets.

        Lift is n_ab * N / (n_a * n_b): how many times oftener than chance.
        """
        least = self.state["scored_from"] if min_count is None else min_count
        if least < self.state["scored_from"]:
            raise ValueError(f"the table scores pairs from {self.state['scored_from']} baskets on")
        self.rescore()
        held = newest(self._table("scored").read(self.state["scored"]), ["item_a", "item_b"]).where(F.col("n_ab") >= least)
        lift = F.col("n_ab") * F.lit(float(self.baskets)) / (F.col("n_a").cast("double") * F.col("n_b"))
        return held.select("item_a", "item_b", "n_ab", "n_a", "n_b", lift.alias("lift"), F.log2(lift).alias("pmi"))
