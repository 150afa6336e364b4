"""Filling containers of fixed capacity by hierarchical residual packing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickerlane.workspace import materialize


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin of each size, and the fill of each bin, by best fit in the order given (largest first packs best).

    Open bins lie in a list per residual; a bit set of the residuals that are there finds the tightest in one step.
    """
    bins: list[int] = []
    by_room: dict[int, list[int]] = {}
    rooms, where = 0, []
    for s in sizes:
        fitting = rooms >> s
        if fitting:
            room = s + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(bins)
            bins.append(0)
        bins[b] += s
        where.append(b)
        left = room - s
        by_room.setdefault(left, []).append(b)
        rooms |= 1 << left
    return where, bins


def _pack(level: int, columns: list[str]):
    """Best fit of one task's items, largest first; ``tie`` numbers its containers of the same fill."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", *[c for c in columns if c != "size"]], ascending=[False, *[True] * (len(columns) - 1)], kind="stable")
        where, fills = best_fit(pdf["size"].tolist(), int(pdf["capacity"].iloc[0]))
        seen: dict[int, int] = {}
        ties = []
        for f in fills:
            ties.append(seen.get(f, 0))
            seen[f] = ties[-1] + 1
        head = f"{level}.{int(pdf['part'].iloc[0])}."
        out = pdf[["kind", "capacity", *columns]].reset_index(drop=True)
        return out.assign(bin=[f"{head}{w}" for w in where], used=[fills[w] for w in where], tie=[ties[w] for w in where])

    return run


def _carried(bins: DataFrame, caps: dict[str, int]) -> DataFrame:
    """Of a round's containers those that may still be put together: none that could help is left out.

    No two containers over half full fit together, so each merger takes at least one that is not: such small ones number
    at most one a task after best fit. All of them go on, and with them as many of the larger ones, the emptiest first, as
    there are small ones (no merger can use more), if they have room for the smallest.
    """
    hist = bins.groupBy("kind", "used").agg(F.count(F.lit(1)).alias("n")).collect()  # at most capacity + 1 rows per kind
    keep = F.lit(False)
    for kind, cap in caps.items():
        mine = sorted((r["used"], r["n"]) for r in hist if r["kind"] == kind)
        small = sum(n for u, n in mine if 2 * u <= cap)
        if not small:
            continue
        least, need, level, left = mine[0][0], small, None, 0
        for u, n in mine:
            if 2 * u > cap and need > 0:
                level, left, need = u, need, need - n
        here = 2 * F.col("used") <= cap
        if level is not None:
            here = here | (F.col("used") < level)
            if need >= 0:
                here = here | (F.col("used") == level)
            else:  # of the last fill only as many as are needed, the same number of each task
                per = bins.where((F.col("kind") == kind) & (F.col("used") == level)).groupBy("tie").agg(F.count(F.lit(1)).alias("n")).collect()  # at most one row per item of a task
                for tie, n in sorted((r["tie"], r["n"]) for r in per):
                    left -= n
                    if left <= 0:
                        break
                here = here | ((F.col("used") == level) & (F.col("tie") <= tie))
        keep = keep | ((F.col("kind") == kind) & here & (F.col("used") + least <= cap))
    return bins.where(keep)


def pack(items: DataFrame, item_id: str, size: str, containers: DataFrame, task_items: int = 8192) -> DataFrame:
    """``kind, container, <item_id>, piece, size`` for items packed into each of the container sizes.

    ``containers`` has ``kind`` and ``capacity``, a few rows. An item larger than the capacity is cut into full pieces, each of
    which is a container of its own, and a remainder; no other item is cut.

    Round 0 spreads the pieces over tasks by a hash and packs each task's share by best fit, largest first. Containers
    that nothing can be added to any more are done; the others (see ``_carried``: at most three for each task of the
    round, so thousands of times fewer) go on as items of the size they hold, to ever fewer tasks, and are packed
    again, until one task held them all or no two fit together. So no task holds more than about ``task_items``, and only
    the mapping of carried containers is joined to the items, once.

    Defined cases: a null or negative size counts as 0; items of size 0 are placed like any other; a null id is kept; repeated
    ids are separate items; ties go by id; an empty table gives an empty result; capacities must be positive; other
    columns are ignored.
    """
    if task_items < 8:
        raise ValueError("task_items must be at least 8")
    caps = {r["kind"]: int(r["capacity"]) for r in containers.select("kind", "capacity").collect()}
    if any(c < 1 for c in caps.values()):
        raise ValueError("capacities must be positive")
    spark = items.sparkSession
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(c).cast("bigint").alias("capacity")) for k, c in caps.items()])
    own = items.select(F.col(f"`{item_id}`").alias("id"), F.greatest(F.coalesce(F.col(f"`{size}`").cast("bigint"), F.lit(0)), F.lit(0)).alias("whole"))
    own = materialize(own.withColumn("row", F.monotonically_increasing_id()), "packing-items")  # spreads repeated ids
    cut = own.select("row", "id", "whole", F.explode(kinds).alias("k")).select("row", "id", "whole", "k.*")
    # Pieces that fill a container are written out, the remainder goes on.
    whole, rest = F.expr("whole div capacity"), F.expr("whole % capacity")
    full = cut.where(F.col("whole") >= F.col("capacity")).select("kind", "row", "id", F.explode(F.sequence(F.lit(0).cast("bigint"), whole - 1)).alias("piece"), F.col("capacity").alias("size"))
    full = full.withColumn("container", F.concat_ws(".", F.lit("full"), "row", "piece"))
    loose = cut.where((rest > 0) | (F.col("whole") == 0)).select("kind", "capacity", "row", "id", whole.alias("piece"), rest.alias("size"))

    counts = {r["kind"]: r["n"] for r in loose.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    current, columns, chain, placed, level = loose, ["id", "piece", "size"], None, None, 0
    while counts:
        parts = {k: -(-n // task_items) for k, n in counts.items()}
        spread = F.create_map(*[x for k, n in parts.items() for x in (F.lit(k), F.lit(n))])[F.col("kind")]
        chosen = current.withColumn("part", F.pmod(F.xxhash64("row" if level == 0 else "node", F.lit(level)), spread))
        types = dict(current.dtypes)
        schema = ", ".join(f"`{c}` {types[c]}" for c in ["kind", "capacity", *columns]) + ", bin string, used bigint, tie bigint"
        out = materialize(chosen.groupBy("kind", "part").applyInPandas(_pack(level, columns), schema), "packing-round")
        if level == 0:
            placed = out.select("kind", "id", "piece", "size", "bin")
        else:
            step = out.select("kind", F.col("node").alias("bin"), F.col("bin").alias("next"))
            chain = step if chain is None else chain.withColumnRenamed("next", "now").join(step.withColumnsRenamed({"bin": "now", "next": "later"}), ["kind", "now"], "left").select("kind", "bin", F.coalesce("later", "now").alias("next"))
        open_ = {k for k, n in parts.items() if n > 1}
        if not open_:
            break
        bins = out.where(F.col("kind").isin(list(open_))).select("kind", "capacity", "bin", "used", "tie").distinct()
        carried = materialize(_carried(bins, {k: c for k, c in caps.items() if k in open_}), "packing-carried")
        current, columns = carried.select("kind", "capacity", F.col("bin").alias("node"), F.col("used").alias("size")), ["node", "size"]
        counts = {r["kind"]: r["n"] for r in current.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect() if r["n"] > 1}
        current, level = current.where(F.col("kind").isin(list(counts))), level + 1
    names = ["kind", F.col("container"), F.col("id").alias(item_id), "piece", "size"]
    if placed is None:
        return full.select(*names)
    if chain is not None:
        placed = placed.join(chain, ["kind", "bin"], "left").withColumn("bin", F.coalesce("next", "bin"))
    return full.select(*names).unionByName(placed.withColumnRenamed("bin", "container").select(*names))
