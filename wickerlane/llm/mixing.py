"""Mixing sources to target weights, interleaved by Pfair scheduling."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wickerlane.workspace import materialize


def reachable(total: float, targets: dict[str, float], most: dict[str, float]) -> dict[str, float]:
    """Tokens per source for a total: in proportion to the targets, sources that run out giving all they have."""
    got = {s: 0.0 for s in targets}
    open_, left = {s for s in targets if targets[s] > 0 and most[s] > 0}, total
    while open_ and left > 1e-9:
        weight = sum(targets[s] for s in open_)
        short = {s for s in open_ if targets[s] / weight * left >= most[s]}
        if not short:
            got |= {s: targets[s] / weight * left for s in open_}
            break
        for s in short:
            got[s] = float(most[s])
            left -= most[s]
        open_ -= short
    return got


def stray(got: dict[str, float], targets: dict[str, float]) -> float:
    """Half the summed distance of the shares from their targets."""
    total = sum(got.values())
    return sum(abs(got[s] / total - targets[s]) for s in targets) / 2 if total else 1.0


def best_total(targets: dict[str, float], most: dict[str, float], slack: float = 0.0, grain: dict[str, float] | None = None) -> float:
    """The largest total whose shares stray from the targets by at most ``slack`` more than the least possible.

    Records are not cut, so a source misses its amount by some part of a record: ``grain`` says by how many tokens on
    average. A small total keeps all targets in proportion but misses them by whole records, a large one lets a source
    run out: the sum of both is what is least here. The larger the sources, the less the grain matters.
    """
    usable = [s for s in targets if targets[s] > 0 and most[s] > 0]
    if not usable:
        return 0.0
    low = min(most[s] / targets[s] for s in usable) * sum(targets[s] for s in usable)
    high = float(sum(most[s] for s in usable))
    rough = sum((grain or {}).get(s, 0.0) for s in usable) / 2

    def off(total: float) -> float:
        return stray(reachable(total, targets, most), targets) + rough / total

    steps = 400
    tried = [low * (high / low) ** (i / steps) for i in range(steps + 1)] if high > low else [low]
    allowed = min(map(off, tried)) + slack + 1e-12
    at = max(i for i, t in enumerate(tried) if off(t) <= allowed)
    if at == len(tried) - 1:
        return high if high > low else low
    a, b = tried[at], tried[at + 1]
    for _ in range(60):
        mid = (a + b) / 2
        a, b = (mid, b) if off(mid) <= allowed else (a, mid)
    return a


def boundary(blocks: dict[str, int], segments: int, k: int) -> dict[str, int]:
    """How many blocks of each source lie before segment ``k``: within one of the exact share, and never fewer than before ``k - 1``.

    Sources with few blocks a segment are rounded down, the others by running sums, so that all add up to the slots.
    """
    total = sum(blocks.values())
    at = k * total // segments
    most = max(blocks, key=lambda s: (blocks[s], s))
    out = {s: at * n // total for s, n in blocks.items() if n < 3 * segments and s != most} if segments > 1 else {}
    large = [s for s in blocks if s not in out]
    rest, weight, run = at - sum(out.values()), sum(blocks[s] for s in large), 0
    for s in large:
        out[s] = rest * (run + blocks[s]) // weight - rest * run // weight if weight else 0
        run += blocks[s]
    return out


def pfair(blocks: dict[str, int], segments: int = 1, k: int = 0) -> list[tuple[str, int, int]]:
    """The order of the blocks of segment ``k``: (source, number, slot).

    Block i of a source with n of N blocks is released at slot floor(i N / n) and due by ceil((i + 1) N / n), or by the end
    of its segment; among the released ones the earliest deadline goes first (ties by source). After t slots every source
    is less than one block from t n / N. Segments begin at states that keep this, so each is laid out by itself; where
    none is released shortly before the end of one, the next goes early, so there it may be up to two blocks. (Where a
    source has fewer than three blocks a segment, its fraction of a block comes on top for the others.)
    """
    total = sum(blocks.values())
    if not total:
        return []
    done, end = boundary(blocks, segments, k), boundary(blocks, segments, k + 1)
    start, stop = k * total // segments, (k + 1) * total // segments

    def entry(s: str, i: int) -> tuple[int, str, int]:
        return (i * total // blocks[s], s, i)

    waiting = [entry(s, i) for s, i in done.items() if i < end[s]]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for t in range(start, stop):
        while waiting and (waiting[0][0] <= t or not ready):
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (min(-(-(i + 1) * total // blocks[s]), stop), s, i))
        _, s, i = heapq.heappop(ready)
        out.append((s, i, t))
        if i + 1 < end[s]:
            heapq.heappush(waiting, entry(s, i + 1))
    return out


def _schedule(blocks: dict[str, int], segments: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in pdf["id"]:
                yield pd.DataFrame(pfair(blocks, segments, int(k)), columns=["source", "number", "slot"])

    return run


def mix(
    records: DataFrame, record_id: str, source: str, size: str, targets: DataFrame, total: int | None = None, slack: float = 0.0, block: int = 2048, segment: int = 50_000, strand_rows: int = 50_000
) -> tuple[DataFrame, DataFrame]:
    """The mixed records (``slot, place, source, <record_id>, repeat, size``) and the report of shares.

    ``targets`` has ``source``, ``target_share`` and ``max_repeats``, a few rows. Each source gives its share of ``total``, but no
    more than ``max_repeats`` times its size; what it lacks is spread over the others in proportion. By default the total
    is the one whose shares come nearest to the targets, whole records considered; ``slack`` allows a larger one (see
    ``best_total``).
    A source's records come in a hash order, pass after pass, up to the nearest record.

    A source's stream is cut into blocks of ``block`` tokens, which ``pfair`` orders, in segments of about ``segment``
    slots that tasks lay out side by side; any prefix of whole blocks holds every share to within one block (two near
    the ends of segments), at any total. Sort by ``slot, place`` to read the mixture.

    Running sums go over strands of about ``strand_rows`` records, so that no source, however large, is one task.

    Defined cases: sources are matched by trimmed lower-case name; records of a null or unlisted source or of no size do not
    take part; a source without records has share 0; repeated ids are separate records; empty tables give an empty
    mixture; other columns are ignored.
    """
    if block < 1 or segment < 1 or strand_rows < 1 or not 0 <= slack <= 1:
        raise ValueError("block, segment and strand_rows must be positive and slack in [0, 1]")
    spark = records.sparkSession
    wanted = {r[0].strip().lower(): (float(r[1] or 0), int(r[2] or 0)) for r in targets.select("source", "target_share", "max_repeats").collect() if r[0]}
    named = records.select(F.col(f"`{record_id}`").alias("id"), F.lower(F.trim(F.col(f"`{source}`"))).alias("source"), F.col(f"`{size}`").cast("bigint").alias("size"))
    named = named.where(F.col("source").isin(list(wanted)) & (F.col("size") > 0)).withColumn("row", F.expr("uuid()"))  # repeated ids stay apart
    named = materialize(named, "mix-records")
    sums = {r["source"]: r for r in named.groupBy("source").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"), F.sum(F.col("size").cast("double") * F.col("size")).alias("q")).collect()}  # one row per listed source
    have = {s: sums[s]["s"] if s in sums else 0 for s in wanted}
    count = {s: sums[s]["n"] if s in sums else 0 for s in wanted}
    shares, most = {s: w for s, (w, _) in wanted.items()}, {s: have[s] * m for s, (_, m) in wanted.items()}
    grain = {s: r["q"] / r["s"] / 4 for s, r in sums.items()}  # to the nearest record: a quarter of the one at the end, which is long rather than short
    goal = reachable(float(total) if total is not None else best_total(shares, most, slack, grain), shares, most)
    whole = sum(goal.values())

    facts = [(s, have[s], goal[s], wanted[s][1], max(1, -(-count[s] // strand_rows))) for s in wanted]
    limits = F.broadcast(spark.createDataFrame(facts, "source string, own bigint, goal double, repeats int, strands bigint"))
    named = named.join(limits, "source").where("goal > 0").withColumn("strand", F.pmod(F.xxhash64("row"), F.col("strands")))
    strands = named.groupBy("source", "strand").agg(F.sum("size").alias("s"))
    before = Window.partitionBy("source").orderBy("strand").rowsBetween(Window.unboundedPreceding, -1)
    offsets = strands.select("source", "strand", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("source", "strand").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = named.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0))).join(offsets, ["source", "strand"]).withColumn("at", F.col("offset") + F.col("ahead"))
    passes = F.least(F.ceil(F.col("goal") / F.col("own")), F.col("repeats").cast("bigint"))
    copies = placed.withColumn("repeat", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(passes, F.lit(1)) - 1)))
    copies = copies.withColumn("start", F.col("at") + F.col("repeat") * F.col("own")).where(F.col("start") + F.col("size") / 2 <= F.col("goal"))
    copies = materialize(copies.select("source", "id", "size", "start", F.col("repeat").cast("int").alias("repeat"), F.expr(f"start div {block}").alias("number")), "mix-copies")

    blocks = {r[0]: r[1] + 1 for r in copies.groupBy("source").agg(F.max("number")).collect()}
    segments = max(1, -(-sum(blocks.values()) // max(segment, 8 * len(blocks))))
    turns = spark.range(0, segments if blocks else 0, 1, segments)
    schedule = turns.mapInPandas(_schedule(blocks, segments), "source string, number bigint, slot bigint")
    mixed = copies.join(schedule, ["source", "number"]).select("slot", F.col("start").alias("place"), "source", F.col("id").alias(record_id), "repeat", "size")

    used = copies.groupBy("source").agg(F.sum("size").alias("tokens"), F.count(F.lit(1)).alias("records"), (F.max("repeat") + 1).alias("repeats_used"))
    facts = spark.createDataFrame([(s, shares[s], wanted[s][1], have[s], count[s], goal[s] / whole if whole else 0.0) for s in wanted], "source string, target_share double, max_repeats int, source_tokens bigint, source_records bigint, reachable_share double")
    told = facts.join(used, "source", "left").withColumn("all", F.sum("tokens").over(Window.partitionBy()))  # one row per listed source
    zero = F.lit(0).cast("bigint")
    report = told.select(
        "source", "target_share", "reachable_share", F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0)).alias("actual_share"), F.coalesce("tokens", zero).alias("tokens"),
        F.coalesce("records", zero).alias("records"), "source_tokens", "source_records", "max_repeats", F.coalesce("repeats_used", F.lit(0)).alias("repeats_used"),
    )
    return mixed, report
