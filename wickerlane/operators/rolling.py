"""Totals over trailing periods for every entity and day."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trailing_totals(
    df: DataFrame,
    entity: str,
    day: str,
    value: str,
    periods: tuple[int, ...] = (7, 30),
    entities: DataFrame | None = None,
    span: tuple[dt.date, dt.date] | None = None,
) -> DataFrame:
    """``entity``, ``day`` and per period p ``rows_p``, ``total_p``, ``mean_p`` over the p days ending with the day.

    Rows become daily totals first (combined before the exchange, so a hot entity is at most one row per day and
    task). Each daily total is then exploded onto the days it influences, grouped by entity and date, and joined to
    the calendar, which gives zeros to days without activity. From the daily totals on, all work of an entity stays
    in one partition and is bounded by its number of days.

    ``entities`` (a column named as ``entity``) says whose rows come out, all in ``df`` by default; ``span`` is the first
    and last day, by default those of ``df``. Defined cases: rows with a null entity or day do not count; a null value
    counts as a row but in no total or mean; a mean is null where no value is; an empty table gives an empty result;
    repeated rows all count; other columns are ignored.

    The join reuses the partitioning by entity, for which ``spark.sql.requireAllClusterKeysForCoPartition`` is set to
    false in the session.
    """
    if not periods or any(p < 1 for p in periods):
        raise ValueError("periods must be positive")
    spark = df.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    c = lambda name: F.col(f"`{name}`")
    rows = df.select(c(entity).alias("entity"), c(day).cast("date").alias("day"), c(value).cast("double").alias("value")).dropna(subset=["entity", "day"])
    if span is None:
        span = tuple(df.select(c(day).cast("date").alias("day")).agg(F.min("day"), F.max("day")).first())
    first, last = span
    if first is None:
        first = last = dt.date(1970, 1, 1)
        rows = rows.limit(0)
    if entities is None:
        wanted = None
    else:
        wanted = entities.select(c(entity).alias("entity")).dropna().distinct()
        rows = rows.join(wanted, "entity", "left_semi")
    longest = max(periods)
    daily = rows.groupBy("entity", "day").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("v"), F.sum("value").alias("s")).repartition("entity")
    reach = daily.select("entity", "n", "v", "s", F.col("day").alias("from"), F.explode(F.sequence(F.lit(0), F.lit(longest - 1))).alias("ahead"))
    reach = reach.select("entity", F.date_add("from", F.col("ahead")).alias("day"), "ahead", "n", "v", "s").where(F.col("day").between(F.lit(first), F.lit(last)))
    aggs = []
    for p in periods:
        near = F.col("ahead") < p
        aggs += [F.sum(F.when(near, F.col("n"))).alias(f"n{p}"), F.sum(F.when(near, F.col("v"))).alias(f"v{p}"), F.sum(F.when(near, F.col("s"))).alias(f"s{p}")]
    totals = reach.groupBy("entity", "day").agg(*aggs)
    grid = (daily.select("entity").distinct() if wanted is None else wanted.repartition("entity")).select(
        "entity", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("day")
    )
    # The estimate of the grid does not know of the days, so it would be taken for small and broadcast.
    full = grid.join(totals.hint("merge"), ["entity", "day"], "left")
    out = [F.col("entity").alias(entity), F.col("day").alias(day)]
    for p in periods:
        out += [
            F.coalesce(f"n{p}", F.lit(0)).cast("bigint").alias(f"rows_{p}"),
            F.coalesce(f"s{p}", F.lit(0.0)).alias(f"total_{p}"),
            F.when(F.col(f"v{p}") > 0, F.col(f"s{p}") / F.col(f"v{p}")).alias(f"mean_{p}"),
        ]
    return full.select(*out)
