"""The N best items of every group, by a two-stage salted ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wickerlane.workspace import materialize


def top_n_per_group(
    df: DataFrame,
    groups: list[str],
    item: str = "article_id",
    score: str = "score",
    n: int = 12,
    units: int | None = None,
) -> DataFrame:
    """Columns ``groups``, ``item``, ``score`` and ``rank`` (1..n) of the ``n`` best items of each group.

    Order: score descending, then item ascending. An item counts once per group, with its highest score.

    Stage 1 hashes each group into subgroups by item and keeps ``n`` of each; stage 2 ranks the survivors. A group gets as
    many subgroups as it holds ``units``-ths of the rows, rounded up (by default four units a shuffle partition), so no
    subgroup has more than about one unit of rows, at any size of the table. Groups of more than one unit are fewer than
    ``units``, which bounds the list of them that is broadcast.

    Defined cases: rows with a null or NaN score or a null item do not count; -0.0 equals 0.0; null group values
    form one group; a group with fewer than ``n`` items comes out whole; repeated rows and ties change nothing;
    an empty table gives an empty result; other columns, whatever their names, are ignored.
    """
    if n < 1 or not groups or (units is not None and units < 1):
        raise ValueError("n and units must be positive and groups must not be empty")
    keys = [f"g{i}" for i in range(len(groups))]
    rows = df.select(
        *[F.col(f"`{g}`").alias(k) for g, k in zip(groups, keys)],
        F.col(f"`{item}`").alias("item"),
        (F.col(f"`{score}`").cast("double") + F.lit(0.0)).alias("score"),
    ).where(F.col("item").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))

    units = units or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = materialize(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("size")), "group-sizes")
    unit = max(1.0, (sizes.agg(F.sum("size")).first()[0] or 0) / units)
    large = sizes.where(F.col("size") > unit).select(*[F.col(k).alias(f"h_{k}") for k in keys], F.ceil(F.col("size") / unit).alias("parts"))

    same = [F.col(k).eqNullSafe(F.col(f"h_{k}")) for k in keys]
    on = same[0]
    for s in same[1:]:
        on = on & s
    salted = rows.join(F.broadcast(large), on, "left").select(
        *keys, F.pmod(F.xxhash64("item"), F.coalesce(F.col("parts"), F.lit(1))).cast("int").alias("salt"), "item", "score"
    )
    # An item's repeated rows are combined before the exchange; they share their salt.
    best = salted.groupBy(*keys, "salt", "item").agg(F.max("score").alias("score"))
    order = [F.desc("score"), F.asc("item")]
    first = best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "salt").orderBy(*order))).where(F.col("rank") <= n)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)
    return last.select(*[F.col(k).alias(g) for g, k in zip(groups, keys)], F.col("item").alias(item), F.col("score").alias(score), "rank")
