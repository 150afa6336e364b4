"""Aggregates over a join without the join's rows, for keys of which a few hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_states(
    df: DataFrame, key: str, sums: list[str] = (), maxes: list[str] = (), distinct: str | None = None, also: list[str] = ()
) -> DataFrame:
    """One compact state per ``key`` (and ``also``): ``n``, ``s_<col>``, ``m_<col>`` and, with ``distinct``, ``d``.

    A hot key never goes to one task: rows are combined before each exchange, and with ``distinct`` the first level
    is by (key, distinct value), which spreads a key over as many tasks as it has values.
    """
    by = [key, *also]
    level = df.where(F.col(f"`{key}`").isNotNull())
    partial = [F.count(F.lit(1)).alias("n"), *[F.sum(f"`{c}`").alias(f"s_{c}") for c in sums], *[F.max(f"`{c}`").alias(f"m_{c}") for c in maxes]]
    names = [f"`{c}`" for c in by]
    if distinct is None:
        return level.groupBy(*names).agg(*partial)
    first = level.groupBy(*names, F.col(f"`{distinct}`").alias("value_")).agg(*partial)
    return first.groupBy(*names).agg(
        F.sum("n").alias("n"), F.count("value_").alias("d"), *[F.sum(f"s_{c}").alias(f"s_{c}") for c in sums], *[F.max(f"m_{c}").alias(f"m_{c}") for c in maxes]
    )


def eager_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", by: list[str] = ()) -> DataFrame:
    """Join two tables of states (see ``key_states``) as if their rows had been joined.

    Every left row meets ``n_right`` right rows and the other way round, so counts multiply and sums are scaled by
    the other side's count; extremes and distinct counts of a key stay as they are. Columns: ``key``, ``by`` (columns
    of the right states), ``n_left``, ``n_right``, ``rows``, ``left_s_*``, ``right_s_*`` (sums over the joined rows),
    ``left_m_*``, ``right_m_*``, ``left_d``, ``right_d``. With ``how`` left, a key without partner counts as joined
    with one empty row.

    Defined cases: null keys join nothing and are dropped; sums of nulls only are null; empty inputs give empty results
    (for ``left``, the left states alone).
    """
    if how not in ("inner", "left"):
        raise ValueError("how is inner or left")
    a = left.select(F.col(f"`{key}`").alias("key_"), F.struct("*").alias("a"))
    b = right.select(F.col(f"`{key}`").alias("key_r"), F.struct("*").alias("b"))
    both = a.join(b, F.col("key_") == F.col("key_r"), how)
    n_a, n_b = F.col("a.n"), F.coalesce(F.col("b.n"), F.lit(1))
    out = [F.col("key_").alias(key), *[F.col(f"b.`{c}`").alias(c) for c in by], n_a.alias("n_left"), F.col("b.n").alias("n_right"), (n_a * n_b).alias("rows")]
    for side, other, name, df in (("a", n_b, "left", left), ("b", n_a, "right", right)):
        for c in df.columns:
            if c.startswith("s_"):
                out.append((F.col(f"{side}.`{c}`") * other).alias(f"{name}_{c}"))
            elif c.startswith("m_") or c == "d":
                out.append(F.col(f"{side}.`{c}`").alias(f"{name}_{c}"))
    return both.select(*out)


def roll_up(joined: DataFrame, by: list[str]) -> DataFrame:
    """Sum the counts and sums of ``eager_join`` and take the extremes, by groups of keys (distinct counts do not add up)."""
    aggs = [F.sum("rows").alias("rows")]
    for c in joined.columns:
        if "_s_" in c:
            aggs.append(F.sum(f"`{c}`").alias(c))
        elif "_m_" in c:
            aggs.append(F.max(f"`{c}`").alias(c))
    return joined.groupBy(*[f"`{c}`" for c in by]).agg(*aggs)
