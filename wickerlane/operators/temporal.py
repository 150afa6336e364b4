"""The clock rule: features lie before the cutoff, labels in the horizon that begins with it."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Split:
    cutoff: dt.date
    horizon_days: int = 7

    def __post_init__(self) -> None:
        if self.horizon_days < 1:
            raise ValueError("horizon_days must be positive")

    @property
    def end(self) -> dt.date:
        return self.cutoff + dt.timedelta(days=self.horizon_days)

    def previous(self) -> Split:
        """The window of the same length that ends where this one begins."""
        return Split(self.cutoff - dt.timedelta(days=self.horizon_days), self.horizon_days)


def _positive(name: str, n: int | None) -> None:
    if n is not None and n < 1:
        raise ValueError(f"{name} must be positive")


def before(tx: DataFrame, cutoff: dt.date) -> DataFrame:
    return tx.where(F.col("t_dat") < F.lit(cutoff))


def lookback(tx: DataFrame, cutoff: dt.date, days: int) -> DataFrame:
    """Rows of the ``days`` before the cutoff."""
    _positive("days", days)
    return tx.where((F.col("t_dat") >= F.lit(cutoff - dt.timedelta(days=days))) & (F.col("t_dat") < F.lit(cutoff)))


def shifted(tx: DataFrame, cutoff: dt.date, shift_days: int = 366, window_days: int = 7) -> DataFrame:
    """Rows of a window that begins ``shift_days`` before the cutoff; it must end by the cutoff."""
    _positive("window_days", window_days)
    if window_days > shift_days:
        raise ValueError("the window must end by the cutoff")
    start = cutoff - dt.timedelta(days=shift_days)
    return tx.where((F.col("t_dat") >= F.lit(start)) & (F.col("t_dat") < F.lit(start + dt.timedelta(days=window_days))))


def bucket(split: Split, day: str = "t_dat") -> Column:
    """``train``, ``validation`` or ``future``."""
    return F.when(F.col(day) < F.lit(split.cutoff), "train").when(F.col(day) < F.lit(split.end), "validation").otherwise("future")


def labels(tx: DataFrame, split: Split) -> DataFrame:
    """Distinct ``customer_id, article_id`` of the horizon."""
    return tx.where((F.col("t_dat") >= F.lit(split.cutoff)) & (F.col("t_dat") < F.lit(split.end))).select("customer_id", "article_id").distinct()


def labels_of_many(tx: DataFrame, splits: list[Split]) -> DataFrame:
    """Labels of many cutoffs in one pass, with a ``cutoff`` column: each row is exploded to the horizons it lies in."""
    if not splits:
        raise ValueError("no splits")
    each = F.array(*[F.when((F.col("t_dat") >= F.lit(s.cutoff)) & (F.col("t_dat") < F.lit(s.end)), F.lit(s.cutoff)) for s in splits])
    return tx.select(F.explode(F.array_compact(each)).alias("cutoff"), "customer_id", "article_id").distinct()


def split_summary(tx: DataFrame, split: Split) -> DataFrame:
    """One row per bucket with rows: ``bucket, rows, customers, articles, pairs``."""
    return tx.groupBy(bucket(split).alias("bucket")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("customer_id").alias("customers"), F.count_distinct("article_id").alias("articles"), F.count_distinct("customer_id", "article_id").alias("pairs")
    )


def label_customers(found: DataFrame, universe: DataFrame, most: int | None = None) -> DataFrame:
    """Customers with labels that the universe knows; with ``most``, the first of them by id."""
    _positive("most", most)
    out = found.select("customer_id").distinct().join(universe.select("customer_id"), "customer_id", "left_semi")
    return out if most is None else out.orderBy("customer_id").limit(most)


def check_windows(splits: list[Split]) -> None:
    """Windows of a rolling validation: unique, ascending, alike and without overlap."""
    for a, b in zip(splits, splits[1:]):
        if a.horizon_days != b.horizon_days or b.cutoff <= a.cutoff or a.end > b.cutoff:
            raise ValueError("windows must be alike, ascending and must not overlap")


def assert_before(metadata: dict, cutoff: dt.date) -> None:
    """Features carry the cutoff they were built for; a later one would leak labels."""
    built = dt.date.fromisoformat(str(metadata["cutoff"]))
    if built > cutoff:
        raise ValueError(f"features were built for {built}, after {cutoff}")


def comparable(configs: list[dict], ignore: tuple[str, ...] = ("cutoff",)) -> list[str]:
    """The settings in which runs of several windows differ, so that their metrics cannot be compared."""
    names = sorted({k for c in configs for k in c if k not in ignore})
    return [k for k in names if len({repr(c.get(k)) for c in configs}) > 1]


def leakage(history: DataFrame, found: DataFrame, split: Split) -> DataFrame:
    """One row: rows of the history on or after the cutoff, and labelled pairs without a row in the horizon; both must be 0."""
    late = history.agg(F.count_if(F.col("t_dat") >= F.lit(split.cutoff)).alias("late_rows"), F.max("t_dat").alias("last_day"))
    return late.join(F.broadcast(found.agg(F.count(F.lit(1)).alias("labels"))), F.lit(True))
