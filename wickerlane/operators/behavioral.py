"""Sixty behavioral features of a candidate pair, from what happened before the cutoff."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickerlane.functions.text import ratio
from wickerlane.operators.temporal import before

# Attributes whose shares in a customer's purchases count, and those with windows and recency as well.
ATTRIBUTES = {
    "product_type": "product_type_no", "product_group": "product_group_name", "department": "department_no", "section": "section_no",
    "garment_group": "garment_group_no", "colour_group": "colour_group_code", "index_group": "index_group_no",
}
WINDOWED = ("product_type", "section", "garment_group")
MISSING_DAYS = 999.0


# The names of the sixty features, in their order; other systems read them.
NAMES = (
    "customer_transaction_count_log",
    "customer_unique_article_count_log",
    "customer_1d_transaction_count_log",
    "customer_3d_transaction_count_log",
    "customer_7d_transaction_count_log",
    "customer_30d_transaction_count_log",
    "customer_1d_to_7d_transaction_ratio",
    "customer_3d_to_7d_transaction_ratio",
    "customer_7d_to_30d_transaction_ratio",
    "customer_30d_to_all_time_transaction_ratio",
    "customer_days_since_last_purchase",
    "customer_tenure_days_log",
    "article_all_time_purchase_count_log",
    "article_1d_purchase_count_log",
    "article_3d_purchase_count_log",
    "article_7d_purchase_count_log",
    "article_14d_purchase_count_log",
    "article_30d_purchase_count_log",
    "article_1d_to_7d_purchase_ratio",
    "article_3d_to_14d_purchase_ratio",
    "article_7d_to_30d_purchase_ratio",
    "article_7d_to_all_time_purchase_ratio",
    "article_1d_purchase_count_delta_vs_7d_rate",
    "article_3d_purchase_count_delta_vs_14d_rate",
    "article_7d_purchase_count_delta_vs_30d_rate",
    "article_days_since_last_purchase",
    "user_article_purchase_count_log",
    "user_article_days_since_last_purchase",
    "customer_mean_price",
    "article_mean_price",
    "article_mean_price_minus_customer_mean",
    "article_mean_price_ratio_customer_mean",
    "customer_sales_channel_2_share",
    "article_sales_channel_2_share",
    "article_customer_sales_channel_2_share_gap_abs",
    "user_product_type_purchase_count_log",
    "user_product_group_purchase_count_log",
    "user_department_purchase_count_log",
    "user_section_purchase_count_log",
    "user_garment_group_purchase_count_log",
    "user_colour_group_purchase_count_log",
    "user_index_group_purchase_count_log",
    "user_product_type_30d_purchase_count_log",
    "user_section_30d_purchase_count_log",
    "user_garment_group_30d_purchase_count_log",
    "user_product_type_30d_to_all_time_purchase_ratio",
    "user_section_30d_to_all_time_purchase_ratio",
    "user_garment_group_30d_to_all_time_purchase_ratio",
    "user_product_type_days_since_last_purchase",
    "user_section_days_since_last_purchase",
    "user_garment_group_days_since_last_purchase",
    "article_product_type_7d_purchase_count_log",
    "article_section_7d_purchase_count_log",
    "article_garment_group_7d_purchase_count_log",
    "article_product_type_30d_purchase_count_log",
    "article_section_30d_purchase_count_log",
    "article_garment_group_30d_purchase_count_log",
    "article_product_type_7d_to_30d_purchase_ratio",
    "article_section_7d_to_30d_purchase_ratio",
    "article_garment_group_7d_to_30d_purchase_ratio",
)


def names() -> list[str]:
    return list(NAMES)


def _counts(cutoff: dt.date, days: tuple[int, ...]) -> list[Column]:
    inside = lambda n: F.col("t_dat") >= F.lit(cutoff - dt.timedelta(days=n))
    return [F.count(F.lit(1)).alias("n"), *[F.count_if(inside(n)).alias(f"n{n}") for n in days]]


def _money() -> list[Column]:
    return [F.sum("price").alias("s"), F.count("price").alias("v"), F.count_if(F.col("sales_channel_id") == 2).alias("c2"), F.max("t_dat").alias("last")]


def stores(tx: DataFrame, cutoff: dt.date, pairs: DataFrame, articles: DataFrame) -> dict[str, DataFrame]:
    """The keyed aggregates: by customer, article, pair, customer and attribute value, attribute value.

    Customer aggregates cover the pairs' customers, article aggregates the pairs' articles; trends cover everything.
    """
    past = before(tx, cutoff)
    mine = past.join(pairs.select("customer_id").distinct(), "customer_id", "left_semi")
    tags = F.array(*[F.struct(F.lit(x).alias("attr"), F.col(c).alias("value")) for x, c in ATTRIBUTES.items()])
    values = articles.select("article_id", F.explode(tags).alias("t")).select("article_id", "t.*").where(F.coalesce("value", F.lit("")) != "")
    return {
        "customer": mine.groupBy("customer_id").agg(*_counts(cutoff, (1, 3, 7, 30)), *_money(), F.min("t_dat").alias("first"), F.count_distinct("article_id").alias("articles")),
        "article": past.join(pairs.select("article_id").distinct(), "article_id", "left_semi").groupBy("article_id").agg(*_counts(cutoff, (1, 3, 7, 14, 30)), *_money()),
        "pair": mine.groupBy("customer_id", "article_id").agg(F.count(F.lit(1)).alias("n"), F.max("t_dat").alias("last")),
        "own": mine.join(values, "article_id").groupBy("customer_id", "attr", "value").agg(*_counts(cutoff, (30,)), F.max("t_dat").alias("last")),
        "trend": past.join(values.where(F.col("attr").isin(*WINDOWED)), "article_id").groupBy("attr", "value").agg(*_counts(cutoff, (7, 30))),
        "values": values,
    }


def features(tx: DataFrame, cutoff: dt.date, pairs: DataFrame, articles: DataFrame, missing_days: float = MISSING_DAYS) -> DataFrame:
    """``customer_id, article_id`` and the features of ``names()``; counts as log1p, missing counts 0, missing days ``missing_days``."""
    if missing_days < 0:
        raise ValueError("missing_days must not be negative")
    s = stores(tx, cutoff, pairs, articles)
    as_struct = lambda df, keys, name: df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias(name))
    n = lambda c: F.coalesce(c, F.lit(0))
    days = lambda c: F.coalesce(F.datediff(F.lit(cutoff), c).cast("double"), F.lit(missing_days))

    keyed = pairs.select("customer_id", "article_id").distinct()
    tagged = keyed.join(s["values"], "article_id").join(s["own"], ["customer_id", "attr", "value"], "left")
    tagged = tagged.join(as_struct(s["trend"], ["attr", "value"], "trend"), ["attr", "value"], "left")
    at = lambda x, c: F.max(F.when(F.col("attr") == x, c))
    aggs = [at(x, n(F.col("n"))).alias(f"own_{x}") for x in ATTRIBUTES]
    for x in WINDOWED:
        aggs += [at(x, n(F.col("n30"))).alias(f"own30_{x}"), at(x, days(F.col("last"))).alias(f"ownlast_{x}"), at(x, n(F.col("trend.n7"))).alias(f"t7_{x}"), at(x, n(F.col("trend.n30"))).alias(f"t30_{x}")]
    by_value = tagged.groupBy("customer_id", "article_id").agg(*aggs)

    j = keyed.join(as_struct(s["customer"], ["customer_id"], "c"), "customer_id", "left").join(as_struct(s["article"], ["article_id"], "a"), "article_id", "left")
    j = j.join(as_struct(s["pair"], ["customer_id", "article_id"], "p"), ["customer_id", "article_id"], "left").join(by_value, ["customer_id", "article_id"], "left")
    g = lambda x: n(F.col(x))
    log = lambda x: F.log1p(g(x))
    share = lambda a, b: ratio(g(a), g(b))
    delta = lambda a, b, i, k: g(a) - g(b) * i / float(k)
    c_price, a_price, c_two, a_two = share("c.s", "c.v"), share("a.s", "a.v"), share("c.c2", "c.n"), share("a.c2", "a.n")
    cols = [log("c.n"), log("c.articles"), *[log(f"c.n{x}") for x in (1, 3, 7, 30)], share("c.n1", "c.n7"), share("c.n3", "c.n7"), share("c.n7", "c.n30"), share("c.n30", "c.n"), days(F.col("c.last")), F.log1p(days(F.col("c.first")))]
    cols += [log("a.n"), *[log(f"a.n{x}") for x in (1, 3, 7, 14, 30)], share("a.n1", "a.n7"), share("a.n3", "a.n14"), share("a.n7", "a.n30"), share("a.n7", "a.n")]
    cols += [delta("a.n1", "a.n7", 1, 7), delta("a.n3", "a.n14", 3, 14), delta("a.n7", "a.n30", 7, 30), days(F.col("a.last")), log("p.n"), days(F.col("p.last"))]
    cols += [c_price, a_price, a_price - c_price, ratio(a_price, c_price), c_two, a_two, F.abs(a_two - c_two)]
    cols += [log(f"own_{x}") for x in ATTRIBUTES] + [log(f"own30_{x}") for x in WINDOWED] + [share(f"own30_{x}", f"own_{x}") for x in WINDOWED]
    cols += [F.coalesce(f"ownlast_{x}", F.lit(missing_days)) for x in WINDOWED] + [log(f"t7_{x}") for x in WINDOWED] + [log(f"t30_{x}") for x in WINDOWED] + [share(f"t7_{x}", f"t30_{x}") for x in WINDOWED]
    return j.select("customer_id", "article_id", *[c.cast("double").alias(x) for c, x in zip(cols, names(), strict=True)])
