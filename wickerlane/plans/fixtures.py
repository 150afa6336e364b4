"""The tables as the recommendation operators want them, and the SQL that says the same."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wickerlane.functions.text import label
from wickerlane.operators import candidates as c
from wickerlane.operators.popularity import age_segments
from wickerlane.operators.temporal import Split, label_customers, labels
from wickerlane.sources.tables import table

SPLIT = Split(dt.date(2023, 12, 1), 7)
CUT, K, DAYS = SPLIT.cutoff, 12, 7


def tx(spark: SparkSession, d: str) -> DataFrame:
    """Events with all three keys; ``seq`` is the order of the log."""
    t = table(spark, d, "transactions_train")
    return t.select(F.col("tx_seq").alias("seq"), "t_dat", "customer_id", "article_id", F.col("price").cast("double").alias("price"), "sales_channel_id").dropna(subset=["t_dat", "customer_id", "article_id"])


def found(spark: SparkSession, d: str, split: Split = SPLIT) -> DataFrame:
    return labels(tx(spark, d), split)


def targets(spark: SparkSession, d: str, split: Split = SPLIT) -> DataFrame:
    return label_customers(found(spark, d, split), table(spark, d, "customers"))


def segments(spark: SparkSession, d: str) -> DataFrame:
    return age_segments(table(spark, d, "customers"), 10, invalid="unknown")


def attribute(spark: SparkSession, d: str, column: str) -> DataFrame:
    return table(spark, d, "articles").select("article_id", label(column).alias("value"))


def all_candidates(spark: SparkSession, d: str, split: Split = SPLIT) -> DataFrame:
    return c.every_source(
        tx(spark, d), split.cutoff, targets(spark, d, split), segments(spark, d), attribute(spark, d, "garment_group_name"), attribute(spark, d, "product_code"), K, DAYS
    )


# -- SQL -------------------------------------------------------------------------------------------------------
def _clean(column: str) -> str:
    return f"coalesce(nullif(trim(regexp_replace({column}, '[ \\t]+', ' ', 'g')), ''), 'unknown')"


_BY = "n DESC, last_day DESC, article_id"


def _affinity(name: str, column: str) -> dict[str, str]:
    return {
        f"{name}_attr": f"SELECT article_id, {_clean(column)} AS value FROM articles",
        f"{name}_count": f"SELECT value, article_id, ln(1 + count(*)) AS c FROM recent JOIN {name}_attr USING (article_id) GROUP BY 1, 2",
        f"{name}_pop": f"SELECT value, article_id, score FROM (SELECT value, article_id, round(c / max(c) OVER (PARTITION BY value), 9) AS score FROM {name}_count) QUALIFY row_number() OVER (PARTITION BY value ORDER BY score DESC, article_id) <= 12",
        f"{name}_hist": f"SELECT customer_id, value, row_number() OVER (PARTITION BY customer_id ORDER BY seq DESC) AS position FROM (SELECT customer_id, value, max(seq) AS seq FROM past JOIN {name}_attr USING (article_id) SEMI JOIN targets USING (customer_id) GROUP BY 1, 2) QUALIFY position <= 8",
        f"{name}_best": f"SELECT customer_id, article_id, round(max(score / position), 9) AS score FROM {name}_hist JOIN {name}_pop USING (value) GROUP BY 1, 2",
        f"{name}_affinity": f"SELECT customer_id, article_id, score, row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, article_id) AS rank FROM {name}_best QUALIFY rank <= 12",
    }


def ctes(split: Split = SPLIT) -> dict[str, str]:
    cut = split.cutoff

    def top(days: int) -> str:
        return f"SELECT article_id, row_number() OVER (ORDER BY {_BY}) AS rank FROM (SELECT article_id, count(*) AS n, max(t_dat) AS last_day FROM past WHERE t_dat >= DATE '{cut}' - {days} GROUP BY 1) QUALIFY rank <= 12"

    return {
        "tx": "SELECT tx_seq AS seq, t_dat, customer_id, article_id, price::DOUBLE AS price, sales_channel_id FROM transactions_train WHERE t_dat IS NOT NULL AND customer_id IS NOT NULL AND article_id IS NOT NULL",
        "past": f"SELECT * FROM tx WHERE t_dat < DATE '{cut}'",
        "recent": f"SELECT * FROM past WHERE t_dat >= DATE '{cut}' - {DAYS}",
        "found": f"SELECT DISTINCT customer_id, article_id FROM tx WHERE t_dat >= DATE '{cut}' AND t_dat < DATE '{split.end}'",
        "targets": "SELECT DISTINCT customer_id FROM found SEMI JOIN customers USING (customer_id)",
        "repeats": f"SELECT customer_id, article_id, row_number() OVER (PARTITION BY customer_id ORDER BY {_BY}) AS rank FROM (SELECT customer_id, article_id, count(*) AS n, max(t_dat) AS last_day FROM past SEMI JOIN targets USING (customer_id) GROUP BY 1, 2) QUALIFY rank <= 12",
        "top7": top(7),
        "top1": top(1),
        "top3": top(3),
        "topall": top(100000),
        "history": "SELECT customer_id, article_id, row_number() OVER (PARTITION BY customer_id ORDER BY seq DESC) AS position FROM (SELECT customer_id, article_id, max(seq) AS seq FROM past GROUP BY 1, 2) QUALIFY position <= 8",
        "pairs": "SELECT a.article_id, b.article_id AS other_id, count(*) AS n FROM history a JOIN history b ON a.customer_id = b.customer_id AND a.article_id <> b.article_id GROUP BY 1, 2",
        "near": "SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY n DESC, other_id) AS rank FROM pairs QUALIFY rank <= 100",
        "covis_sum": "SELECT customer_id, other_id AS article_id, sum(n * (840 // position))::BIGINT AS units, min(rank) AS near_rank FROM history SEMI JOIN targets USING (customer_id) JOIN near USING (article_id) GROUP BY 1, 2",
        "covis": "SELECT customer_id, article_id, units / 840.0::DOUBLE AS score, row_number() OVER (PARTITION BY customer_id ORDER BY units DESC, near_rank, article_id) AS rank FROM covis_sum QUALIFY rank <= 12",
        "season_rows": f"SELECT article_id, ln(1 + count(*)) AS c FROM tx WHERE t_dat >= DATE '{cut - dt.timedelta(366)}' AND t_dat < DATE '{cut - dt.timedelta(359)}' GROUP BY 1",
        "season": "SELECT *, row_number() OVER (ORDER BY score DESC, article_id) AS rank FROM (SELECT article_id, round(c / max(c) OVER (), 9) AS score FROM season_rows) QUALIFY rank <= 12",
        "segments": """SELECT customer_id, CASE WHEN regexp_full_match(trim(coalesce(age, '')), '[0-9]{1,9}') AND CAST(trim(age) AS INTEGER) > 0
            THEN 'age_' || (CAST(trim(age) AS INTEGER) // 10 * 10) || '_' || (CAST(trim(age) AS INTEGER) // 10 * 10 + 9) ELSE 'age_unknown' END AS segment FROM customers""",
        "seg_count": "SELECT segment, article_id, ln(1 + count(*)) AS c FROM recent JOIN segments USING (customer_id) GROUP BY 1, 2",
        "seg_pop": "SELECT *, row_number() OVER (PARTITION BY segment ORDER BY score DESC, article_id) AS rank FROM (SELECT segment, article_id, round(c / max(c) OVER (PARTITION BY segment), 9) AS score FROM seg_count) QUALIFY rank <= 12",
        **_affinity("garment", "garment_group_name"),
        **_affinity("product", "product_code"),
        "candidates": " UNION ALL ".join(
            [
                "SELECT customer_id, article_id, 'repeat' AS source, rank AS source_rank, 1.0::DOUBLE / rank AS source_score FROM repeats",
                *(f"SELECT customer_id, article_id, '{n}', rank, 1.0::DOUBLE / rank FROM targets, {t}" for n, t in (("recent_popularity", "top7"), ("recent_popularity_1d", "top1"), ("recent_popularity_3d", "top3"), ("all_time_popularity", "topall"))),
                "SELECT customer_id, article_id, 'co_visitation', rank, score FROM covis",
                "SELECT customer_id, article_id, 'seasonal_popularity', rank, score FROM targets, season",
                "SELECT customer_id, article_id, 'age_segment_popularity', rank, score FROM targets JOIN segments USING (customer_id) JOIN seg_pop USING (segment)",
                "SELECT customer_id, article_id, 'garment_group_popularity', rank, score FROM garment_affinity",
                "SELECT customer_id, article_id, 'product_code_popularity', rank, score FROM product_affinity",
            ]
        ),
    }


CTES = ctes()
#: CTEs that other modules add; none holds a date.
MORE: dict[str, str] = {}


def sql(final: str, split: Split | None = None, **more: str) -> str:
    """``final`` behind the CTEs it needs, its own ``more`` included."""
    import re

    every, need, queue = (ctes(split) if split else CTES) | MORE | more, set(), [final]
    while queue:
        words = set(re.findall(r"\w+", queue.pop()))
        for name in every:
            if name in words and name not in need:
                need.add(name)
                queue.append(every[name])
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({q})" for n, q in every.items() if n in need) + " " + final
