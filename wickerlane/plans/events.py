"""Registered plans of the general problems: entity features, hot keys, trailing periods, broken lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wickerlane.functions.text import settled
from wickerlane.operators.eager import eager_join, key_states, roll_up
from wickerlane.operators.quarantine import parse_transactions
from wickerlane.operators.rolling import trailing_totals
from wickerlane.plans.base import query
from wickerlane.sources.tables import table
from wickerlane.streaming.entity_features import EntityFeatures, parquet_stream
from wickerlane.workspace import children, materialize, scratch

# -- 3: per-entity features ----------------------------------------------------------------------------------
KINDS, PERIODS = (1, 2), (7, 30, 90)


def _feature_sql() -> str:
    cells = []
    for k in (None, *KINDS):
        for p in (None, *PERIODS):
            cond = " AND ".join(["true", *([f"sales_channel_id = {k}"] if k else []), *([f"t_dat > as_of - {p}"] if p else [])])
            name = "_".join(["all" if k is None else f"type{k}", *([f"{p}d"] if p else [])])
            price = f"price) FILTER ({cond})"
            cells += [
                f"count(*) FILTER ({cond}) AS n_{name}",
                f"round(coalesce(sum({price}, 0)::DOUBLE + 1e-9, 6) AS total_{name}",
                f"round(sum({price}::DOUBLE / nullif(count({price}, 0) + 1e-9, 6) AS mean_{name}",
            ]
    for k in (None, *KINDS):
        name, cond = ("all", "true") if k is None else (f"type{k}", f"sales_channel_id = {k}")
        for f, word in (("min", "first"), ("max", "last")):
            cells.append(f"CAST(any_value(as_of) - {f}(t_dat) FILTER ({cond}) AS INTEGER) AS days_since_{word}_{name}")
    return (
        f"SELECT customer_id, {', '.join(cells)} FROM transactions_train, (SELECT max(t_dat) AS as_of FROM transactions_train) "
        "WHERE customer_id IS NOT NULL GROUP BY customer_id"
    )


def log_stream(spark: SparkSession, d: str, batches: int = 3) -> DataFrame:
    """The log as a stream of about ``batches`` batches; a log that is one file is laid out as so many first."""
    path = f"{d}/transactions_train.parquet"
    if sum(p.endswith(".parquet") for p in children(spark, path)) < batches:
        rows, path = spark.read.parquet(path), scratch(spark, "log")
        rows.select("customer_id", "t_dat", "sales_channel_id", "price").repartition(batches).write.parquet(path)
    return parquet_stream(spark, path, batches)


@query(_feature_sql())
def p3_features(spark: SparkSession, d: str) -> DataFrame:
    as_of = table(spark, d, "transactions_train").agg(F.max("t_dat")).first()[0]
    made = EntityFeatures("customer_id", "t_dat", "sales_channel_id", "price", list(KINDS), PERIODS)
    path = scratch(spark, "features")
    out = made.run(spark, log_stream(spark, d), f"{path}/table", f"{path}/checkpoint", as_of)
    return out.select([settled(c).alias(c) if c.startswith(("total_", "mean_")) else F.col(c) for c in out.columns])


# -- 4: a few keys holding most rows -------------------------------------------------------------------------
@query(
    """SELECT article_id FROM transactions_train WHERE article_id IS NOT NULL GROUP BY 1
    HAVING count(*) * 100 >= (SELECT count(article_id) FROM transactions_train)"""
)
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    sales = key_states(table(spark, d, "transactions_train"), "article_id")
    known = key_states(table(spark, d, "articles"), "article_id")
    per = materialize(eager_join(sales, known, "article_id", "left").select("article_id", "n_left"), "hot-keys")
    total = per.agg(F.sum("n_left")).first()[0] or 0
    return per.where(F.col("n_left") * 100 >= total).select("article_id")


@query(
    """WITH s AS (SELECT article_id, count(*) AS n, count(DISTINCT customer_id) AS customers, sum(price) AS total, max(t_dat) AS last_day
                  FROM transactions_train WHERE article_id IS NOT NULL GROUP BY 1),
    t AS (SELECT article_id, count(*) AS n FROM documents WHERE article_id IS NOT NULL GROUP BY 1)
    SELECT s.article_id, s.n AS sales_rows, customers, round(coalesce(total, 0)::DOUBLE + 1e-9, 6) AS price_total, last_day,
           coalesce(t.n, 0) AS documents, s.n * coalesce(t.n, 1) AS joined_rows,
           round(coalesce(total, 0)::DOUBLE * coalesce(t.n, 1) + 1e-9, 6) AS joined_price_total
    FROM s LEFT JOIN t ON s.article_id = t.article_id"""
)
def p4_article_totals(spark: SparkSession, d: str) -> DataFrame:
    """Rows, customers, price totals and last day of every article, alone and joined with its documents."""
    sales = key_states(table(spark, d, "transactions_train"), "article_id", sums=["price"], maxes=["t_dat"], distinct="customer_id")
    texts = key_states(table(spark, d, "documents"), "article_id")
    joined = eager_join(sales.withColumn("s_price", F.coalesce(F.col("s_price").cast("double"), F.lit(0.0))), texts, "article_id", "left")
    single = F.col("left_s_price") / F.coalesce("n_right", F.lit(1))
    return joined.select(
        "article_id", F.col("n_left").alias("sales_rows"), F.col("left_d").alias("customers"), settled(single).alias("price_total"), F.col("left_m_t_dat").alias("last_day"),
        F.coalesce("n_right", F.lit(0)).alias("documents"), F.col("rows").alias("joined_rows"), settled("left_s_price").alias("joined_price_total"),
    )


@query(
    """SELECT coalesce(lower(trim(d.source)), 'unknown') AS source, count(*) AS joined_rows, round(sum(t.price)::DOUBLE + 1e-9, 6) AS price_total,
    sum(d.n_chars)::BIGINT AS chars, max(t.t_dat) AS last_day
    FROM transactions_train t JOIN documents d ON t.article_id = d.article_id GROUP BY 1"""
)
def p4_join_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Sales joined with documents of the same article, totalled by source, without the joined rows (a tenth times a tenth)."""
    sales = key_states(table(spark, d, "transactions_train"), "article_id", sums=["price"], maxes=["t_dat"])
    docs = table(spark, d, "documents").withColumn("source", F.coalesce(F.lower(F.trim("source")), F.lit("unknown")))
    texts = key_states(docs, "article_id", sums=["n_chars"], also=["source"])
    joined = eager_join(sales.withColumn("s_price", F.col("s_price").cast("double")), texts, "article_id", by=["source"])
    out = roll_up(joined, ["source"])
    return out.select("source", F.col("rows").alias("joined_rows"), settled("left_s_price").alias("price_total"), F.col("right_s_n_chars").alias("chars"), F.col("left_m_t_dat").alias("last_day"))


# -- 5: trailing periods -------------------------------------------------------------------------------------
ROLLING_SQL = """
WITH span AS (SELECT min(t_dat) AS lo, max(t_dat) AS hi FROM transactions_train),
daily AS (SELECT article_id, t_dat, count(*) AS n, count(price) AS v, sum(price::DOUBLE) AS s FROM transactions_train
          WHERE article_id IS NOT NULL AND t_dat IS NOT NULL GROUP BY 1, 2),
reach AS (SELECT article_id, t_dat + CAST(a AS INTEGER) AS day, a, n, v, s FROM daily, range(30) r(a), span WHERE t_dat + CAST(a AS INTEGER) <= hi),
totals AS (SELECT article_id, day, sum(n) AS n30, sum(v) AS v30, sum(s) AS s30, sum(n) FILTER (a < 7) AS n7, sum(v) FILTER (a < 7) AS v7, sum(s) FILTER (a < 7) AS s7 FROM reach GROUP BY 1, 2),
grid AS (SELECT e.article_id, CAST(u AS DATE) AS day FROM ({entities}) e, (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS u FROM span))
"""


@query(
    ROLLING_SQL.format(entities="SELECT DISTINCT article_id FROM panel_articles WHERE article_id IS NOT NULL")
    + """SELECT article_id, strftime(day, '%Y-%m-%d') AS day_iso FROM grid JOIN totals USING (article_id, day) WHERE n30 >= 3 AND coalesce(n7, 0) = 0"""
)
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    panel = table(spark, d, "panel_articles")
    out = trailing_totals(table(spark, d, "transactions_train"), "article_id", "t_dat", "price", entities=panel)
    out = out.where((F.col("rows_30") >= 3) & (F.col("rows_7") == 0))
    return out.select("article_id", F.date_format("t_dat", "yyyy-MM-dd").alias("day_iso"))


@query(
    ROLLING_SQL.format(entities="SELECT DISTINCT article_id FROM daily")
    + """SELECT article_id, day AS t_dat, coalesce(n7, 0)::BIGINT AS rows_7, round(coalesce(s7, 0) + 1e-9, 6) AS total_7, round(s7 / nullif(v7, 0) + 1e-9, 6) AS mean_7,
    coalesce(n30, 0)::BIGINT AS rows_30, round(coalesce(s30, 0) + 1e-9, 6) AS total_30, round(s30 / nullif(v30, 0) + 1e-9, 6) AS mean_30
    FROM grid LEFT JOIN totals USING (article_id, day)"""
)
def p5_rolling(spark: SparkSession, d: str) -> DataFrame:
    out = trailing_totals(table(spark, d, "transactions_train"), "article_id", "t_dat", "price")
    return out.select([settled(c).alias(c) if c.startswith(("total_", "mean_")) else F.col(c) for c in out.columns])


# -- 6: rows that fail to parse ------------------------------------------------------------------------------
PARSE_SQL = r"""
WITH lines AS (SELECT raw_id, regexp_replace(coalesce(raw_line, ''), '\r\z', '') AS line FROM raw_transactions),
quoted AS (SELECT raw_id, line, regexp_full_match(line, '(?s)("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*') AS fine FROM lines),
fields AS (SELECT raw_id, fine, CASE WHEN fine THEN list_transform(regexp_extract_all(',' || line, '(?s),("([^"]|"")*"|[^",]*)', 1),
  lambda x: CASE WHEN x[1] = '"' THEN replace(x[2:len(x) - 1], '""', '"') ELSE x END) END AS f FROM quoted),
judged AS (SELECT raw_id, f, CASE WHEN NOT fine THEN 'quoting' WHEN len(f) <> 5 THEN 'column_count'
  WHEN NOT regexp_full_match(f[1], '[0-9]{4}-[0-9]{2}-[0-9]{2}') OR f[1][1:4] = '0000' OR TRY_CAST(f[1] AS DATE) IS NULL THEN 't_dat'
  WHEN NOT regexp_full_match(f[2], '[0-9a-f]{64}') THEN 'customer_id' WHEN NOT regexp_full_match(f[3], '[0-9]{10}') THEN 'article_id'
  WHEN NOT regexp_full_match(f[4], '[0-9]+(\.[0-9]+)?') THEN 'price' WHEN f[5] NOT IN ('1', '2') THEN 'sales_channel_id' END AS reason FROM fields)
"""


@query(PARSE_SQL + "SELECT raw_id, reason FROM judged WHERE reason IS NOT NULL")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return parse_transactions(table(spark, d, "raw_transactions")).where(F.col("reason").isNotNull()).select("raw_id", "reason")


@query(
    PARSE_SQL
    + """SELECT raw_id, CAST(f[1] AS DATE) AS t_dat, f[2] AS customer_id, f[3] AS article_id, TRY_CAST(f[4] AS DECIMAL(18, 12)) AS price,
    CAST(f[5] AS INTEGER) AS sales_channel_id FROM judged WHERE reason IS NULL"""
)
def p6_valid(spark: SparkSession, d: str) -> DataFrame:
    return parse_transactions(table(spark, d, "raw_transactions")).where(F.col("reason").isNull()).drop("reason")
