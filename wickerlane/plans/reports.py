"""Registered plans: contracts, descriptive reports, article content, submissions and file round trips."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wickerlane.functions.text import settled
from wickerlane.operators import content as ct
from wickerlane.operators import eda, submission, temporal
from wickerlane.operators import validate as vd
from wickerlane.plans import recommend
from wickerlane.plans.base import query
from wickerlane.plans.fixtures import CUT, K, SPLIT, all_candidates, sql, targets, tx
from wickerlane.sources.tables import ARTICLE_COLUMNS, read_text_csv, table
from wickerlane.workspace import scratch

D, S = DataFrame, SparkSession

# -- contracts -------------------------------------------------------------------------------------------------
_ID = {"customer_id": "[0-9a-f]{64}", "article_id": "[0-9]{10}"}


def _contract_sql(c: vd.Contract, relation: str) -> str:
    blank = lambda x: f"({x} IS NULL OR {x}::VARCHAR = '')"
    bad = {x: f"NOT regexp_full_match({x}, '{_ID[x]}')" for x in (*c.customer_ids, *c.article_ids)}
    bad |= {x: f"TRY_CAST({x}::VARCHAR AS DATE) IS NULL" for x in c.dates} | {x: f"(TRY_CAST({x}::VARCHAR AS DECIMAL(38, 12)) IS NULL OR {x} < 0)" for x in c.decimals}
    bad |= {x: f"{x}::VARCHAR NOT IN ({', '.join(repr(v) for v in vs)})" for x, vs in c.allowed.items()}
    rows = [("", "rows", "count(*)")] + [(x, "blank", f"count(*) FILTER ({blank(x)})") for x in c.required] + [(x, "invalid", f"count(*) FILTER (NOT {blank(x)} AND {b})") for x, b in bad.items()]
    for x in c.unique:
        rows += [(x, "distinct", f"count(DISTINCT {x})"), (x, "repeated", f"count(*) FILTER (NOT {blank(x)}) - count(DISTINCT {x}) FILTER (NOT {blank(x)})")]
    return " UNION ALL ".join(f"SELECT '{c.name}' AS relation, '{x}' AS \"column\", '{m}' AS measure, {e} AS value FROM {relation}" for x, m, e in rows)


@query(_contract_sql(vd.TRANSACTIONS, "transactions_train"))
def B6_transaction_contract(spark: S, d: str) -> D:
    return vd.validate(table(spark, d, "transactions_train"), vd.TRANSACTIONS)


_SAMPLE = "(SELECT customer_id, '0000000001 0000000002' AS prediction FROM customers) sample_"
_RELATIONS = ((vd.TRANSACTIONS, "transactions_train"), (vd.ARTICLES, "articles"), (vd.CUSTOMERS, "customers"), (vd.SAMPLE_SUBMISSION, _SAMPLE), (vd.IMAGES, "article_images"))


@query(" UNION ALL ".join(_contract_sql(c, r) for c, r in _RELATIONS))
def B7_dataset_contract(spark: S, d: str) -> D:
    """All files of the data set: the log, articles, customers, a sample submission of every customer, and the image inventory."""
    out = None
    for contract, relation in _RELATIONS:
        rows = table(spark, d, "customers").select("customer_id", F.lit("0000000001 0000000002").alias("prediction")) if relation is _SAMPLE else table(spark, d, relation)
        one = vd.validate(rows, contract)
        out = one if out is None else out.unionByName(one)
    return out


@query(
    """WITH e AS (SELECT tx_seq, 'sales_channel_id' AS "column", sales_channel_id::VARCHAR AS value FROM transactions_train WHERE sales_channel_id NOT IN (1, 2)
    UNION ALL SELECT tx_seq, 'price', price::VARCHAR FROM transactions_train WHERE price < 0)
    SELECT "column", value, row_number() OVER (PARTITION BY "column" ORDER BY tx_seq, value) AS rank FROM e QUALIFY rank <= 5"""
)
def B6_examples(spark: S, d: str) -> D:
    return vd.examples(table(spark, d, "transactions_train"), vd.TRANSACTIONS, "tx_seq")


# -- submissions -----------------------------------------------------------------------------------------------
FINAL = temporal.Split(dt.date(2024, 1, 1), 7)
_ALL = "SELECT DISTINCT customer_id FROM customers"
_TEXT = "SELECT c.customer_id, coalesce(string_agg(m.article_id, ' ' ORDER BY m.pos), '') AS prediction FROM (SELECT DISTINCT customer_id FROM customers) c LEFT JOIN {m} m USING (customer_id) GROUP BY 1"


def _everyone(spark: S, d: str) -> D:
    return table(spark, d, "customers").select("customer_id").distinct()


def _final(spark: S, d: str) -> D:
    t, who = tx(spark, d), _everyone(spark, d)
    return submission.as_text(submission.baseline_predictions(t, submission.final_cutoff(t), who, K), who)


@query(sql(_TEXT.format(m="merged"), FINAL, targets=_ALL))
def J23_baseline_submission(spark: S, d: str) -> D:
    """The day after the last of the log is the cutoff; it is 2024-01-01 in the given tables."""
    return _final(spark, d)


@query(sql(_TEXT.format(m="merged"), targets="SELECT DISTINCT customer_id FROM found SEMI JOIN customers USING (customer_id)"))
def A8_submission_rows(spark: S, d: str) -> D:
    return submission.as_text(recommend.baseline(spark, d), _everyone(spark, d))


@query(
    sql(
        """SELECT unnest(['rows', 'malformed', 'unknown_customers', 'repeated_customers', 'missing_customers', 'too_many', 'too_few', 'repeated_articles', 'unknown_articles']) AS measure,
        unnest([(SELECT count(*) FROM rows_), 0, 0, 0, (SELECT count(*) FROM customers) - (SELECT count(*) FROM rows_), 0, (SELECT count(*) FROM rows_ WHERE len(string_split(prediction, ' ')) < 12), 0,
          (SELECT count(*) FROM (SELECT unnest(string_split(prediction, ' ')) AS article_id FROM rows_) WHERE article_id <> '' AND article_id NOT IN (SELECT article_id FROM articles))]) AS value""",
        rows_="SELECT c.customer_id, coalesce(string_agg(m.article_id, ' ' ORDER BY m.pos), '') AS prediction FROM targets c LEFT JOIN merged m USING (customer_id) GROUP BY 1",
    )
)
def B8_submission_validation(spark: S, d: str) -> D:
    rows = submission.as_text(recommend.baseline(spark, d), targets(spark, d))
    out = vd.validate_submission(rows, table(spark, d, "customers"), table(spark, d, "articles"), K)
    return out.withColumn("value", F.col("value").cast("bigint"))


@query(
    sql(
        "SELECT count(*) AS customers, count(*) FILTER (n > 0) AS with_any, count(*) FILTER (n >= 12) AS with_k, sum(n)::BIGINT AS rows, sum(n - a)::BIGINT AS repeated_rows, (SELECT count(DISTINCT article_id) FROM merged) AS articles FROM (SELECT customer_id, count(m.article_id) AS n, count(DISTINCT m.article_id) AS a FROM targets LEFT JOIN merged m USING (customer_id) GROUP BY 1)",
        FINAL,
        targets=_ALL,
    )
)
def L11_submission_shape(spark: S, d: str) -> D:
    from wickerlane.operators import metrics

    t, who = tx(spark, d), _everyone(spark, d)
    return metrics.coverage(submission.baseline_predictions(t, submission.final_cutoff(t), who, K), who, K)


@query(sql("SELECT customer_id, article_id, source, source_rank, round(source_score + 1e-9, 4) AS source_score, 0.0::DOUBLE AS two_tower_score, 0.0::DOUBLE AS content_user_cosine FROM candidates"))
def A7_candidate_csv(spark: S, d: str) -> D:
    """Written as CSV with ten significant digits and read back under header checks (A6)."""
    path = scratch(spark, "candidates-csv")
    submission.write_candidates(all_candidates(spark, d), path)
    return submission.read_candidates(spark, path).withColumn("source_score", settled("source_score", 4))


@query("SELECT " + ", ".join(f"coalesce({c}, '') AS {c}" for c in ARTICLE_COLUMNS) + " FROM articles")
def A1_csv_scan(spark: S, d: str) -> D:
    """The articles written as CSV and scanned again as strings."""
    path = scratch(spark, "articles-csv")
    table(spark, d, "articles").select(*[F.coalesce(c, F.lit("")).alias(c) for c in ARTICLE_COLUMNS]).write.csv(path, header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return read_text_csv(spark, path, ARTICLE_COLUMNS)


# -- article content -------------------------------------------------------------------------------------------
def _field(f: str) -> str:
    return f"coalesce(trim(regexp_replace({f}, '\\s+', ' ', 'g')), '')"


_PARTS = ", ".join(f"CASE WHEN {f} <> '' THEN '{f.replace('_', ' ')}: ' || {f} END" for f in ct.TEXT_FIELDS)
CONTENT_SQL = f"""SELECT article_id, {', '.join(ct.TEXT_FIELDS)}, image_exists, concat_ws(' | ', {_PARTS}) AS combined_text,
  CASE WHEN image_exists THEN 'images/' || article_id[1:3] || '/' || article_id || '.jpg' ELSE '' END AS image_relative_path
  FROM (SELECT a.article_id, {', '.join(f"{_field('a.' + f)} AS {f}" for f in ct.TEXT_FIELDS)}, coalesce(i.there, false) AS image_exists FROM articles a
  LEFT JOIN (SELECT article_id, bool_or(coalesce(image_exists, false)) AS there FROM article_images GROUP BY 1) i USING (article_id))"""


def _content(spark: S, d: str) -> D:
    return ct.content(table(spark, d, "articles"), table(spark, d, "article_images").select("article_id", F.col("image_exists").alias("there")))


@query(CONTENT_SQL)
def A13_article_content(spark: S, d: str) -> D:
    return _content(spark, d)


@query(sql("SELECT article_id, row_number() OVER (ORDER BY n DESC, last_day DESC, article_id) AS rank FROM (SELECT article_id, count(*) AS n, max(t_dat) AS last_day FROM past GROUP BY 1) QUALIFY rank <= 500"))
def D28_article_priority(spark: S, d: str) -> D:
    return ct.priority(tx(spark, d), CUT, 500)


@query(
    """WITH p AS (SELECT DISTINCT image_relative_path AS path FROM article_images WHERE coalesce(image_relative_path, '') <> ''),
    c AS (SELECT path, regexp_extract(path, '^images/[0-9]{3}/([0-9]{10})\\.jpg$', 1) AS article_id FROM p),
    ok AS (SELECT * FROM c WHERE article_id <> '' AND path = 'images/' || article_id[1:3] || '/' || article_id || '.jpg'),
    a AS (SELECT DISTINCT article_id FROM articles)
    SELECT a.article_id, ok.path, CASE WHEN ok.path IS NULL THEN 'missing' ELSE 'matched' END AS state FROM a LEFT JOIN ok USING (article_id)
    UNION ALL SELECT article_id, path, 'extra' FROM ok ANTI JOIN a USING (article_id) UNION ALL SELECT NULL, path, 'misplaced' FROM p ANTI JOIN ok USING (path)"""
)
def A12_image_inventory(spark: S, d: str) -> D:
    return ct.image_inventory(table(spark, d, "article_images").select(F.col("image_relative_path").alias("path")), table(spark, d, "articles"))


@query(
    f"""WITH w AS (SELECT article_id, unnest(string_split_regex(trim(lower(combined_text)), '\\s+')) AS word FROM ({CONTENT_SQL}) WHERE combined_text <> ''),
    h AS (SELECT article_id, ('0x' || md5(word)[1:8])::BIGINT AS h FROM w), c AS (SELECT article_id, h % 64 AS i, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS v FROM h GROUP BY 1, 2)
    SELECT article_id, 64::BIGINT AS dim, round(sum(v * (i + 1)) / coalesce(nullif(sqrt(sum(v * v)), 0), 1) + 1e-9, 5) AS weighted FROM c GROUP BY 1"""
)
def A10_embedding_cache(spark: S, d: str) -> D:
    """Hashed embeddings of the prompts, written as a cache with its manifest and read back under checks (A9, A11)."""
    path, rows = scratch(spark, "embeddings"), _content(spark, d)
    ct.write_cache(ct.generate_embeddings(rows), rows.count(), path, "hashed-words")
    weighted = F.aggregate(F.transform("vec", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    return ct.read_cache(spark, path)[0].select("article_id", F.size("vec").cast("bigint").alias("dim"), settled(weighted, 5).alias("weighted"))


# -- descriptive reports ---------------------------------------------------------------------------------------
@query(sql("SELECT strftime(t_dat, '%Y-%m') AS month, count(*) AS rows, count(DISTINCT customer_id) AS customers, count(DISTINCT article_id) AS articles FROM tx GROUP BY 1"))
def D17_months(spark: S, d: str) -> D:
    return eda.months(tx(spark, d))


@query(sql("SELECT CAST(isodow(t_dat) - 1 AS INTEGER) AS weekday, count(*) AS rows FROM tx GROUP BY 1"))
def D17_weekdays(spark: S, d: str) -> D:
    return eda.weekdays(tx(spark, d))


@query(sql("SELECT t_dat, count(*) AS rows FROM tx GROUP BY 1 ORDER BY rows DESC, t_dat LIMIT 30"))
def D17_busiest_days(spark: S, d: str) -> D:
    return eda.busiest_days(tx(spark, d))


@query(sql("SELECT CASE WHEN s >= 0.8 THEN 'online' WHEN s <= 0.2 THEN 'store' ELSE 'mixed' END AS kind, count(*) AS customers FROM (SELECT avg((sales_channel_id = 2)::INTEGER) AS s FROM tx GROUP BY customer_id) WHERE s IS NOT NULL GROUP BY 1"))
def D18_channels(spark: S, d: str) -> D:
    return eda.channels(tx(spark, d))


@query(sql("SELECT CASE WHEN n <= 0 THEN 'cold' WHEN n <= 4 THEN 'sparse' ELSE 'dense' END AS kind, count(*) AS customers, sum(n)::BIGINT AS rows FROM (SELECT c.customer_id, count(p.seq) AS n FROM (SELECT DISTINCT customer_id FROM customers) c LEFT JOIN past p USING (customer_id) GROUP BY 1) GROUP BY 1"))
def D19_history_depth(spark: S, d: str) -> D:
    return eda.depth(temporal.before(tx(spark, d), CUT), table(spark, d, "customers"))


LEVELS = ["index_group_name", "index_name", "section_name", "department_name", "garment_group_name", "product_group_name", "product_type_name"]


@query(
    "WITH v AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", coalesce({c}, '') AS value FROM articles" for c in LEVELS)
    + """), n AS (SELECT "column", value, count(*) AS n FROM v GROUP BY 1, 2)
    SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank, count(*) OVER (PARTITION BY "column") AS distinct_values FROM n QUALIFY rank <= 20"""
)
def D20_hierarchy(spark: S, d: str) -> D:
    return eda.hierarchy(table(spark, d, "articles"), LEVELS)


@query(sql("SELECT article_id, CAST(max(t_dat) - min(t_dat) + 1 AS INTEGER) AS days, count(*) AS rows FROM tx GROUP BY 1"))
def D20_article_lifetimes(spark: S, d: str) -> D:
    return eda.article_lifetimes(tx(spark, d))


@query(sql("SELECT count(*) AS pairs, count(*) FILTER (n > 1) AS repeated_pairs, sum(n)::BIGINT AS rows, max(n) AS most FROM (SELECT count(*) AS n FROM tx GROUP BY customer_id, article_id)"))
def D21_repeat_purchases(spark: S, d: str) -> D:
    return eda.repeat_purchases(tx(spark, d))


@query(
    sql("""SELECT CASE WHEN g <= 2 THEN '0-2' WHEN g <= 7 THEN '3-7' ELSE '8-14' END AS gap, count(*) AS rows FROM
    (SELECT t_dat - lag(t_dat) OVER (PARTITION BY customer_id, article_id ORDER BY seq) AS g FROM tx) WHERE g BETWEEN 0 AND 14 GROUP BY 1""")
)
def D22_purchase_gaps(spark: S, d: str) -> D:
    return eda.gaps(tx(spark, d))


@query(sql("SELECT seq, CAST(t_dat - lag(t_dat) OVER (PARTITION BY customer_id, article_id ORDER BY seq) AS INTEGER) AS gap FROM tx QUALIFY gap IS NOT NULL"))
def E17_previous_purchase(spark: S, d: str) -> D:
    from pyspark.sql import Window

    last = F.lag("t_dat").over(Window.partitionBy("customer_id", "article_id").orderBy("seq"))
    return tx(spark, d).select("seq", F.datediff("t_dat", last).alias("gap")).where(F.col("gap").isNotNull())


_AGE = "TRY_CAST(trim(age) AS DOUBLE)"
_BUCKETS = " ".join(f"WHEN {_AGE} < {high} THEN '{low}-{high - 1}'" for low, high in ((0, 18), (18, 25), (25, 35), (35, 45), (45, 55), (55, 65), (65, 75)))


@query(
    f"""SELECT 'age' AS "column", CASE WHEN {_AGE} IS NULL OR {_AGE} <= 0 THEN 'missing' {_BUCKETS} ELSE '75+' END AS value, count(*) AS n FROM customers GROUP BY 1, 2"""
    + "".join(
        f" UNION ALL SELECT '{c}', coalesce(nullif(trim({c}), ''), 'missing'), count(*) FROM customers GROUP BY 1, 2" for c in ("fn", "active", "club_member_status", "fashion_news_frequency")
    )
)
def D23_customer_metadata(spark: S, d: str) -> D:
    return eda.customer_metadata(table(spark, d, "customers"))


@query(sql("SELECT 'rows' AS measure, count(*) AS value FROM tx UNION ALL SELECT 'customers', count(DISTINCT customer_id) FROM tx UNION ALL SELECT 'articles', count(DISTINCT article_id) FROM tx UNION ALL SELECT 'days', count(DISTINCT t_dat) FROM tx UNION ALL SELECT 'labels', count(*) FROM found"))
def L12_log_summary(spark: S, d: str) -> D:
    t = tx(spark, d)
    one = t.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("customer_id").alias("customers"), F.count_distinct("article_id").alias("articles"), F.count_distinct("t_dat").alias("days"))
    labels = temporal.labels(t, SPLIT).agg(F.count(F.lit(1)).alias("labels"))
    both = one.join(F.broadcast(labels), F.lit(True))
    return both.select(F.inline(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("value")) for c in both.columns])))
