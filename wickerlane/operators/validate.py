"""File contracts and submissions: counts of what is missing, invalid or repeated, with a few examples."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickerlane.functions.text import ARTICLE_PATTERN, CUSTOMER_PATTERN


@dataclass(frozen=True)
class Contract:
    """What a table must hold; columns beyond ``required`` are tolerated."""

    name: str
    required: tuple[str, ...]
    customer_ids: tuple[str, ...] = ()
    article_ids: tuple[str, ...] = ()
    dates: tuple[str, ...] = ()
    decimals: tuple[str, ...] = ()
    allowed: dict[str, tuple[str, ...]] = field(default_factory=dict)
    unique: tuple[str, ...] = ()
    filled: tuple[str, ...] = ()

    def checks(self) -> dict[str, Column]:
        """Per checked column whether a value that is there is invalid."""
        text = lambda c: F.col(c).cast("string")
        out = {c: ~text(c).rlike(CUSTOMER_PATTERN) for c in self.customer_ids} | {c: ~text(c).rlike(ARTICLE_PATTERN) for c in self.article_ids}
        out |= {c: text(c).try_cast("date").isNull() for c in self.dates}
        out |= {c: text(c).try_cast("decimal(38,12)").isNull() | (text(c).try_cast("decimal(38,12)") < 0) for c in self.decimals}
        return out | {c: ~text(c).isin(*v) for c, v in self.allowed.items()}


# The contracts.
TRANSACTIONS = Contract(
    "transactions", ("t_dat", "customer_id", "article_id", "price", "sales_channel_id"), ("customer_id",), ("article_id",), ("t_dat",), ("price",), {"sales_channel_id": ("1", "2")}, (), ("t_dat", "customer_id", "article_id", "price", "sales_channel_id")
)
ARTICLES = Contract("articles", ("article_id", "product_code", "prod_name"), (), ("article_id",), unique=("article_id",), filled=("article_id",))
CUSTOMERS = Contract("customers", ("customer_id", "fn", "active", "club_member_status", "fashion_news_frequency", "age", "postal_code"), ("customer_id",), unique=("customer_id",), filled=("customer_id",))

SAMPLE_SUBMISSION = Contract("sample_submission", ("customer_id", "prediction"), ("customer_id",), unique=("customer_id",), filled=("customer_id",))
IMAGES = Contract("article_images", ("article_id", "expected_image_relative_path", "image_exists"), (), ("article_id",), allowed={"image_exists": ("true", "false")}, unique=("article_id",), filled=("article_id",))


def _blank(c: str) -> Column:
    return F.col(c).isNull() | (F.col(c).cast("string") == "")


def validate(df: DataFrame, contract: Contract) -> DataFrame:
    """Long rows ``relation, column, measure, value`` from one pass: rows, blanks, invalid values, distinct and repeated keys.

    A required column that is not there is reported as ``missing_column``.
    """
    there = [c for c in contract.required if c in df.columns]
    aggs, names = [F.count(F.lit(1)).alias("m0")], [("", "rows")]

    def add(c: str, measure: str, value: Column) -> None:
        aggs.append(F.coalesce(value, F.lit(0)).cast("bigint").alias(f"m{len(aggs)}"))
        names.append((c, measure))

    for c in there:
        add(c, "blank", F.count_if(_blank(c)))
    for c, bad in contract.checks().items():
        if c in there:
            add(c, "invalid", F.count_if(~_blank(c) & bad))
    for c in contract.unique:
        if c in there:
            add(c, "distinct", F.count_distinct(c))
            add(c, "repeated", F.count(F.when(~_blank(c), 1)) - F.count_distinct(F.when(~_blank(c), F.col(c))))
    for c in contract.required:
        if c not in there:
            add(c, "missing_column", F.lit(1))
    one = df.agg(*aggs)
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(m).alias("measure"), F.col(f"m{i}").alias("value")) for i, (c, m) in enumerate(names)])
    return one.select(F.lit(contract.name).alias("relation"), F.inline(each))


def examples(df: DataFrame, contract: Contract, order: str, most: int = 5) -> DataFrame:
    """Up to ``most`` invalid or blank values per column, the first by ``order``: ``column, value``."""
    bad = contract.checks()
    found = [F.when(F.coalesce(bad.get(c, F.lit(False)), F.lit(False)) & ~_blank(c), F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))) for c in contract.required if c in df.columns]
    rows = df.select(F.col(order).alias("order_"), F.explode(F.array_compact(F.array(*found))).alias("e")).select("order_", "e.*")
    from wickerlane.operators.popularity import top_by

    return top_by(rows, ["column"], most, ("order_", "value")).select("column", "value", "rank")


def failures(report: DataFrame, contract: Contract) -> DataFrame:
    """The rows of a report that break the contract."""
    bad = F.col("measure").isin("invalid", "repeated", "missing_column") | ((F.col("measure") == "blank") & F.col("column").isin(*contract.filled))
    return report.where(bad & (F.col("value") > 0)).unionByName(report.where((F.col("measure") == "rows") & (F.col("value") == 0)))


SUBMISSION_MEASURES = ("rows", "malformed", "unknown_customers", "repeated_customers", "missing_customers", "too_many", "too_few", "repeated_articles", "unknown_articles")


def validate_submission(df: DataFrame, customers: DataFrame, articles: DataFrame, most: int = 12, full: bool = True) -> DataFrame:
    """``measure, value`` counts of a submission ``customer_id, prediction`` (ids joined by spaces).

    Malformed rows have a bad customer id or a prediction with a bad article id; articles are checked against the known
    ones by a join on the exploded ids.
    """
    if most < 1:
        raise ValueError("most must be positive")
    if sorted(df.columns) != ["customer_id", "prediction"]:
        raise ValueError(f"a submission has customer_id and prediction, not {df.columns}")
    ids = F.filter(F.split(F.coalesce("prediction", F.lit("")), " "), lambda x: x != "")
    rows = df.withColumn("ids", ids)
    known = customers.select("customer_id").distinct().withColumn("known", F.lit(1))
    bad_ids = F.exists("ids", lambda x: ~x.rlike(ARTICLE_PATTERN))
    checked = rows.join(known, "customer_id", "left").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.coalesce(~F.col("customer_id").rlike(CUSTOMER_PATTERN), F.lit(True)) | bad_ids).alias("malformed"),
        F.count_if(F.col("known").isNull()).alias("unknown_customers"),
        (F.count(F.lit(1)) - F.count_distinct(F.coalesce("customer_id", F.lit("")))).alias("repeated_customers"),
        F.count_if(F.size("ids") > most).alias("too_many"),
        F.count_if(F.size("ids") < (most if full else 0)).alias("too_few"),
        F.count_if(F.size(F.array_distinct("ids")) < F.size("ids")).alias("repeated_articles"),
    )
    missing = known.join(df.select("customer_id"), "customer_id", "left_anti").agg(F.count(F.lit(1)).alias("missing_customers"))
    strange = rows.select("customer_id", F.explode("ids").alias("article_id")).join(articles.select("article_id").distinct(), "article_id", "left_anti").agg(F.count(F.lit(1)).alias("unknown_articles"))
    one = checked.join(F.broadcast(missing), F.lit(True)).join(F.broadcast(strange), F.lit(True))
    return one.select(F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in SUBMISSION_MEASURES])))
