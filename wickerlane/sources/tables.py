"""Table scans: parquet and CSV under explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRANSACTION_SCHEMA = T.StructType(
    [
        T.StructField("t_dat", T.DateType()),
        T.StructField("customer_id", T.StringType()),
        T.StructField("article_id", T.StringType()),
        T.StructField("price", T.DecimalType(18, 12)),
        T.StructField("sales_channel_id", T.IntegerType()),
    ]
)

# The columns of the articles and customers contracts.
ARTICLE_COLUMNS = (
    "article_id",
    "product_code",
    "prod_name",
    "product_type_no",
    "product_type_name",
    "product_group_name",
    "graphical_appearance_no",
    "graphical_appearance_name",
    "colour_group_code",
    "colour_group_name",
    "perceived_colour_value_id",
    "perceived_colour_value_name",
    "perceived_colour_master_id",
    "perceived_colour_master_name",
    "department_no",
    "department_name",
    "index_code",
    "index_name",
    "index_group_no",
    "index_group_name",
    "section_no",
    "section_name",
    "garment_group_no",
    "garment_group_name",
    "detail_desc",
)
CUSTOMER_COLUMNS = (
    "customer_id",
    "fn",
    "active",
    "club_member_status",
    "fashion_news_frequency",
    "age",
    "postal_code",
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_text_csv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """CSV with a header as strings: blanks become ``""``, a byte-order mark is tolerated, missing columns raise."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', nullValue="\u0000", emptyValue="")
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{path}: missing columns {missing}")
    return df.select([F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])


def transaction_events(df: DataFrame) -> DataFrame:
    """The three columns most operators need; rows without any of them are no events."""
    return df.select("t_dat", "customer_id", "article_id").dropna()
