"""Lines that fail to parse, with the reason, beside the typed fields of all others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REASONS = ("quoting", "column_count", "t_dat", "customer_id", "article_id", "price", "sales_channel_id")
SCHEMA = "t_dat date, customer_id string, article_id string, price decimal(18,12), sales_channel_id int, corrupt_ string"
SOUND = r"\A(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2},[0-9a-f]{64},[0-9]{10},[0-9]+(\.[0-9]+)?,[12]\z"


def _without_line_end(c: Column) -> Column:
    return F.when(c.endswith("\r"), F.substring(c, F.lit(1), F.length(c) - 1)).otherwise(c)


def parse_transactions(df: DataFrame, line: str = "raw_line", keep: list[str] = ("raw_id",)) -> DataFrame:
    """``keep``, the five typed fields and ``reason`` (null for a valid line, whose fields alone are set).

    Each line is read permissively under the explicit schema, its text retained where the reader finds it corrupt.
    Those lines, and those of another than the plain form, are then classified: by quotes, by field count, and by a
    cast check per field; the first reason in the order of ``REASONS`` is given. One carriage return at the end
    belongs to the line end, nothing else is trimmed. No regular expression here backtracks, so lines may be of any length.

    Defined cases: a null line counts as an empty one (``column_count``); a price too large for decimal(18,12) is a valid
    record with a null price, further decimal places are rounded; repeated lines each come out; an empty table gives
    an empty result; other columns, whatever their names, are ignored.
    """
    raw = F.coalesce(F.col(f"`{line}`"), F.lit(""))
    rows = df.select(F.struct(*[F.col(f"`{k}`") for k in keep]).alias("kept"), _without_line_end(raw).alias("line"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt_", "dateFormat": "yyyy-MM-dd", "quote": '"', "escape": '"', "maxCharsPerColumn": "-1"}
    # A sound record has four commas. Those after the sixth are masked for the reader, whose columns are limited: it finds
    # the line corrupt all the same, and the checks below see the line as it is.
    commas = F.length("line") - F.length(F.translate("line", ",", ""))
    masked = F.expr("concat_ws(',', transform(split(line, ',', 7), (s, i) -> CASE WHEN i = 6 THEN translate(s, ',', '\u0001') ELSE s END))")
    read = rows.withColumn("read", F.from_csv(F.when(commas <= 6, F.col("line")).otherwise(masked), F.lit(SCHEMA), options))
    plain = F.col("read").isNotNull() & F.col("read.corrupt_").isNull() & F.col("line").rlike(SOUND) & F.col("read.t_dat").isNotNull() & F.col("read.price").isNotNull()
    read = read.withColumn("plain", plain)

    # Between the quotes of a line, the pieces with an even number lie outside of quoted fields.
    pieces = F.split("line", '"', -1)
    wrong = (
        "size(pieces) % 2 = 0 OR exists(transform(pieces, (s, i) -> i % 2 = 0 AND s <> '' AND "
        "((i > 0 AND NOT startswith(s, ',')) OR (i < size(pieces) - 1 AND NOT endswith(s, ',')))), x -> x)"
    )
    # Commas within quotes are masked (no valid field has any), the quotes of doubled ones kept.
    unquoted = (
        "concat_ws('', transform(pieces, (s, i) -> CASE WHEN i % 2 = 1 THEN replace(s, ',', '\\u0001') "
        "WHEN s = '' AND i > 0 AND i < size(pieces) - 1 THEN '\"' ELSE s END))"
    )
    checked = read.withColumn("pieces", F.when(~F.col("plain"), pieces))
    checked = checked.withColumn("wrong", F.expr(wrong)).withColumn("f", F.when(~F.col("plain") & ~F.col("wrong"), F.split(F.expr(unquoted), ",", -1)))
    f = lambda i: F.get(F.col("f"), F.lit(i))
    date = F.when(f(0).rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & ~f(0).startswith("0000"), f(0).try_cast("date"))
    reason = (
        F.when(F.col("plain"), F.lit(None).cast("string"))
        .when(F.col("wrong"), "quoting")
        .when(F.size("f") != 5, "column_count")
        .when(date.isNull(), "t_dat")
        .when(~f(1).rlike(r"\A[0-9a-f]{64}\z"), "customer_id")
        .when(~f(2).rlike(r"\A[0-9]{10}\z"), "article_id")
        .when(~f(3).rlike(r"\A[0-9]+(\.[0-9]+)?\z"), "price")
        .when(~f(4).isin("1", "2"), "sales_channel_id")
    )
    checked = checked.withColumn("reason", reason)
    own = lambda c: F.when(F.col("plain"), F.col(f"read.{c}"))
    ok = F.col("reason").isNull()
    return checked.select(
        "kept.*",
        own("t_dat").when(ok, date).alias("t_dat"),
        own("customer_id").when(ok, f(1)).alias("customer_id"),
        own("article_id").when(ok, f(2)).alias("article_id"),
        own("price").when(ok, f(3).try_cast("decimal(18,12)")).alias("price"),
        own("sales_channel_id").when(ok, f(4).try_cast("int")).alias("sales_channel_id"),
        "reason",
    )
