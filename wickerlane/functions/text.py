"""Column expressions for identifiers, labels and rounded numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CUSTOMER_PATTERN = "^[0-9a-f]{64}$"
ARTICLE_PATTERN = "^[0-9]{10}$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squeezed(c: Column | str) -> Column:
    """White space at the ends dropped, inner runs made one space; null stays null."""
    return F.trim(F.regexp_replace(col(c), r"[ \t]+", " "))


def label(c: Column | str, missing: str = "unknown") -> Column:
    """``squeezed`` with null and empty replaced by ``missing``."""
    s = squeezed(c)
    return F.when(s.isNull() | (s == ""), F.lit(missing)).otherwise(s)


def is_customer_id(c: Column | str) -> Column:
    return F.coalesce(col(c).rlike(CUSTOMER_PATTERN), F.lit(False))


def is_article_id(c: Column | str) -> Column:
    return F.coalesce(col(c).rlike(ARTICLE_PATTERN), F.lit(False))


def settled(c: Column | str, places: int = 6) -> Column:
    """Round a double away from decimal ties, so that engines that differ in the last bit agree."""
    return F.round(col(c).cast("double") + F.lit(1e-9), places)


def ratio(num: Column | str, den: Column | str) -> Column:
    """``num / den`` with 0.0 for a zero or missing denominator (never an ANSI error)."""
    n, d = col(num).cast("double"), col(den).cast("double")
    return F.coalesce(F.when(d != 0, n / d), F.lit(0.0))


def recency_decay(age_days: Column | str, half_life_days: float) -> Column:
    return F.pow(F.lit(0.5), col(age_days).cast("double") / F.lit(float(half_life_days)))


def sigmoid(c: Column | str) -> Column:
    """Logistic function that overflows on neither side."""
    x = col(c)
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def path_of_image(c: Column | str) -> Column:
    return F.concat(F.lit("images/"), F.substring(col(c), 1, 3), F.lit("/"), col(c), F.lit(".jpg"))


def packed_customer(c: Column | str) -> Column:
    """A customer id as bytes, half as long where it is of the pattern; ``unpacked_customer`` gives it back."""
    hexed = F.concat(F.unhex(F.lit("01")), F.unhex(col(c)))
    return F.when(col(c).rlike(r"\A[0-9a-f]{64}\z"), hexed).otherwise(F.concat(F.unhex(F.lit("00")), F.encode(col(c), "UTF-8")))


def unpacked_customer(c: Column | str) -> Column:
    rest = F.expr("substring(`{}`, 2)".format(c))
    return F.when(F.hex(F.substring(col(c), 1, 1)) == "01", F.lower(F.hex(rest))).otherwise(F.decode(rest, "UTF-8"))
