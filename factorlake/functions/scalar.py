"""Scalar expressions with one rule for missing values: NULL, never NaN or infinity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITE = float("inf")
TICKER = r"^[A-Z]{1,5}(-[A-Z])?$"


def finite(c: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) < INFINITE), c)


def safe_ln(c: Column) -> Column:
    return F.when(c > 0, F.ln(c))


def safe_sqrt(c: Column) -> Column:
    return F.sqrt(F.when(c.isNotNull(), F.greatest(c, F.lit(0.0))))


def clip(c: Column, low: Column | float, high: Column | float) -> Column:
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    return F.when(c.isNotNull(), F.greatest(F.least(c, high), low))


def ratio(a: Column, b: Column) -> Column:
    """a / b; NULL where b is 0 or either is missing."""
    return F.try_divide(a, b)


def positive(c: Column) -> Column:
    return F.when(c > 0, c)


def rounded(c: Column, places: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(c, places) + F.lit(0.0)


def mean_of(*columns: Column) -> Column:
    """Mean of those columns that aren't missing; NULL if all are."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in columns), F.lit(0.0))
    n = sum((c.isNotNull().cast("int") for c in columns), F.lit(0))
    return F.when(n > 0, total / n)


def friday(d: Column) -> Column:
    """The Friday that ends the week of a date; Saturdays and Sundays belong to the next."""
    return F.next_day(F.date_sub(d, 1), "FRI")


def dotless(ticker: Column) -> Column:
    """Share-class points to hyphens, upper case, no blanks around."""
    return F.replace(F.upper(F.trim(ticker)), F.lit("."), F.lit("-"))


def is_ticker(ticker: Column) -> Column:
    return ticker.rlike(TICKER)


def cik_key(cik: Column) -> Column:
    return F.lpad(cik.cast("string"), 10, "0")


def unix_date(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds).cast("date")


def month(d: Column) -> Column:
    return F.trunc(d, "MM")


def months_apart(later: Column, earlier: Column) -> Column:
    return F.months_between(month(later), month(earlier)).cast("int")


def dot(x: Column, y: Column) -> Column:
    """Inner product of two arrays."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def bin_of(c: Column, low: float, high: float, bins: int) -> Column:
    """Bin 1..bins of equal width; values beyond the ends count in the outer bins."""
    edge = (high - low) / bins / 2
    return F.width_bucket(clip(c, low + edge, high - edge), F.lit(low), F.lit(high), F.lit(bins))
