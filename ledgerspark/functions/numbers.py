"""Number parsing and display, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerspark import fixed_values as V
from ledgerspark.functions.text import strip

# plain or scientific decimal number; keeps "5d", "nan" and "inf" out of casts
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _number(text: Column) -> Column:
    bare = strip(text)
    return F.when(bare.rlike(NUMBER), bare)


def to_double(text: Column, default: float | None = 0.0) -> Column:
    """Text to double; blank or malformed text gives the default."""
    return F.coalesce(_number(text).try_cast("double"), F.lit(default).cast("double"))


def to_money(text: Column, default: str | None = "0") -> Column:
    """Text to ``decimal(12,2)``, half-up; blank or malformed gives the default.

    A number that does not fit gives NULL, so that it can be rejected.
    """
    number = _number(text)
    return F.when(number.isNull(), F.lit(default).cast("decimal(12,2)")).otherwise(
        number.try_cast("decimal(12,2)")
    )


def to_int(text: Column, default: int = 0) -> Column:
    """Text to int by way of a double, cutting the fraction off; NULL where it does not fit."""
    number = _number(text)
    return F.when(number.isNull(), F.lit(default)).otherwise(
        number.try_cast("double").try_cast("int")
    )


def int_from_double(value: Column, default: int = 0) -> Column:
    """Double to int, ties to the even neighbour."""
    return F.coalesce(F.bround(value, 0).try_cast("int"), F.lit(default))


def inr_short(amount: Column) -> Column:
    """Amount with lakh / thousand suffix; below a thousand, and negative, in full."""
    value = amount.cast("double")
    return (
        F.when(value >= 100000, F.format_string("₹%.2fL", value / 100000))
        .when(value >= 1000, F.format_string("₹%.1fK", value / 1000))
        .otherwise(inr_full(value))
    )


def grouped(amount: Column) -> Column:
    return F.format_number(amount.cast("double"), 0)


def inr_full(amount: Column) -> Column:
    return F.concat(F.lit("₹"), grouped(amount))


def horizon_days(text: Column) -> Column:
    """``"<n>d"`` to days within the allowed range; anything else is the default."""
    # more than nine digits is beyond the upper limit anyway
    digits = F.regexp_extract(text, r"^0*([0-9]{1,9})d$", 1)
    long = text.rlike(r"^0*[1-9][0-9]{9,}d$")
    clamped = F.greatest(
        F.lit(V.MIN_HORIZON_DAYS),
        F.least(F.lit(V.MAX_HORIZON_DAYS), digits.try_cast("int")),
    )
    return (
        F.when(long, F.lit(V.MAX_HORIZON_DAYS))
        .when(digits != "", clamped)
        .otherwise(F.lit(V.DEFAULT_HORIZON_DAYS))
    )


def iso_date(text: Column) -> Column:
    """``yyyy-M-d`` text to date, NULL when it is not a calendar day."""
    parts = r"^(\d{4})-(\d{1,2})-(\d{1,2})$"
    bare = strip(text)
    padded = F.concat_ws(
        "-",
        F.regexp_extract(bare, parts, 1),
        F.lpad(F.regexp_extract(bare, parts, 2), 2, "0"),
        F.lpad(F.regexp_extract(bare, parts, 3), 2, "0"),
    )
    return F.when(bare.rlike(parts), padded.try_cast("date"))


def days_until(due: Column, as_of: Column) -> Column:
    return F.date_diff(due, as_of)


def mean(total: Column, count: Column) -> Column:
    """Average from an exact decimal sum, as double."""
    return F.when(count > 0, total.cast("double") / count)
