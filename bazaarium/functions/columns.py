"""Column expressions. All are Spark built-ins, so they stay in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000

# Kept bits of a value's magnitude in magnitude_bucket().
_BUCKET_BITS = 12


def elapsed_micros(start: Column, end: Column) -> Column:
    """Exact elapsed time between zoneless timestamps, as a whole number.

    The interval is taken apart because `timestampdiff` would first place both
    times in the session's zone, where clock changes move or lengthen some hours.
    """
    gap = end - start
    parts = {"DAY": MICROS_PER_DAY, "HOUR": 3_600_000_000, "MINUTE": 60_000_000, "SECOND": 1_000_000}
    pieces = [F.extract(F.lit(part), gap) * F.lit(size).cast("bigint") for part, size in parts.items()]
    return reduce(Column.__add__, [piece.cast("bigint") for piece in pieces])


def elapsed_days(start: Column, end: Column) -> Column:
    return elapsed_micros(start, end) / F.lit(float(MICROS_PER_DAY))


def whole_days(start: Column, end: Column) -> Column:
    return F.floor(elapsed_micros(start, end) / F.lit(MICROS_PER_DAY)).cast("bigint")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division, null when the denominator is zero or null.

    Both sides go to double first: decimal division would round to a few places.
    """
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def flag(condition: Column) -> Column:
    """Three-valued 0/1: an unknown condition stays null."""
    return condition.cast("int")


def sure_flag(condition: Column) -> Column:
    """Two-valued 0/1: an unknown condition counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def month_key(moment: Column) -> Column:
    """`YYYY-MM` of a zoneless timestamp or date; formatting it would involve a zone."""
    return F.substring(moment.cast("string"), 1, 7)


def month_start(key: Column) -> Column:
    """First day of a `YYYY-MM[-..]` text key; blank and null give null."""
    text = F.nullif(F.trim(key), F.lit(""))
    return F.to_date(F.concat(F.substring(text, 1, 7), F.lit("-01")), "yyyy-MM-dd")


def month_index(key: Column) -> Column:
    """Months since year 0, so that differences count calendar months."""
    year = F.substring(key, 1, 4).cast("int")
    month = F.substring(key, 6, 2).cast("int")
    return year * 12 + month


def cents(money: str) -> str:
    """SQL for a two-decimal amount as a whole number, for exact ranking."""
    return f"CAST({money} * 100 AS BIGINT)"


def magnitude_bucket(units: str) -> Column:
    """Monotone, data-independent bucket of a whole number, given as SQL.

    The value is cut to its leading bits, like a short floating-point number, so
    there are at most about 210,000 buckets whatever the data, and a bucket spans
    less than 1/2048 of its values. It depends on the value alone: a recomputed
    task puts every row into the same bucket again.
    """
    cut = f"greatest(length(bin(abs({units}))) - {_BUCKET_BITS}, 0)"
    return F.expr(
        f"CAST(signum({units}) AS BIGINT)"
        f" * ({cut} * {1 << _BUCKET_BITS} + shiftright(abs({units}), {cut}))"
    )
