"""Column expressions. All are built-in functions, so they stay inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MICROS = 1_000_000


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a zone-free or zoned timestamp (session zone UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def split_timestamp(ts: Column) -> tuple[Column, Column]:
    """Date and ``HH:mm:ss`` text of a timestamp."""
    return F.to_date(ts), F.date_format(ts, "HH:mm:ss")


def combine_date_time(date: Column, time: Column, not_before: Column | None = None) -> Column:
    """Timestamp from a date and the first eight characters of a time-of-day text.

    The service date is taken as it is, so a departure after midnight lands at the start of that
    same date. Give the scheduled timestamp as ``not_before`` to move a result that is more than
    twelve hours ahead of it to the next day. Text that is no time gives null.
    """
    text = F.concat(date.cast("string"), F.lit(" "), F.substring(time, 1, 8))
    stamp = text.try_cast("timestamp_ntz")
    if not_before is None:
        return stamp
    half_day = F.expr("INTERVAL '12' HOUR")
    rolled = stamp + F.expr("INTERVAL '1' DAY")
    return F.when(stamp < not_before - half_day, rolled).otherwise(stamp)


def cast_columns(df: DataFrame, columns: Sequence[str], to: str) -> DataFrame:
    """One cast for several columns."""
    return df.withColumns({c: F.col(c).cast(to) for c in columns})


def as_flag(c: Column) -> Column:
    """0/1 column to boolean; null stays null."""
    return c == 1


def minutes_between(a: Column, b: Column) -> Column:
    """Absolute difference in minutes."""
    return F.abs(micros(a) - micros(b)) / F.lit(60.0 * MICROS)


def days_relative(day: Column, origin: Column) -> Column:
    """Whole days from ``origin`` to ``day``; negative before it."""
    return F.datediff(day, origin)


def simple_week(day: Column) -> Column:
    """Week counted in sevens from 1 January (not the ISO week)."""
    return (F.floor((F.dayofyear(day) - 1) / 7) + 1).cast("int")


def text_contains(c: Column, needle: str, ignore_case: bool = True) -> Column:
    """Substring test; ``%`` and ``_`` in ``needle`` are wildcards as in LIKE."""
    pattern = f"%{needle}%"
    return c.ilike(pattern) if ignore_case else c.like(pattern)


def between_closed(c: Column, low, high) -> Column:
    """Closed range. On a timestamp, a bare date as ``high`` means midnight at its start, so the
    last day itself is cut; give the next day or a time to keep it."""
    return c.between(F.lit(low), F.lit(high))


def in_interval(ts: Column, start: Column, end: Column) -> Column:
    """Half-open interval test."""
    return (start <= ts) & (ts < end)


def mask_id(df: DataFrame, column: str, salt: str, into: str | None = None) -> DataFrame:
    """Replace an identifier by its salted SHA-256, as an expression: no mapping table, no join."""
    target = into or f"{column}_hash"
    hashed = F.sha2(F.concat(F.lit(salt), F.col(column).cast("string")), 256)
    return df.withColumn(target, hashed).drop(column)


def label_every(position: Column, label: Column, step: int = 20) -> Column:
    """The label where the position is a multiple of ``step``, else null."""
    return F.when(F.pmod(position, F.lit(step)) == 0, label)


def percent_label(rate: Column) -> Column:
    """Rate as percent text, cut after five characters."""
    # Doubles below a thousandth print in exponent form; those are spelled out before the cut.
    percent = rate * 100
    small = (percent != 0) & (F.abs(percent) < 0.001)
    plain = F.when(small, F.format_number(percent, 12)).otherwise(percent.cast("string"))
    return F.concat(F.substring(plain, 1, 5), F.lit("%"))


def ordinal_of(category: Column, levels: Sequence[str]) -> Column:
    """Position of a category in its fixed level order, for sorting; null outside the levels."""
    branches = F.when(category == levels[0], 0)
    for position, level in enumerate(levels[1:], start=1):
        branches = branches.when(category == level, position)
    return branches.cast("int")


def null_if_unknown(test: Column, yes, no) -> Column:
    """Two-way choice that is null where the test is null (SQL CASE would take the else branch)."""
    return F.when(test.isNull(), F.lit(None)).when(test, yes).otherwise(no)
