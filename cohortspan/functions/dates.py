"""Calendar-day arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Year, month and day with separators, and possibly a time of day behind; or eight digits.
_SEPARATED = r"^\s*[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([T ].*)?\s*$"
_DIGITS = r"^\s*[0-9]{8}\s*$"


def or_error(value: Column, source: Column, what: str) -> Column:
    """``value``, which must not be null where ``source`` is something: an error in every SQL mode."""
    message = F.concat(F.lit(f"no {what}: "), source.cast("string"))
    return F.when(value.isNull() & source.isNotNull(), F.raise_error(message)).otherwise(value)


def try_date(name: str, kind: T.DataType) -> Column:
    """Column ``name``, which is of type ``kind``, as a date; null where its text spells none.

    A date column is passed through untouched, so filters on it still reach the Parquet scan.
    Timestamps lose their time of day. Text must be year-month-day, with or without a time of day, or ``yyyyMMdd``.
    """
    if isinstance(kind, T.DateType):
        return F.col(name)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.col(name).cast("date")
    text = F.col(name).cast("string")
    return F.when(text.rlike(_SEPARATED), text.try_cast("date")).when(
        text.rlike(_DIGITS), F.try_to_date(F.trim(text), "yyyyMMdd")
    )


def as_date(name: str, kind: T.DataType) -> Column:
    """``try_date``, with other text an error: an event dropped or moved to another day would falsify a report."""
    written = try_date(name, kind)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return written
    return or_error(written, F.col(name).cast("string"), "date")


def days_between(start: Column, end: Column) -> Column:
    """Signed calendar days from ``start`` to ``end`` (negative when ``end`` lies earlier).

    The two-argument ``datediff`` counts midnights; ``timestampdiff(DAY, ...)`` would count full
    24-hour spans instead.
    """
    return F.datediff(end, start)


def closeness(days: Column) -> Column:
    """Integer that orders spans by length, the earlier event first when two are equally long.

    An integer key keeps ``min_by`` in hash aggregation; a struct key would force a sort.
    """
    return 2 * F.abs(days) + (days > 0).cast("int")
