"""Small column helpers shared by the operators."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColumnOrName = Column | str

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
TEMPORAL_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def as_column(c: ColumnOrName) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def is_numeric(data_type: T.DataType) -> bool:
    """Booleans count as numbers, as in a pandas dtype check."""
    return isinstance(data_type, (*NUMERIC_TYPES, T.BooleanType))


def is_temporal(data_type: T.DataType) -> bool:
    return isinstance(data_type, TEMPORAL_TYPES)


def money(c: ColumnOrName) -> Column:
    """Cents-exact amount: sums do not depend on the partitioning."""
    return as_column(c).cast("decimal(18,2)")


def money_sum(c: ColumnOrName) -> Column:
    return F.sum(money(c)).cast("double")


def money_avg(c: ColumnOrName) -> Column:
    return F.try_divide(F.sum(money(c)).cast("double"), F.count(as_column(c)))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """``part`` as a percentage of ``whole``, 0 when ``whole`` is 0."""
    ratio = F.try_divide(part.cast("double"), whole.cast("double")) * 100
    return F.coalesce(F.round(ratio, digits), F.lit(0.0))


def stable_round(c: ColumnOrName, digits: int) -> Column:
    """Half-up rounding that ignores noise beyond the sixth decimal.

    Values too large for that many decimals are rounded as they are.
    """
    value = as_column(c)
    exact = F.round(value.try_cast("decimal(20,6)"), digits).cast("double")
    return F.coalesce(exact, F.round(value.cast("double"), digits))


def as_timestamp(c: ColumnOrName, data_type: T.DataType | None = None) -> Column:
    """Wall-clock timestamp; text that does not parse becomes null."""
    col = as_column(c)
    if data_type is not None and is_temporal(data_type):
        return col.cast("timestamp_ntz")
    return F.coalesce(
        col.try_cast("timestamp_ntz"),
        F.try_to_timestamp(col, F.lit("MM/dd/yyyy")).cast("timestamp_ntz"),
        F.try_to_timestamp(col, F.lit("MM/dd/yyyy HH:mm:ss")).cast("timestamp_ntz"),
    )


def as_of_literal(as_of: str | datetime) -> Column:
    text = as_of.isoformat(sep=" ") if isinstance(as_of, datetime) else as_of
    return F.lit(text).cast("timestamp_ntz")


def complete_days(start: Column, end: Column) -> Column:
    """Whole days from ``start`` to ``end``, truncated toward zero."""
    return F.timestamp_diff("DAY", start, end)


def lowered(c: ColumnOrName) -> Column:
    return F.lower(as_column(c).cast("string"))


def contains_any(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.coalesce(text.contains(word), F.lit(False))
    return found
