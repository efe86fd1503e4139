"""Storage bytes of values, by Spark type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT = (T.StringType, T.CharType, T.VarcharType)

# Storage bytes per fixed-width type.
FIXED_WIDTH = {
    T.BooleanType: 1,
    T.ByteType: 1,
    T.ShortType: 2,
    T.IntegerType: 4,
    T.FloatType: 4,
    T.DateType: 4,
    T.YearMonthIntervalType: 4,
    T.LongType: 8,
    T.DoubleType: 8,
    T.TimestampType: 8,
    T.TimestampNTZType: 8,
    T.DayTimeIntervalType: 8,
    T.TimeType: 8,
}


def storage_width(kind: T.DataType) -> int | None:
    """Bytes of a fixed-width value; None for text and nested types."""
    if isinstance(kind, T.DecimalType):
        return 8 if kind.precision <= 18 else 16
    return FIXED_WIDTH.get(type(kind))


def byte_length(col: Column, kind: T.DataType) -> Column:
    """Stored bytes of each value (UTF-8 for text); null for null and for nested types."""
    if isinstance(kind, TEXT):
        return F.octet_length(col).cast("bigint")
    return F.when(col.isNotNull(), F.lit(storage_width(kind)).cast("bigint"))
