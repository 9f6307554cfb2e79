"""Value types: how columns and values are coerced when a variable takes them."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidestep.functions.missing import MISSING, Missing

NUM, CHAR, DECIMAL = "num", "char", "decimal"
DATE_EPOCH, DATETIME_EPOCH = datetime.date(1960, 1, 1), datetime.datetime(1960, 1, 1)


@dataclass(frozen=True)
class TypeHandler:
    """column(col, data type, length) and value(v, length) coerce; either may be None for a type of one world."""

    name: str
    column: Callable[[Column, T.DataType, int | None], Column] | None
    value: Callable[[Any, int | None], Any] | None
    missing: Any
    default_length: int | None


def days(col: Column) -> Column:
    """Days since 1960-01-01 of a date."""
    return F.datediff(col, F.lit(DATE_EPOCH))


def seconds(col: Column) -> Column:
    """Seconds since 1960-01-01T00:00:00 of a timestamp without zone."""
    return F.timestamp_diff("SECOND", F.lit("1960-01-01 00:00:00").cast("timestamp_ntz"), col.cast("timestamp_ntz"))


def to_date(col: Column) -> Column:
    """The date of a day number, whose fraction is cut off towards zero."""
    return F.date_add(F.lit(DATE_EPOCH), col.cast("int"))


def to_datetime(col: Column) -> Column:
    """The timestamp of a second number, whose fraction is cut off towards zero."""
    return F.timestamp_add("SECOND", col.cast("bigint"), F.lit("1960-01-01 00:00:00").cast("timestamp_ntz"))


def num_column(col: Column, kind: T.DataType, length: int | None = None) -> Column:
    if isinstance(kind, T.BooleanType):
        return col.cast("int").cast("bigint")
    if isinstance(kind, T.IntegralType):
        return col.cast("bigint")
    if isinstance(kind, T.DateType):
        return days(col).cast("bigint")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return seconds(col).cast("bigint")
    if isinstance(kind, (T.FractionalType, T.NullType)):
        return col.cast("double")
    return col.cast("string").try_cast("double")


def char_column(col: Column, kind: T.DataType, length: int | None = None) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        col = F.when(col == F.floor(col), F.floor(col).cast("bigint").cast("string")).otherwise(col.cast("string"))
    col = col.cast("string")
    return F.substring(col, 1, length) if length else col


def decimal_column(col: Column, kind: T.DataType, length: int | None = None) -> Column:
    return col if isinstance(kind, T.DecimalType) else col.cast("string").try_cast(T.DecimalType(38, length or 10))


def num_value(v: Any, length: int | None = None) -> Any:
    if v is None or isinstance(v, Missing):
        return v or MISSING
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (int, float)):
        return v
    if isinstance(v, datetime.datetime):
        return int((v.replace(tzinfo=None) - DATETIME_EPOCH).total_seconds())
    if isinstance(v, datetime.date):
        return (v - DATE_EPOCH).days
    try:
        return float(v)
    except (TypeError, ValueError):
        return MISSING


def char_value(v: Any, length: int | None = None) -> Any:
    if v is None:
        return ""
    if isinstance(v, float) and v == int(v):
        v = int(v)
    return str(v)[:length] if length else str(v)


def decimal_value(v: Any, length: int | None = None) -> Any:
    if isinstance(v, (Decimal, Missing)):
        return v
    try:
        return Decimal(str(v))
    except InvalidOperation:
        return MISSING


_HANDLERS: dict[str, TypeHandler] = {}


def register_type(handler: TypeHandler) -> None:
    _HANDLERS[handler.name] = handler


def get_type(name: str) -> TypeHandler:
    return _HANDLERS[name]


def has_type(name: str) -> bool:
    return name in _HANDLERS


def type_names() -> list[str]:
    return sorted(_HANDLERS)


def infer_type(value: Any) -> str:
    """Texts are char, everything else num; registered types are never inferred."""
    return CHAR if isinstance(value, (str, T.StringType)) else NUM


for _h in (TypeHandler(NUM, num_column, num_value, MISSING, 8), TypeHandler(CHAR, char_column, char_value, "", 1), TypeHandler(DECIMAL, decimal_column, decimal_value, MISSING, 16)):
    register_type(_h)
