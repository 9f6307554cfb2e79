"""Formats (value to text) and informats (text to value), for columns and for single values."""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidestep.functions.missing import Missing
from tidestep.functions.types import DATE_EPOCH, DATETIME_EPOCH, days, seconds, to_date, to_datetime

_SPEC = re.compile(r"\s*(\$?)([A-Za-z_]*)(\d*)(?:\.(\d*))?\s*")


@dataclass(frozen=True)
class Spec:
    name: str = ""
    width: int | None = None
    decimals: int | None = None


def parse_spec(text: str | None) -> Spec:
    """``$`` name width ``.`` decimals; what can't be read is the default spec."""
    found = _SPEC.fullmatch(text or "")
    if not found:
        return Spec()
    dollar, name, width, decimals = found.groups()
    return Spec((dollar + name).upper(), int(width) if width else None, int(decimals) if decimals else None)


@dataclass(frozen=True)
class Converter:
    """column(col, spec) and value(v, spec)."""

    column: Callable[[Column, Spec], Column] | None
    value: Callable[[Any, Spec], Any]


_FORMATS: dict[str, Converter] = {}
_INFORMATS: dict[str, Converter] = {}


def _wrapped(f: Callable, kind: str) -> Callable[[Column, Spec], Column]:
    """A Python function of single values as a vectorised function of columns."""

    def column(col: Column, spec: Spec) -> Column:
        @F.pandas_udf(kind)
        def run(values: pd.Series) -> pd.Series:
            return values.map(lambda v: None if v is None or v != v else f(v, spec))

        return run(col)

    return column


def register_format(name: str, value: Callable[[Any, int | None, int | None], str], column: Callable[[Column, Spec], Column] | None = None) -> None:
    """Without a column builder, value(v, width, decimals) runs in vectorised batches."""
    one = lambda v, s: value(v, s.width, s.decimals)
    _FORMATS[name.upper()] = Converter(column or _wrapped(one, "string"), one)


def register_informat(name: str, value: Callable[[str, int | None], Any], column: Callable[[Column, Spec], Column] | None = None, kind: str = "double") -> None:
    one = lambda v, s: value(v, s.width)
    _INFORMATS[name.upper()] = Converter(column or _wrapped(one, kind), one)


def default_column(col: Column, kind: str) -> Column:
    if kind in ("double", "float"):
        return F.when(col == F.floor(col), F.floor(col).cast("bigint").cast("string")).otherwise(col.cast("string"))
    return col.cast("string")


def format_column(col: Column, spec: str | None, kind: str, tag: Column | None = None) -> Column:
    """A column as text; missing as ``.`` with its tag, text missings as an empty text. An unknown name is an error."""
    s = parse_spec(spec)
    if kind == "string" and s.name in ("", "$"):
        blank = F.coalesce(col, F.lit(""))
        return F.rpad(F.substring(blank, 1, s.width), s.width, " ") if s.width and s.name else blank
    text = _FORMATS[s.name].column(col, s) if s.name else default_column(col, kind)
    return F.coalesce(F.when(col.isNotNull(), text), F.concat(F.lit("."), F.coalesce(tag if tag is not None else F.lit(""), F.lit(""))))


def format_value(value: Any, spec: str | None = None) -> str:
    if value is None or isinstance(value, Missing):
        return str(value) if value is not None else "."
    s = parse_spec(spec)
    if s.name:
        return _FORMATS[s.name].value(value, s)
    if isinstance(value, float) and value == int(value):
        return str(int(value))
    return str(value)


def input_column(col: Column, spec: str) -> Column:
    """Text read by an informat; an unknown name leaves the text."""
    s = parse_spec(spec)
    found = _INFORMATS.get(s.name)
    return found.column(col, s) if found else col


def input_value(text: str, spec: str) -> Any:
    s = parse_spec(spec)
    found = _INFORMATS.get(s.name)
    return found.value(text, s) if found else text


_MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")


def _date_text(d: datetime.date) -> str:
    return f"{d.day:02d}{_MONTHS[d.month - 1]}{d.year:04d}"


def _read_date(text: str) -> datetime.date:
    return datetime.date(int(text[5:9]), _MONTHS.index(text[2:5].upper()) + 1, int(text[:2]))


def _datetime_text(v: float) -> str:
    t = DATETIME_EPOCH + datetime.timedelta(seconds=int(v))
    return f"{_date_text(t.date())}:{t:%H:%M:%S}"


def _read_datetime(text: str) -> int:
    h, m, s = (int(text[k : k + 2]) for k in (10, 13, 16))
    return int((datetime.datetime.combine(_read_date(text), datetime.time(h, m, s)) - DATETIME_EPOCH).total_seconds())


def _plain(text: str) -> float:
    return float(text.replace("$", "").replace(",", "").strip())


_FORMATS |= {
    "DOLLAR": Converter(lambda c, s: F.concat(F.lit("$"), F.format_number(c, s.decimals or 0)), lambda v, s: f"${v:,.{s.decimals or 0}f}"),
    "COMMA": Converter(lambda c, s: F.format_number(c, s.decimals or 0), lambda v, s: f"{v:,.{s.decimals or 0}f}"),
    "DATE": Converter(lambda c, s: F.upper(F.date_format(to_date(c), "ddMMMyyyy")), lambda v, s: _date_text(DATE_EPOCH + datetime.timedelta(days=int(v)))),
    "DATETIME": Converter(lambda c, s: F.upper(F.date_format(to_datetime(c), "ddMMMyyyy:HH:mm:ss")), lambda v, s: _datetime_text(v)),
    "$": Converter(lambda c, s: F.rpad(F.substring(c.cast("string"), 1, s.width), s.width, " ") if s.width else c.cast("string"), lambda v, s: str(v)[: s.width].ljust(s.width) if s.width else str(v)),
}
_MONEY = Converter(lambda c, s: F.regexp_replace(c, "[$,]", "").cast("double"), lambda v, s: _plain(v))
_INFORMATS |= {
    "DATE": Converter(lambda c, s: days(F.to_date(F.initcap(F.substring(c, 1, 9)), "ddMMMyyyy")).cast("bigint"), lambda v, s: (_read_date(v) - DATE_EPOCH).days),
    "DATETIME": Converter(lambda c, s: seconds(F.to_timestamp_ntz(F.initcap(F.substring(c, 1, 18)), F.lit("ddMMMyyyy:HH:mm:ss"))).cast("bigint"), lambda v, s: _read_datetime(v)),
    "DOLLAR": _MONEY,
    "COMMA": _MONEY,
}
