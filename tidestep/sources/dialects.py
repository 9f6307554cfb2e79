"""Database types of four dialects: what a type code or a type name means for a variable."""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from decimal import Decimal
from typing import Any

from pyspark.sql import types as T

from tidestep.functions.types import CHAR, DECIMAL, NUM

#: Digits that a double holds exactly; more need a decimal.
EXACT_DIGITS = 15
Meaning = tuple[str, int | None, str | None]  # type, length, format
DATE: Meaning = (NUM, 8, "DATE9.")
DATETIME: Meaning = (NUM, 8, "DATETIME19.")
NUMBER: Meaning = (NUM, 8, None)
TEXT: Meaning = (CHAR, None, None)
#: Stands for a type whose meaning depends on its precision.
BY_PRECISION = "by precision"


def numeric(precision: int | None) -> Meaning:
    return (DECIMAL, 16, None) if precision is not None and precision > EXACT_DIGITS else NUMBER


class TypeMap:
    """Type codes of a cursor's description to meanings; unknown codes have none."""

    def __init__(self, entries: dict[Any, Meaning | str | Callable[[Sequence], Meaning]]):
        self.entries = entries

    def resolve(self, description: Sequence) -> Meaning | None:
        found = self.entries.get(description[1])
        if found == BY_PRECISION:
            return numeric(description[4])
        return found(description) if callable(found) else found


@dataclass(frozen=True)
class Dialect:
    name: str
    types: TypeMap
    names: dict[str, Meaning | str]


def _codes(numeric_codes: Sequence, numbers: Sequence, texts: Sequence, dates: Sequence, datetimes: Sequence) -> TypeMap:
    out: dict[Any, Any] = dict.fromkeys(numeric_codes, BY_PRECISION)
    for codes, meaning in ((numbers, NUMBER), (texts, TEXT), (dates, DATE), (datetimes, DATETIME)):
        out |= dict.fromkeys(codes, meaning)
    return TypeMap(out)


def _names(numeric_names: str, numbers: str, texts: str, dates: str, datetimes: str) -> dict[str, Meaning | str]:
    out: dict[str, Meaning | str] = {}
    for names, meaning in ((numeric_names, BY_PRECISION), (numbers, NUMBER), (texts, TEXT), (dates, DATE), (datetimes, DATETIME)):
        out |= {n.strip(): meaning for n in names.split(",")}
    return out


# The drivers' type codes and the databases' type names.
POSTGRESQL = Dialect("postgresql", _codes([1700], [16, 20, 21, 23, 700, 701], [25, 1043], [1082], [1114]), _names("NUMERIC, DECIMAL", "SMALLINT, INTEGER, INT, BIGINT, REAL, DOUBLE PRECISION, BOOLEAN", "VARCHAR, TEXT, CHAR", "DATE", "TIMESTAMP"))
MYSQL = Dialect("mysql", _codes([0, 246], [1, 2, 3, 4, 5, 8], [15, 253, 254], [10], [7, 12]), _names("DECIMAL", "TINYINT, SMALLINT, INT, BIGINT, FLOAT, DOUBLE", "VARCHAR, TEXT, CHAR", "DATE", "DATETIME"))
ORACLE = Dialect("oracle", _codes(["DB_TYPE_NUMBER"], ["DB_TYPE_BINARY_DOUBLE", "DB_TYPE_BINARY_FLOAT"], ["DB_TYPE_VARCHAR", "DB_TYPE_CHAR", "DB_TYPE_NVARCHAR"], ["DB_TYPE_DATE"], ["DB_TYPE_TIMESTAMP"]), _names("NUMBER, FLOAT", "BINARY_DOUBLE, BINARY_FLOAT", "VARCHAR2, NVARCHAR2, CHAR, CLOB", "DATE", "TIMESTAMP"))
SQLSERVER = Dialect("sqlserver", _codes([Decimal], [int, float, bool], [str], [datetime.date], [datetime.datetime]), _names("DECIMAL, NUMERIC, MONEY", "INT, BIGINT, SMALLINT, BIT, FLOAT, REAL", "VARCHAR, NVARCHAR, CHAR", "DATE", "DATETIME2"))
DIALECTS = {d.name: d for d in (POSTGRESQL, MYSQL, ORACLE, SQLSERVER)}


@dataclass(frozen=True)
class Declaration:
    """A declared variable and the Spark type that holds it (none for a registered type, whose coercer decides)."""

    name: str
    stype: str
    length: int | None = None
    fmt: str | None = None
    scale: int | None = None
    precision: int | None = None

    @property
    def data_type(self) -> T.DataType:
        if self.stype == DECIMAL:
            return T.DecimalType(min(38, self.precision or 38), self.scale if self.scale is not None else 10)
        return T.StringType() if self.stype == CHAR else T.DoubleType() if self.stype == NUM else T.NullType()


_TYPE = re.compile(r"\s*([A-Za-z][A-Za-z0-9_ ]*?)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?\s*")


def declare(name: str, type_text: str, dialect: str) -> Declaration:
    """The declaration of a column from its type's name; unknown dialects, types and texts are errors."""
    if dialect.lower() not in DIALECTS:
        raise ValueError(f"unknown dialect {dialect!r}")
    found = _TYPE.fullmatch(type_text)
    if not found:
        raise ValueError(f"can't read the type {type_text!r}")
    base, size, scale = found[1].upper(), found[2] and int(found[2]), found[3] and int(found[3])
    meaning = DIALECTS[dialect.lower()].names.get(base)
    if meaning is None:
        raise ValueError(f"{dialect} type {base} has no meaning here")
    if meaning == BY_PRECISION:
        stype, length, fmt = numeric(size)
        return Declaration(name, stype, length, fmt, scale, size)
    stype, length, fmt = meaning
    return Declaration(name, stype, size if stype == CHAR else length, fmt)
