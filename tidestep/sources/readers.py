"""Sources of a step: DataFrames with an order, row dictionaries, and database cursors."""

from __future__ import annotations

import datetime
import pickle
import tempfile
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidestep.functions.missing import Missing
from tidestep.functions.types import CHAR, DATE_EPOCH, DATETIME_EPOCH, DECIMAL
from tidestep.sources.dialects import DIALECTS, Declaration


@dataclass(frozen=True)
class Source:
    """Rows in an order: BY columns first, then what breaks ties. flags: columns that tell which inputs gave a merged row."""

    df: DataFrame
    by: tuple[str, ...] = ()
    order_by: tuple[str, ...] = ()
    declarations: tuple[Declaration, ...] = ()
    flags: tuple[str, ...] = ()

    @property
    def order(self) -> list[str]:
        return list(dict.fromkeys([*self.by, *self.order_by]))


def set_source(df: DataFrame, by: Sequence[str] = (), order_by: Sequence[str] = (), declarations: Sequence[Declaration] = ()) -> Source:
    """One observation for each row of a DataFrame."""
    return Source(df, tuple(by), tuple(order_by), tuple(declarations))


def from_dicts(spark: SparkSession, rows: Iterable[dict], order: str = "_obs", chunk: int = 10_000) -> DataFrame:
    """Row dictionaries as a DataFrame with their place in a column; a None row ends the input; absent keys are NULL.

    The schema is that of all rows, whatever the chunk: chunks wait in a temporary file of the
    driver until all names and types are known.
    """
    found: dict[str, set[type]] = {}
    held, n = [], 0

    def plain(v: Any) -> Any:
        return None if isinstance(v, Missing) else v

    def kind(kinds: set[type]) -> T.DataType:
        return T.StringType() if str in kinds else T.DoubleType() if float in kinds else T.DecimalType(38, 10) if Decimal in kinds else T.LongType() if kinds & {int, bool} else T.TimestampNTZType() if datetime.datetime in kinds else T.DateType() if datetime.date in kinds else T.DoubleType()

    with tempfile.TemporaryFile() as spool:
        for r in rows:
            if r is None:
                break
            row = {c: plain(v) for c, v in r.items() if c != order}
            for c, v in row.items():
                found.setdefault(c, set()).update(() if v is None else (type(v),))
            held.append({**row, order: n})
            n += 1
            if len(held) >= chunk:
                pickle.dump(held, spool)
                held = []
        spooled = spool.tell()
        spool.seek(0)
        use = T.StructType([*(T.StructField(c, kind(kinds)) for c, kinds in found.items()), T.StructField(order, T.LongType())])
        convert = {T.StringType(): str, T.DoubleType(): float, T.LongType(): int, T.DecimalType(38, 10): Decimal}

        def frame(part: list[dict]) -> DataFrame:
            data = [tuple(None if r.get(f.name) is None else convert.get(f.dataType, lambda v: v)(r[f.name]) for f in use.fields) for r in part]
            return spark.createDataFrame(data, use)

        out: DataFrame | None = None
        while spool.tell() < spooled:
            part = frame(pickle.load(spool))
            out = part if out is None else out.unionByName(part)
    if held or out is None:
        part = frame(held)
        out = part if out is None else out.unionByName(part)
    return out


@dataclass
class CursorRows:
    """Rows of a PEP 249 cursor as dictionaries, fetched in batches."""

    cursor: Any
    arraysize: int = 500
    columns: list[str] = field(init=False)

    def __post_init__(self) -> None:
        self.columns = [d[0] for d in self.cursor.description]

    def __iter__(self) -> Iterator[dict]:
        while batch := self.cursor.fetchmany(self.arraysize):
            for row in batch:
                yield dict(zip(self.columns, row, strict=True))


def _stored(v: Any, stype: str) -> Any:
    if v is None or stype == CHAR:
        return v if v is None else str(v)
    if stype == DECIMAL:
        return Decimal(str(v))
    if isinstance(v, datetime.datetime):
        return float((v - DATETIME_EPOCH).total_seconds())
    if isinstance(v, datetime.date):
        return float((v - DATE_EPOCH).days)
    return float(v)


def database_source(spark: SparkSession, cursor: Any, dialect: str | None = None, by: Sequence[str] = (), order_by: Sequence[str] = ("_obs",), arraysize: int = 500, char_default_len: int | None = None) -> Source:
    """The rows of an executed cursor. Dates become numbers; columns of unknown type codes are typed by their values.

    Rows pass through the driver, so this is for results of moderate size; ``jdbc_source``
    reads on the executors.
    """
    types = DIALECTS[dialect].types if dialect else None
    declared: dict[str, Declaration] = {}
    for d in cursor.description:
        meaning = types.resolve(d) if types else None
        if meaning:
            stype, length, fmt = meaning
            size = (d[3] or char_default_len) if stype == CHAR else length
            declared[d[0]] = Declaration(d[0], stype, size, fmt, d[5], d[4])
    rows = ({k: _stored(v, declared[k].stype) if k in declared else v for k, v in r.items()} for r in CursorRows(cursor, arraysize))
    df = from_dicts(spark, rows, chunk=arraysize * 20)
    for name, d in declared.items():
        if name in df.columns:
            df = df.withColumn(name, df[name].cast(d.data_type))
    return Source(df, tuple(by), tuple(order_by), tuple(declared.values()))


def jdbc_source(spark: SparkSession, url: str, query: str, by: Sequence[str] = (), order_by: Sequence[str] = (), fetchsize: int = 10_000, **options: str) -> Source:
    """A query read over JDBC on the executors; partitioning options make it parallel."""
    reader = spark.read.format("jdbc").option("url", url).option("query", query).option("fetchsize", fetchsize)
    return Source(reader.options(**options).load(), tuple(by), tuple(order_by))


def text_source(spark: SparkSession, path: str, fields: dict[str, tuple[int, int, str | None]], order: str = "_obs") -> Source:
    """Fixed-width text read by informats: name -> (start from 1, width, informat or None)."""
    from pyspark.sql import functions as F

    from tidestep.functions.formats import input_column

    raw = spark.read.text(path).withColumn(order, F.monotonically_increasing_id())
    columns = []
    for name, (start, width, informat) in fields.items():
        text = F.rtrim(F.substring("value", start, width))
        columns.append((input_column(F.when(text != "", text), informat) if informat else text).alias(name))
    return Source(raw.select(*columns, order), (), (order,))
