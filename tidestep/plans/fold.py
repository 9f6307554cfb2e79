"""Row-by-row execution of a step inside a task, streaming over sorted rows.

Rows of a group lie together and in order, so memory does not grow with a group: groups are
dealt out by hash, sorted in their partition, and the state starts anew at each group.
"""

from __future__ import annotations

import sys
from collections import deque
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidestep.functions.formats import format_value
from tidestep.functions.missing import MISSING, Missing
from tidestep.functions.types import CHAR, char_value, get_type, infer_type, num_value
from tidestep.plans import ir
from tidestep.plans.order import keys
from tidestep.sources.dialects import Declaration
from tidestep.sources.readers import Source


class RowState:
    """What a step's function sees of a row; the same names as in a lowered step."""

    def __init__(self, logic: Callable, by: Sequence[str], flags: Sequence[str], retain: dict[str, Any], declared: dict[str, Declaration], implicit: str = "per_row", has_output: bool = False):
        self.logic, self.by, self.flags, self.init, self.declared = logic, tuple(by), tuple(flags), retain, declared
        self.suppress = implicit == "sas" and has_output
        self.reset()

    def reset(self) -> None:
        self.values: dict[str, Any] = {}
        self.kept = {k: MISSING if v is None else v for k, v in self.init.items()}
        self.queues: dict[Any, deque] = {}
        self.n, self.eof, self.first, self.last, self.in_ = 0, False, {}, {}, {}

    def __getitem__(self, name: str) -> Any:
        return self.values.get(name, MISSING)

    def __setitem__(self, name: str, value: Any) -> None:
        d = self.declared.get(name)
        if d is not None:
            value = get_type(d.stype).value(value, d.length)
        elif infer_type(self.values.get(name, value)) == CHAR:
            value = value if isinstance(value, Missing) else char_value(value)
        else:
            value = num_value(value)
        self.values[name] = value
        if name in self.kept:
            self.kept[name] = value

    def _site(self) -> tuple[int, int]:
        frame = sys._getframe(2)
        return id(frame.f_code), frame.f_lasti

    def _queue(self, value: Any, n: int, site: Any) -> Any:
        queue = self.queues.setdefault((site, n), deque([MISSING] * n))
        queue.append(value)
        return queue.popleft()

    def lag(self, value: Any, n: int = 1) -> Any:
        return self._queue(value, n, self._site())

    def dif(self, value: Any, n: int = 1) -> Any:
        before = self._queue(value, n, self._site())
        return MISSING if isinstance(value, Missing) or isinstance(before, Missing) else value - before

    def put(self, name: str, spec: str | None = None) -> str:
        d = self.declared.get(name)
        return format_value(self[name], spec or (d.fmt if d else None))

    def output(self) -> None:
        self.rows.append(dict(self.values))

    def delete(self) -> None:
        self.gone = True

    def step(self, row: dict, before: tuple | None, after: tuple | None) -> list[dict]:
        """The rows that one observation gives; before and after: the neighbours' BY values."""
        self.n += 1
        self.eof = after is None
        key = tuple(row[c] for c in self.by)
        for k, c in enumerate(self.by):
            self.first[c] = before is None or before[: k + 1] != key[: k + 1]
            self.last[c] = after is None or after[: k + 1] != key[: k + 1]
        self.in_ = {f: row[f] for f in self.flags}
        self.values = {k: MISSING if v is None else v for k, v in row.items() if k not in self.flags} | {n: "" if d.stype == CHAR else MISSING for n, d in self.declared.items() if n not in row} | self.kept
        self.rows, self.gone = [], False
        self.logic(self)
        if not self.rows and not self.gone and not self.suppress:
            self.output()
        return self.rows


def run_rows(rows: Iterable[dict], logic: Callable, by: Sequence[str] = (), retain: dict[str, Any] | None = None, declared: dict[str, Declaration] | None = None, flags: Sequence[str] = (), implicit: str = "per_row", has_output: bool = False, group: int = 0) -> Iterator[tuple[dict, int, dict]]:
    """(input row, position, output row) of sorted rows; group: BY columns at whose change all state starts anew."""
    state = RowState(logic, by, flags, retain or {}, declared or {}, implicit, has_output)
    key = lambda r: tuple(r[c] for c in by)
    before, held = None, None
    for nxt in _with_end(rows):
        if held is not None:
            after = key(nxt) if nxt is not None else None
            if group and before is not None and before[:group] != key(held)[:group]:
                state.reset()
            for p, out in enumerate(state.step(held, before, after)):
                yield held, p, out
            before = key(held)
        held = nxt


def _with_end(rows: Iterable[dict]) -> Iterator[dict | None]:
    yield from rows
    yield None


def infer_schema(source: Source, body: tuple[ir.Node, ...] | None, retain: dict[str, Any], declared: dict[str, Declaration]) -> dict[str, T.DataType]:
    """Types of a step's variables, joined over all assignments."""
    if body is None:
        raise ValueError("a step that can't be read needs an output_schema")
    types: dict[str, T.DataType] = {f.name: f.dataType for f in source.df.schema.fields if f.name not in source.flags}
    types |= {n: d.data_type for n, d in declared.items() if n not in types}

    def join(a: T.DataType | None, b: T.DataType) -> T.DataType:
        if a is None or isinstance(a, T.NullType):
            return b
        if isinstance(b, T.NullType) or a == b:
            return a
        if isinstance(a, T.StringType) or isinstance(b, T.StringType):
            raise ValueError("a variable is both text and number")
        return T.LongType() if isinstance(a, T.IntegralType) and isinstance(b, T.IntegralType) else T.DoubleType()

    def of_value(v: Any) -> T.DataType:
        return T.NullType() if v is None or isinstance(v, Missing) else T.StringType() if isinstance(v, str) else T.DoubleType() if isinstance(v, float) else T.LongType()

    def of(n: ir.Node) -> T.DataType:
        if isinstance(n, ir.Const):
            return of_value(n.value)
        if isinstance(n, ir.Var):
            return types.get(n.name, T.NullType())
        if isinstance(n, (ir.Lag, ir.Dif, ir.Negate)):
            return of(n.value)
        if isinstance(n, ir.Binary):
            return T.DoubleType() if n.op == "/" else join(of(n.left), of(n.right))
        if isinstance(n, ir.Choose):
            return join(of(n.yes), of(n.no))
        if isinstance(n, ir.Put):
            return T.StringType()
        return T.LongType()

    for name, init in retain.items():
        types[name] = join(types.get(name), of_value(init))
    before = None
    while types != before:  # a join only ever widens, so this ends
        before = dict(types)
        for s in body:
            for a in s.walk():
                if isinstance(a, ir.Assign) and a.target not in declared:
                    new = of(a.value)
                    types[a.target] = join(types.get(a.target), T.LongType() if isinstance(new, (T.DateType, T.TimestampType, T.TimestampNTZType)) else new)
    return {n: T.DoubleType() if isinstance(t, T.NullType) else t for n, t in types.items()}


def fold(source: Source, logic: Callable, schema: dict[str, T.DataType], retain: dict[str, Any], declared: dict[str, Declaration], group: int, implicit: str, has_output: bool) -> DataFrame:
    """The emitted rows, with hidden order columns in front. group: BY columns that state never crosses, 0 for one task."""
    order = source.order
    if not order:
        raise ValueError("this step runs row by row: give order_by (or by)")
    kinds = {f.name: f.dataType for f in source.df.schema.fields}
    hidden = [T.StructField(f"__o{i}", kinds[c]) for i, c in enumerate(order)]
    full = T.StructType([*hidden, T.StructField("__op", T.IntegerType()), *(T.StructField(n, t) for n, t in schema.items())])
    by, flags, names = source.by, source.flags, list(schema)
    arrow = to_arrow_schema(full)

    def stored(v: Any, kind: T.DataType) -> Any:
        if v is None or isinstance(v, Missing):
            return None
        return float(v) if isinstance(kind, T.DoubleType) else int(v) if isinstance(kind, T.IntegralType) else v

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in b.to_pylist())
        held: list[tuple] = []
        for row, p, out in run_rows(rows, logic, by, retain, declared, flags, implicit, has_output, group):
            held.append((*(row[c] for c in order), p, *(stored(out.get(n), schema[n]) for n in names)))
            if len(held) >= 8192:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)

    parts = int(source.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = source.df.repartition(parts, *by[:group]) if group else source.df.repartition(1)
    return dealt.sortWithinPartitions(*keys(order)).mapInArrow(run, full)
