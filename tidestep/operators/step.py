"""A step: a function of one observation, applied to every row of an ordered source."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidestep.plans import ir
from tidestep.plans.fold import fold, infer_schema
from tidestep.plans.frontend import Unsupported, parse
from tidestep.plans.lowering import Lowering, NotLowered, Options, is_first
from tidestep.plans.order import keys
from tidestep.sources.dialects import Declaration
from tidestep.sources.readers import Source, set_source


def free_groups(body: tuple[ir.Node, ...], retain: dict[str, Any], by: Sequence[str]) -> int:
    """The fewest leading BY columns whose groups never see each other's state; 0 if there are none.

    For some first.k, every assigned retained variable must be set whenever it holds, before
    anything reads it; and nothing may look across groups (lags, n, eof).
    """
    nodes = [n for s in body for n in s.walk()]
    if any(isinstance(n, (ir.Lag, ir.Dif, ir.Auto)) for n in nodes):
        return 0
    states = {v for v in retain if any(v in ir.assigned(s) for s in body)}
    for size, k in enumerate(by, start=1):
        sure: set[str] = set()
        for s in body:
            if isinstance(s, ir.If) and is_first(s.test) == k:
                for x in s.yes:
                    if isinstance(x, ir.Assign) and not (states - sure) & ir.reads(x.value):
                        sure.add(x.target)
                    else:
                        break
            elif (states - sure) & (ir.reads(s) | ir.assigned(s)):
                break
        if states <= sure:
            return size
    return 0


class DataStep:
    """``DataStep(source, logic, ...).to_df()``: the rows that logic emits.

    ``logic(pdv)`` reads ``pdv["x"]``, ``pdv.first["k"]``, ``pdv.last["k"]``, ``pdv.n``,
    ``pdv.eof`` and ``pdv.in_["flag"]``, calls ``pdv.lag``, ``pdv.dif`` and ``pdv.put``,
    assigns ``pdv["y"] = ...`` and may call ``pdv.output()`` and ``pdv.delete()``. A row is
    emitted at its end unless it was deleted or output.

    What can be read from the function's source runs as projections and windows; recurrences
    run as folds, in parallel by group where groups are independent, else in one task; what
    can't be read runs as a fold too and needs ``output_schema``.

    ``retain``: variables that keep their value from row to row, with their first value.
    ``char_length="first_value"`` cuts an undeclared text variable to the length of its first
    value. ``group_independent``: the caller's word that state never crosses BY groups.
    """

    def __init__(
        self,
        source: Source | DataFrame,
        logic: Callable[[Any], None],
        by: Sequence[str] = (),
        order_by: Sequence[str] = (),
        retain: dict[str, Any] | None = None,
        declare: Sequence[Declaration] = (),
        keep: Sequence[str] | None = None,
        drop: Sequence[str] | None = None,
        rename: dict[str, str] | None = None,
        output_schema: dict[str, T.DataType] | None = None,
        group_independent: bool = False,
        char_length: str = "declared",
        **options: str,
    ):
        src = source if isinstance(source, Source) else set_source(source)
        self.source = Source(src.df, tuple(by) or src.by, tuple(order_by) or src.order_by, src.declarations, src.flags)
        self.logic, self.retain = logic, dict(retain or {})
        self.declared = {d.name: d for d in (*src.declarations, *declare)}
        self.keep_, self.drop_, self.rename = keep, drop, rename or {}
        self.output_schema, self.group_independent, self.char_length = output_schema, group_independent, char_length
        self.options = Options(**options)
        self.cause = ""
        try:
            self.body: tuple[ir.Node, ...] | None = parse(logic)
        except Unsupported as e:
            self.body, self.cause = None, str(e)
        self._seen: Lowering | None = None
        self._tier: str | None = None

    @property
    def tier(self) -> str:
        """row, window, group (a fold by group), sequential (a fold in one task) or opaque. No job runs to tell."""
        if self._tier is None:
            self._tier = self._choose()
        return self._tier

    def _choose(self) -> str:
        if self.body is None:
            return "opaque"
        try:
            low = self._lowered(dry=True)
        except NotLowered as e:
            self.cause = str(e)
            return "group" if self.group_independent and self.source.by or free_groups(self.body, self.retain, self.source.by) else "sequential"
        self._seen = low
        nodes = [n for s in self.body for n in s.walk()]
        return "window" if low.states or any(isinstance(n, (ir.Edge, ir.Lag, ir.Dif, ir.Auto)) for n in nodes) else "row"

    def _lowered(self, dry: bool = False) -> Lowering:
        low = Lowering(self.source, self.body, self.retain, self.declared, self.options, dry)
        low.run()
        return low

    def _rows(self) -> DataFrame:
        if self.tier in ("row", "window"):
            return self._lowered().rows()
        schema = self.output_schema or infer_schema(self.source, self.body, self.retain, self.declared)
        group = len(self.source.by) if self.group_independent else free_groups(self.body, self.retain, self.source.by) if self.body is not None else 0
        has_output = any(isinstance(n, ir.Output) for s in self.body for n in s.walk()) if self.body is not None else False
        return fold(self.source, self.logic, schema, self.retain, self.declared, group, self.options.implicit_output, has_output)

    def _projected(self, rows: DataFrame) -> DataFrame:
        names = [c for c in rows.columns if not c.startswith("__o")]
        if self.char_length == "first_value":
            order = F.struct(*[F.col(c) for c in rows.columns if c.startswith("__o")])
            for f in rows.schema.fields:
                if isinstance(f.dataType, T.StringType) and f.name in names and f.name not in self.declared and f.name not in self.source.df.columns:
                    first = rows.agg(F.min_by(F.length(f.name), order)).first()[0]
                    rows = rows.withColumn(f.name, F.substring(f.name, 1, first or 0))
        if self.keep_ is not None:
            names = [n for n in names if n in set(self.keep_)]
        if self.drop_ is not None:
            names = [n for n in names if n not in set(self.drop_)]
        return rows.select(*[F.col(f"`{n}`").alias(self.rename.get(n, n)) for n in names])

    def to_df(self) -> DataFrame:
        """The emitted rows, in no order."""
        return self._projected(self._rows())

    def ordered(self) -> DataFrame:
        """The emitted rows, sorted as a loop over the source would emit them."""
        rows = self._rows()
        order = keys([c for c in rows.columns if c.startswith("__o")])
        return self._projected(rows.orderBy(*order)) if order else self._projected(rows)

    def explain_step(self):
        """How each statement is planned (plans/advisor.py)."""
        from tidestep.plans.advisor import report

        return report(self)


def compile_step(logic: Callable[[Any], None], columns: Sequence[str], retain: dict[str, Any] | None = None) -> tuple[str, str]:
    """("parsed", "") or ("opaque", cause) of a function."""
    try:
        parse(logic)
    except Unsupported as e:
        return "opaque", str(e)
    return "parsed", ""


def chain(source: Source | DataFrame, *steps: dict[str, Any]) -> DataFrame:
    """Steps one after another, each given as the keyword arguments of DataStep; row steps become one projection."""
    for s in steps:
        source = DataStep(source, **s).to_df()
    return source
