"""From the statements of a step to a DataFrame of projections and windows.

Every assignment makes a new column; an ``if`` becomes a guard on the assignments inside it.
What only reads the current row is a projection. First and last flags, lags and recognised
updates of retained variables are window columns. What is none of these raises NotLowered,
and the step runs as a fold (fold.py).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import ArithmeticException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidestep.functions.formats import format_column
from tidestep.functions.missing import Missing, compare
from tidestep.functions.types import CHAR, DECIMAL, get_type
from tidestep.plans import ir
from tidestep.plans.order import NUMBER, TOTAL, keys, look_back, numbered
from tidestep.sources.dialects import Declaration
from tidestep.sources.readers import Source


class NotLowered(Exception):
    """Not expressible by projections and windows."""


@dataclass(frozen=True)
class Options:
    implicit_output: str = "per_row"  # or "sas": any output statement turns the implicit one off
    missing: str = "propagate"  # or "strict": arithmetic on missing values is an error
    truth: str = "reference"  # a missing value counts as true; "sas": as false
    on_error: str = "raise"  # or "missing": division by zero gives missing


@dataclass
class Update:
    guard: Column
    kind: str  # set, add, max, min
    value: Column


@dataclass
class StatePlan:
    """How a retained variable is computed; last: the top-level statement after which it is known."""

    kinds: list[str]
    last: int
    partition: tuple[str, ...]


def is_first(test: ir.Node) -> str | None:
    return test.name if isinstance(test, ir.Edge) and test.which == "first" else None


def _extreme(s: ir.Node, v: str) -> tuple[str, ir.Node] | None:
    """``if e > v: v = e`` and its like."""
    if isinstance(s, ir.If) and not s.no and len(s.yes) == 1 and isinstance(s.yes[0], ir.Assign) and s.yes[0].target == v and isinstance(s.test, ir.Compare):
        t, e = s.test, s.yes[0].value
        if v in ir.reads(e):
            return None
        for op, a, b in ((t.op, t.left, t.right), ({">": "<", "<": ">"}.get(t.op, ""), t.right, t.left)):
            if b == ir.Var(v) and a == e and op in (">", "<"):
                return ("max" if op == ">" else "min"), e
    return None


def _kind(a: ir.Assign) -> tuple[str, ir.Node]:
    v, e = a.target, a.value
    if v not in ir.reads(e):
        return "set", e
    if isinstance(e, ir.Binary) and e.op in "+-":
        if e.left == ir.Var(v) and v not in ir.reads(e.right):
            return "add", e.right if e.op == "+" else ir.Negate(e.right)
        if e.op == "+" and e.right == ir.Var(v) and v not in ir.reads(e.left):
            return "add", e.left
    raise NotLowered(f"{v} is a recurrence")


def plan_state(body: tuple[ir.Node, ...], v: str, by: tuple[str, ...]) -> StatePlan | None:
    """The window plan of a retained variable, None if the step never assigns it."""
    touched = [i for i, s in enumerate(body) if v in ir.assigned(s)]
    if not touched:
        return None
    kinds: list[str] = []
    derived = {v}

    def visit(s: ir.Node) -> None:
        if _extreme(s, v):
            kinds.append(_extreme(s, v)[0])
        elif isinstance(s, ir.Assign):
            if s.target == v:
                kinds.append(_kind(s)[0])
            elif derived & ir.reads(s.value):
                raise NotLowered(f"{v} is read between its updates")
        elif isinstance(s, ir.If):
            if v in ir.reads(s.test):
                raise NotLowered(f"{v} decides about its own update")
            for x in (*s.yes, *s.no):
                visit(x)

    for i, s in enumerate(body[: touched[-1] + 1]):
        if i < touched[0] and v in ir.reads(s):
            raise NotLowered(f"{v} is read before its update")
        visit(s)
    order = "".join("s" if k == "set" else "u" for k in kinds)
    if "su" in order and "us" in order or {"add"} & set(kinds) and {"max", "min"} & set(kinds) or {"max", "min"} <= set(kinds):
        raise NotLowered(f"{v} mixes updates")
    first = body[touched[0]]
    k = is_first(first.test) if isinstance(first, ir.If) and not first.no else None
    sure = k in by and any(isinstance(x, ir.Assign) and x.target == v for x in first.yes) if k else False
    return StatePlan(kinds, touched[-1], by[: by.index(k) + 1] if sure else ())


@dataclass
class Lowering:
    source: Source
    body: tuple[ir.Node, ...]
    retain: dict[str, object]
    declared: dict[str, Declaration]
    options: Options
    dry: bool = False  # only to see what becomes of the step: no job runs, and the rows are not to be used
    df: DataFrame = field(init=False)
    env: dict[str, Column] = field(init=False)
    made: int = 0

    def __post_init__(self) -> None:
        self.order, self.by = self.source.order, self.source.by
        self.states = {v: p for v in self.retain if (p := plan_state(self.body, v, self.by)) is not None}
        nodes = [n for s in self.body for n in s.walk()]
        needs_order = bool(self.states) or any(isinstance(n, (ir.Edge, ir.Lag, ir.Dif, ir.Auto)) for n in nodes)
        if needs_order and not self.order:
            raise ValueError("this step looks across rows: give order_by (or by)")
        self.df = self.source.df
        if any(isinstance(n, ir.Auto) for n in nodes) or self._open_lags():
            self.df = numbered(self.df, self.order, dry=self.dry)
        self.env = {c: F.col(c) for c in self.source.df.columns}
        for name, d in self.declared.items():
            self.env.setdefault(name, F.lit(None).cast(d.data_type))
        for name, init in self.retain.items():
            self.env[name] = F.lit(None).cast("double") if isinstance(init, Missing) or init is None else F.lit(init)
        self.updates: dict[str, list[Update]] = {v: [] for v in self.states}
        self.edges: dict[tuple[str, str], Column] = {}
        self.outputs: list[tuple[Column, dict[str, Column]]] = []
        self.deleted: Column | None = None
        self.null_guards: set[str] = set()
        self.unsure_output = self.unsure_delete = False
        self.live: Column | None = None
        self.ready: dict[int, str] = {}  # lags looked up together, by the identity of their nodes
        self.names = [c for c in self.source.df.columns if c not in self.source.flags]
        self.names += [n for n in (*self.declared, *self.retain) if n not in self.names]

    def _open_lags(self) -> bool:
        return any(isinstance(n, (ir.Lag, ir.Dif)) for s in self.body if isinstance(s, ir.Assign) for n in s.walk())

    # expressions

    def keep(self, col: Column) -> str:
        """col as a hidden column of the frame."""
        self.made += 1
        name = f"__s{self.made}"
        self.df = self.df.withColumn(name, col)
        return name

    def kind(self, col: Column) -> T.DataType:
        return self.df.select(col.alias("x")).schema["x"].dataType

    def truth(self, node: ir.Node, guard: Column | None) -> Column:
        col = self.expr(node, guard)
        k = self.kind(col)
        if isinstance(k, T.BooleanType):
            return col
        is_text = isinstance(k, T.StringType)
        return F.coalesce(col != ("" if is_text else 0), F.lit(self.options.truth == "reference" and not is_text))

    def number(self, col: Column) -> Column:
        k = self.kind(col)
        if isinstance(k, T.NumericType):
            return col
        return get_type("num").column(F.coalesce(col, F.lit(False)) if isinstance(k, T.BooleanType) else col, k, None)

    def expr(self, node: ir.Node, guard: Column | None) -> Column:
        if isinstance(node, ir.Const):
            return F.lit(None).cast("double") if isinstance(node.value, Missing) else F.lit(node.value)
        if isinstance(node, ir.Var):
            return self.env.get(node.name, F.lit(None).cast("double"))
        if isinstance(node, ir.Auto):
            return F.col(NUMBER) if node.name == "n" else F.col(NUMBER) == F.col(TOTAL)
        if isinstance(node, ir.Edge):
            return self.edge(node)
        if isinstance(node, ir.Flag):
            return F.col(node.name)
        if isinstance(node, ir.Negate):
            return -self.number(self.expr(node.value, guard))
        if isinstance(node, ir.Binary):
            return self.arithmetic(node.op, self.expr(node.left, guard), self.expr(node.right, guard), node, guard)
        if isinstance(node, ir.Compare):
            constant = "b" if isinstance(node.right, ir.Const) and not isinstance(node.right.value, Missing) else "a" if isinstance(node.left, ir.Const) and not isinstance(node.left.value, Missing) else ""
            a, b = self.expr(node.left, guard), self.expr(node.right, guard)
            ka, kb = self.kind(a), self.kind(b)
            if isinstance(ka, T.BooleanType) != isinstance(kb, T.BooleanType):
                a, b = self.number(a), self.number(b)
            elif isinstance(ka, T.StringType) != isinstance(kb, T.StringType) and not isinstance(ka, T.NullType) and not isinstance(kb, T.NullType):
                if (isinstance(node.left, ir.Const) or isinstance(node.right, ir.Const)) and not constant:
                    a, b = (x.cast("string") for x in (a, b))  # a missing beside a text
                else:
                    raise NotLowered("a number is compared with a text")
            return compare(node.op, a, b, constant)
        if isinstance(node, ir.Logic):
            parts = [self.truth(v, guard) for v in node.values]
            out = parts[0]
            for p in parts[1:]:
                out = out & p if node.op == "and" else out | p
            return out
        if isinstance(node, ir.Not):
            return ~F.coalesce(self.truth(node.value, guard), F.lit(False))
        if isinstance(node, ir.Choose):
            return F.when(self.truth(node.test, guard), self.expr(node.yes, guard)).otherwise(self.expr(node.no, guard))
        if isinstance(node, ir.IsMissing):
            return self.expr(node.value, guard).isNull()
        if isinstance(node, ir.Put):
            col = self.env.get(node.name)
            if col is None:
                return F.lit(".")
            fmt = node.spec or (self.declared[node.name].fmt if node.name in self.declared else None)
            return format_column(col, fmt, self.kind(col).simpleString())
        if isinstance(node, (ir.Lag, ir.Dif)):
            if id(node) in self.ready:
                before, x = F.col(self.ready[id(node)]), self.expr(node.value, guard)
            else:
                x = F.col(self.keep(self.expr(node.value, guard)))
                before = self.lag(x, node.depth, guard)
            return before if isinstance(node, ir.Lag) else self.number(x) - self.number(before)
        raise NotLowered(type(node).__name__)

    def arithmetic(self, op: str, a: Column, b: Column, node: ir.Binary, guard: Column | None) -> Column:
        ka, kb = self.kind(a), self.kind(b)
        if isinstance(ka, T.StringType) and isinstance(kb, T.StringType) and op == "+":
            return F.concat(a, b)
        if isinstance(ka, T.StringType) or isinstance(kb, T.StringType):
            raise NotLowered("arithmetic on a text")
        a, b = self.number(a), self.number(b)
        whole = all(isinstance(self.kind(x), T.IntegralType) for x in (a, b))
        if self.options.missing == "strict":
            a, b = (F.when(x.isNull(), F.raise_error(F.lit("arithmetic on a missing value"))).otherwise(x) for x in (a, b))
        if self.options.on_error == "missing" and op in "/%//":
            b = F.when(b != 0, b)
        if op == "+":
            return a + b
        if op == "-":
            return a - b
        if op == "*":
            return a * b
        if op == "/":
            return a / b
        if op in ("%", "//"):  # the remainder takes the sign of the divisor; a step wider than a double's is never added
            rest = a % b
            rest = F.when((rest != 0) & ((rest < 0) != (b < 0)), rest + b).otherwise(rest)
            if op == "%":
                return rest
            if whole:
                return F.call_function("div", a - rest, b)
            times = (a - rest) / b
            below = F.floor(times).cast("double")
            return F.when(times - below > 0.5, below + 1).otherwise(below)
        exponent = node.right.value if isinstance(node.right, ir.Const) else None
        if not whole or exponent is not None and exponent < 0:
            return F.pow(a, b)
        if exponent is None or exponent > 16:
            raise NotLowered("a whole power that is not a short product")
        kind = "bigint" if self.fits(a, exponent, guard) else "decimal(38,0)"
        power = F.lit(1).cast(kind)
        for _ in range(exponent):
            power = (power * a.cast(kind)).cast(kind)
        return F.when(a.isNotNull(), power)

    def fits(self, a: Column, exponent: int, guard: Column | None) -> bool:
        """Whether a whole power of all the rows' values has 64 bits; rows are read only if the type leaves it open."""
        bits = {"tinyint": 7, "smallint": 15, "int": 31}.get(self.kind(a).simpleString(), 63)
        if bits * exponent < 63 or exponent < 2 or self.dry or self.df.isStreaming:
            return True
        rows = self.df if guard is None else self.df.where(guard)
        try:
            low, high = rows.agg(F.min(a), F.max(a)).first()
        except ArithmeticException:  # a branch not taken may have it; if it is taken, the step shows it
            return True
        return all(x is None or -(2**63) <= x**exponent < 2**63 for x in (low, high))

    def edge(self, node: ir.Edge) -> Column:
        if node.name not in self.by:
            raise KeyError(f"{node.name} is no BY variable")
        if (node.which, node.name) not in self.edges:
            window = Window.partitionBy(*self.by[: self.by.index(node.name) + 1]).orderBy(*keys(self.order))
            for which, f in (("first", F.lag), ("last", F.lead)):  # one sort serves both
                self.edges[which, node.name] = F.col(self.keep(f(F.lit(1)).over(window).isNull()))
        return self.edges[node.which, node.name]

    def look_ahead(self, start: int) -> None:
        """Looks up together the lags of the assignments from start on that read nothing assigned on the way."""
        wanted: dict[str, tuple[str, int]] = {}
        done: set[str] = set()
        for s in self.body[start:]:
            if not isinstance(s, ir.Assign) or s.target in self.states:
                break
            for n in s.walk():
                if isinstance(n, (ir.Lag, ir.Dif)) and id(n) not in self.ready:
                    inner = [x for x in n.value.walk() if isinstance(x, (ir.Lag, ir.Dif))]
                    if ir.reads(n.value) & (done | set(self.states)) or any(id(x) not in self.ready for x in inner):
                        continue
                    held = self.keep(self.expr(n.value, None))
                    self.made += 1
                    wanted[f"__s{self.made}"] = (held, n.depth)
                    self.ready[id(n)] = f"__s{self.made}"
            done.add(s.target)
        if wanted:
            self.df = look_back(self.df, wanted)

    def lag(self, x: Column, depth: int, guard: Column | None) -> Column:
        if guard is None:
            held, name = self.keep(x), f"__s{self.made + 1}"
            self.made += 1
            self.df = look_back(self.df, {name: (held, depth)})
            return F.col(name)
        # the queue only moves on rows that come here: they are numbered on their own
        g = F.col(self.keep(F.coalesce(guard, F.lit(False))))
        held = self.keep(x)
        self.made += 1
        name, number, total = f"__s{self.made}", f"__n{self.made}", f"__t{self.made}"
        here = look_back(numbered(self.df.where(g), self.order, number, total, self.dry), {name: (held, depth)}, number).drop(number, total)
        others = self.df.where(~g).withColumn(name, F.lit(None).cast(self.kind(x)))
        self.df = here.unionByName(others)
        return F.col(name)

    # statements

    def unsure(self, node: ir.Node) -> bool:
        """Whether a test may be NULL, which counts as false; such tests stay bare so that filters reach the files."""
        if isinstance(node, ir.Compare):
            known = lambda x: isinstance(x, ir.Const) and not isinstance(x.value, Missing)
            return known(node.right) and node.op in (">", ">=", "==") or known(node.left) and node.op in ("<", "<=", "==")
        return isinstance(node, ir.Logic) and any(map(self.unsure, node.values)) or isinstance(node, ir.Choose)

    def opposite(self, guard: Column, unsure: bool) -> Column:
        return ~F.coalesce(guard, F.lit(False)) if unsure else ~guard

    def run(self) -> None:
        for i, s in enumerate(self.body):
            if self.live is None and isinstance(s, ir.Assign) and any(isinstance(n, (ir.Lag, ir.Dif)) and id(n) not in self.ready for n in s.walk()):
                self.look_ahead(i)
            self.statement(s, None)
            for v, plan in self.states.items():
                if plan.last == i:
                    self.finish(v, plan)

    def statement(self, s: ir.Node, guard: Column | None) -> None:
        if self.live is not None:
            unsure = str(guard) in self.null_guards
            guard = self.live if guard is None else F.col(self.keep(guard & self.live))
            self.null_guards |= {str(guard)} if unsure else set()
        if isinstance(s, ir.Assign):
            self.assign(s, guard)
        elif isinstance(s, ir.If):
            for v in self.states:
                found = _extreme(s, v)
                if found:
                    self.updates[v].append(Update(guard if guard is not None else F.lit(True), found[0], self.coerced(v, self.expr(found[1], guard))))
                    return
            test, unsure = F.col(self.keep(self.truth(s.test, guard))), self.unsure(s.test)
            for branch, sign, bare in ((s.yes, test, unsure), (s.no, self.opposite(test, unsure), False)):
                if branch:
                    inner = F.col(self.keep(sign if guard is None else guard & sign))
                    self.null_guards |= {str(inner)} if bare or str(guard) in self.null_guards else set()
                    for x in branch:
                        self.statement(x, inner)
        elif isinstance(s, ir.Output):
            self.outputs.append((guard if guard is not None else F.lit(True), dict(self.env)))
            self.unsure_output |= str(guard) in self.null_guards
        elif isinstance(s, ir.Delete):
            gone = guard if guard is not None else F.lit(True)
            self.deleted = gone if self.deleted is None else self.deleted | gone
            self.unsure_delete |= str(guard) in self.null_guards
        elif isinstance(s, ir.Return):
            gone = self.opposite(guard, True) if guard is not None else F.lit(False)
            self.live = F.col(self.keep(gone if self.live is None else self.live & gone))

    def coerced(self, target: str, value: Column) -> Column:
        d = self.declared.get(target)
        k = self.kind(value)
        if isinstance(k, T.BooleanType):
            value = F.coalesce(value, F.lit(False))  # a comparison is true or false
        if d is not None:
            out = get_type(d.stype).column(value, k, d.length if d.stype == CHAR else d.scale)
            return out.cast(d.data_type) if d.stype in (CHAR, DECIMAL) else out
        old = self.env.get(target)
        if old is not None:
            was = self.kind(old)
            if isinstance(was, T.StringType) and not isinstance(k, T.StringType):
                return get_type(CHAR).column(value, k, None)
            if isinstance(was, T.NumericType) and isinstance(k, (T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
                return get_type("num").column(value, k, None)
        return get_type("num").column(value, k, None) if isinstance(k, (T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)) else value

    def assign(self, s: ir.Assign, guard: Column | None) -> None:
        if s.target not in self.names:
            self.names.append(s.target)
        if s.target in self.states:
            kind, e = _kind(s)
            self.updates[s.target].append(Update(guard if guard is not None else F.lit(True), kind, self.coerced(s.target, self.expr(e, guard))))
            return
        value = self.coerced(s.target, self.expr(s.value, guard))
        if guard is not None:
            old = self.env.get(s.target)
            value = F.when(guard, value) if old is None else F.when(guard, value).otherwise(old)
        self.env[s.target] = F.col(self.keep(value))

    def finish(self, v: str, plan: StatePlan) -> None:
        updates, init = self.updates[v], self.env[v]
        sets = [u for u in updates if u.kind == "set"]
        moves = [u for u in updates if u.kind != "set"]
        for u in updates:
            u.guard, u.value = F.col(self.keep(F.coalesce(u.guard, F.lit(False)))), F.col(self.keep(u.value))
        any_set = F.lit(False)
        base = init
        for u in sets:
            any_set = any_set | u.guard
            base = F.when(u.guard, u.value).otherwise(base)
        any_set, base = F.col(self.keep(any_set)), F.col(self.keep(base))
        parts = [F.col(c) for c in plan.partition]
        if len(sets) > (1 if plan.partition else 0):
            segment = F.sum(any_set.cast("int")).over(Window.partitionBy(*parts).orderBy(*keys(self.order)).rowsBetween(Window.unboundedPreceding, Window.currentRow))
            parts = [*parts, F.col(self.keep(segment))]
        frame = Window.partitionBy(*parts).orderBy(*keys(self.order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        start = F.first(base).over(frame)
        if not moves:
            value = start
        elif moves[0].kind == "add":
            late = [] if updates[0].kind == "set" or not sets else [any_set]  # adds before a set in the same row are lost
            step, unknown = F.lit(0), F.lit(False)
            for u in moves:
                on = u.guard & ~late[0] if late else u.guard
                step = step + F.when(on & u.value.isNotNull(), u.value).otherwise(F.lit(0))
                unknown = unknown | (on & u.value.isNull())
            step, unknown = F.col(self.keep(step)), F.col(self.keep(unknown))
            bad = F.count(F.when(unknown, 1)).over(frame)
            value = F.when(bad == 0, start + F.sum(step).over(frame))
        else:
            pick = F.col(self.keep(F.coalesce(*[F.when(u.guard, u.value) for u in moves])))
            if moves[0].kind == "max":
                value = F.greatest(start, F.max(pick).over(frame))
            else:
                unknown = F.col(self.keep(F.coalesce(*[u.guard & u.value.isNull() for u in moves])))
                value = F.when(start.isNotNull() & (F.count(F.when(unknown, 1)).over(frame) == 0), F.least(start, F.min(pick).over(frame)))
        self.env[v] = F.col(self.keep(value))

    # rows

    def rows(self) -> DataFrame:
        """The emitted rows, with the columns that the order needs in front, hidden."""
        final = {n: self.env[n] for n in self.names}
        hidden = {f"__o{i}": F.col(c) for i, c in enumerate(self.order)}
        stays = None if self.deleted is None else self.opposite(self.deleted, self.unsure_delete)
        if not self.outputs:
            return (self.df if stays is None else self.df.where(stays)).select(*[c.alias(n) for n, c in hidden.items()], F.lit(0).alias("__op"), *[c.alias(n) for n, c in final.items()])
        sas = self.options.implicit_output == "sas"
        some = self.outputs[0][0]
        for g, _ in self.outputs[1:]:
            some = some | g
        other = self.opposite(some, self.unsure_output)
        implicit = F.lit(False) if sas else other if stays is None else other & stays
        same = lambda env: all(env.get(n) is self.env[n] for n in self.names)
        if len(self.outputs) == 1 and same(self.outputs[0][1]):
            out = self.outputs[0][0] if sas else some | stays if stays is not None else F.lit(True)
            return self.df.where(out).select(*[c.alias(n) for n, c in hidden.items()], F.lit(0).alias("__op"), *[c.alias(n) for n, c in final.items()])
        kinds = {n: self.kind(c) for n, c in final.items()}
        snap = lambda env: F.struct(*[env.get(n, F.lit(None)).cast(kinds[n]).alias(n) for n in self.names])
        made = [F.when(g, snap(env)) for g, env in self.outputs] + [F.when(implicit, snap(final))]
        out = self.df.select(*[c.alias(n) for n, c in hidden.items()], F.posexplode(F.array(*made)).alias("__op", "__row")).where(F.col("__row").isNotNull())
        return out.select(*hidden, "__op", *[F.col(f"__row.`{n}`").alias(n) for n in self.names])
