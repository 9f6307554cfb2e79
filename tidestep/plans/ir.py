"""The nodes that a step's function is parsed to."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields
from typing import Any


class Node:
    def children(self) -> Iterator[Node]:
        for f in fields(self):  # type: ignore[arg-type]
            v = getattr(self, f.name)
            for x in v if isinstance(v, tuple) else (v,):
                if isinstance(x, Node):
                    yield x

    def walk(self) -> Iterator[Node]:
        yield self
        for c in self.children():
            yield from c.walk()


@dataclass(frozen=True)
class Const(Node):
    value: Any


@dataclass(frozen=True)
class Var(Node):
    name: str


@dataclass(frozen=True)
class Auto(Node):
    """``n`` or ``eof``."""

    name: str


@dataclass(frozen=True)
class Edge(Node):
    """``first`` or ``last`` of a BY column."""

    which: str
    name: str


@dataclass(frozen=True)
class Flag(Node):
    """An IN= flag."""

    name: str


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Negate(Node):
    value: Node


@dataclass(frozen=True)
class Compare(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Logic(Node):
    op: str
    values: tuple[Node, ...]


@dataclass(frozen=True)
class Not(Node):
    value: Node


@dataclass(frozen=True)
class Choose(Node):
    test: Node
    yes: Node
    no: Node


@dataclass(frozen=True)
class Lag(Node):
    value: Node
    depth: int


@dataclass(frozen=True)
class Dif(Node):
    value: Node
    depth: int


@dataclass(frozen=True)
class Put(Node):
    name: str
    spec: str | None


@dataclass(frozen=True)
class IsMissing(Node):
    value: Node


@dataclass(frozen=True)
class Assign(Node):
    target: str
    value: Node


@dataclass(frozen=True)
class If(Node):
    test: Node
    yes: tuple[Node, ...]
    no: tuple[Node, ...]


@dataclass(frozen=True)
class Output(Node):
    pass


@dataclass(frozen=True)
class Delete(Node):
    pass


@dataclass(frozen=True)
class Return(Node):
    pass


def reads(node: Node) -> set[str]:
    return {x.name for x in node.walk() if isinstance(x, (Var, Put))}


def assigned(node: Node) -> set[str]:
    return {x.target for x in node.walk() if isinstance(x, Assign)}
