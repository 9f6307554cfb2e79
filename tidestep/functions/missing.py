"""Missing values: 28 of them, below every other value, in a total order.

In DataFrames a plain missing is NULL. Where special missings matter, a companion text column
holds the tag (``_``, ``A`` to ``Z``; NULL for a plain one). Comparisons are two-valued.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F


@functools.total_ordering
class Missing:
    """One missing value of Python code; equal if the tags are. Tags: "" (plain), "_", "A" to "Z"."""

    __slots__ = ("tag",)

    def __init__(self, tag: str = ""):
        self.tag = tag

    @property
    def rank(self) -> int:
        return {"_": 0, "": 1}.get(self.tag) if self.tag in ("_", "") else 2 + ord(self.tag) - ord("A")

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Missing) and self.tag == other.tag

    def __lt__(self, other: object) -> bool:
        return self.rank < other.rank if isinstance(other, Missing) else True

    def __gt__(self, other: object) -> bool:
        return self.rank > other.rank if isinstance(other, Missing) else False

    def __hash__(self) -> int:
        return hash(("missing", self.tag))

    def __repr__(self) -> str:
        return "." + self.tag

    __str__ = __repr__


MISSING = Missing()


def missing(tag: str = "") -> Missing:
    """The missing value of a tag; letters in either case."""
    tag = tag.upper().lstrip(".")
    if tag and tag != "_" and not (len(tag) == 1 and "A" <= tag <= "Z"):
        raise ValueError(f"no missing value {tag!r}")
    return Missing(tag) if tag else MISSING


def rank(value: Column, tag: Column | None = None) -> Column:
    """0 to 27 for missings in order, 28 for other values."""
    plain = F.lit(1) if tag is None else F.when(tag.isNull() | (tag == ""), 1).when(tag == "_", 0).otherwise(F.ascii(tag) - 63)
    return F.when(value.isNull(), plain).otherwise(28)


def sort_keys(value: Column, tag: Column | None = None) -> list[Column]:
    """Columns to sort by, ascending."""
    return [value.asc_nulls_first()] if tag is None else [rank(value, tag).asc(), value.asc_nulls_first()]


def less(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), b.isNotNull()).when(b.isNull(), False).otherwise(a < b)


def compare(op: str, a: Column, b: Column, constant: str = "") -> Column:
    """A comparison with missing below all; NULL counts as false. constant: "a" or "b" if that side is a known value.

    Against a known value the bare operator is kept where it says the same, so that filters
    still reach the files.
    """
    if op in (">", ">="):
        swap = {">": "<", ">=": "<="}[op]
        return compare(swap, b, a, {"a": "b", "b": "a"}.get(constant, ""))
    if op == "==":
        return a == b if constant else a.eqNullSafe(b)
    if op == "!=":
        other = b if constant == "a" else a
        return (a != b) | other.isNull() if constant else ~a.eqNullSafe(b)
    bare = a < b if op == "<" else a <= b
    if constant == "b":
        return bare | a.isNull()
    if constant == "a":
        return bare
    return less(a, b) if op == "<" else ~less(b, a)


def compare_tagged(op: str, a: Column, a_tag: Column, b: Column, b_tag: Column) -> Column:
    """The same for values with tags."""
    x, y = (F.struct(rank(v, t).alias("rank"), v.alias("value")) for v, t in ((a, a_tag), (b, b_tag)))
    same = (rank(a, a_tag) == rank(b, b_tag)) & a.eqNullSafe(b)
    return {"==": same, "!=": ~same, "<": x < y, "<=": (x < y) | same, ">": y < x, ">=": (y < x) | same}[op]
