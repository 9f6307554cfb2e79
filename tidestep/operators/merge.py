"""Positional match-merge of sources by key, and updates.

In each key group the p-th row of the result takes the p-th row of every source, or its last
one where a source is shorter. A column that several sources have takes the value of the
source that was read last: the greatest position, then the later source.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidestep.sources.readers import Source

POSITION = "_pos"


def match_merge(sources: dict[str, Source], by: Sequence[str], in_flags: dict[str, str] | None = None, in_scope: str = "row", unique: Sequence[str] = ()) -> Source:
    """The merge of named sources. in_flags: source -> column that is 1 where it gave a row.

    ``in_scope="row"``: a flag is 1 only where its source still had a row; ``"group"``: in the
    whole key group. Missing keys form one group, below all others. unique: names of sources
    known to have one row for a key at most; if all but one are, this is an ordinary full join.
    The rows of a key in any other source need an order; without one this is an error.
    """
    flags = dict(in_flags or {})
    names, by = list(sources), list(by)
    shared: dict[str, list[str]] = {}
    for s in names:
        for c in sources[s].df.columns:
            if c not in by:
                shared.setdefault(c, []).append(s)
    many = [s for s in names if s not in unique]
    if unordered := [s for s in many if not sources[s].order_by]:
        raise ValueError(f"sources {unordered} give order_by, or are named in unique")

    def key(side: str, k: int) -> str:
        return f"__k_{side}_{k}"

    parts: dict[str, DataFrame] = {}
    for s in names:
        src = sources[s]
        columns = [F.col(c).alias(key(s, k)) for k, c in enumerate(by)] + [F.col(c).alias(f"__v_{s}_{c}") for c in src.df.columns if c not in by]
        each = Window.partitionBy(*by)
        order = [F.col(c).asc_nulls_first() for c in src.order_by]
        if s in many:
            columns += [F.row_number().over(each.orderBy(*order)).alias(f"__r_{s}"), F.count(F.lit(1)).over(each).alias(f"__n_{s}")]
        else:
            columns += [F.lit(1).alias(f"__r_{s}"), F.lit(1).cast("bigint").alias(f"__n_{s}")]
        parts[s] = src.df.select(*columns)

    def same(a: Sequence[Column], b: Sequence[Column]) -> Column:
        return reduce(lambda x, y: x & y, (p.eqNullSafe(q) for p, q in zip(a, b, strict=True)))

    if len(many) <= 1:
        out = None
        for s in names:
            if out is None:
                out = parts[s].withColumns({f"__k_{k}": F.col(key(s, k)) for k in range(len(by))})
            else:
                out = out.join(parts[s], same([F.col(f"__k_{k}") for k in range(len(by))], [F.col(key(s, k)) for k in range(len(by))]), "full")
                out = out.withColumns({f"__k_{k}": F.when(F.col(f"__n_{s}").isNotNull(), F.col(key(s, k))).otherwise(F.col(f"__k_{k}")) for k in range(len(by))})
        position = F.coalesce(F.col(f"__r_{many[0]}"), F.lit(1)) if many else F.lit(1)
        out = out.withColumn(POSITION, position.cast("bigint"))
    else:
        # rows of a group: as many as its longest source has
        counts = reduce(DataFrame.unionByName, [parts[s].select(*[F.col(key(s, k)).alias(f"__k_{k}") for k in range(len(by))], *[(F.col(f"__n_{t}") if t == s else F.lit(None).cast("bigint")).alias(f"__c_{t}") for t in names]) for s in names])
        group = counts.groupBy(*[f"__k_{k}" for k in range(len(by))]).agg(*[F.max(f"__c_{t}").alias(f"__c_{t}") for t in names])
        longest = F.greatest(*[F.coalesce(f"__c_{t}", F.lit(0)) for t in names]) if len(names) > 1 else F.col(f"__c_{names[0]}")
        out = group.withColumn(POSITION, F.explode(F.sequence(F.lit(1).cast("bigint"), longest)))
        for s in names:
            at = F.least(F.col(POSITION), F.col(f"__c_{s}"))
            on = same([F.col(f"__k_{k}") for k in range(len(by))], [F.col(key(s, k)) for k in range(len(by))]) & (F.col(f"__r_{s}") == at)
            out = out.join(parts[s], on, "left")

    columns: list[Column] = [F.col(f"__k_{k}").alias(c) for k, c in enumerate(by)]
    for c, having in shared.items():
        value = F.col(f"__v_{having[0]}_{c}")
        if len(having) > 1:
            rank = lambda s: F.when(F.col(f"__n_{s}").isNotNull(), F.least(F.col(POSITION), F.col(f"__n_{s}")) * len(names) + names.index(s)).otherwise(-1)
            best = F.greatest(*[rank(s) for s in having])
            value = reduce(lambda acc, s: F.when(rank(s) == best, F.col(f"__v_{s}_{c}")).otherwise(acc), having[1:], value)
        columns.append(value.alias(c))
    for s, flag in flags.items():
        there = F.col(f"__n_{s}").isNotNull()
        if in_scope == "row":
            there = there & (F.col(POSITION) <= F.col(f"__n_{s}"))
        columns.append(F.coalesce(there, F.lit(False)).cast("int").alias(flag))
    return Source(out.select(*columns, POSITION), tuple(by), (POSITION,), (), (*flags.values(), POSITION))


def matched(sources: dict[str, Source], by: Sequence[str], how: str) -> DataFrame:
    """Two sources, the second with unique keys: ``inner``, ``left``, ``right``, ``full``, ``semi`` or ``anti`` rows of their merge."""
    (_, a), (_, b) = sources.items()
    right = b.df.select(*[F.col(c).alias(f"__k_{c}") for c in by], *[c for c in b.df.columns if c not in by])
    on = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in by))
    kind = {"semi": "left_semi", "anti": "left_anti"}.get(how, how)
    out = a.df.join(right, on, kind)
    if kind.startswith("left_"):
        return out
    return out.withColumns({c: F.coalesce(c, f"__k_{c}") for c in by}).drop(*[f"__k_{c}" for c in by])


def update(master: Source, changes: Source, by: Sequence[str]) -> DataFrame:
    """A master with unique keys, updated in order by the non-missing values of changes; new keys are added."""
    columns = [c for c in master.df.columns if c not in by]
    order = F.struct(*[F.col(c) for c in changes.order_by]) if changes.order_by else F.lit(1)
    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns if c in changes.df.columns]
    newest = changes.df.groupBy(*by).agg(*last, F.lit(1).alias("__new"))
    right = newest.select(*[F.col(c).alias(f"__k_{c}") for c in by], *[F.col(c).alias(f"__u_{c}") for c in newest.columns if c not in by])
    on = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in by))
    out = master.df.join(right, on, "full")
    return out.select(*[F.coalesce(F.col(c), F.col(f"__k_{c}")).alias(c) for c in by], *[(F.coalesce(F.col(f"__u_{c}"), F.col(c)) if c in changes.df.columns else F.col(c)).alias(c) for c in columns])


def sort(df: DataFrame, by: Sequence[str], tags: dict[str, str] | None = None) -> DataFrame:
    """Sorted with missing values first; tags: column -> its tag column."""
    from tidestep.functions.missing import sort_keys

    return df.orderBy(*[k for c in by for k in sort_keys(F.col(c), F.col(tags[c]) if tags and c in tags else None)])
