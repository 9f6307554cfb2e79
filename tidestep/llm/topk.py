"""Exact top-k inner-product search with a pivot table.

Pivots are rows of the table itself, many and spread by hash. The distances of every vector to
all pivots are computed once and kept with it. For a query q and a candidate x, the triangle
inequality makes |d(q, p) - d(x, p)| a lower bound of their distance for every pivot p; the
maximum over the pivots bounds the inner product (|q|^2 + |x|^2 - d^2) / 2 from above.
Candidates are evaluated in order of that bound, in classes, until all bounds left are below
the k-th best score found, which starts as the k-th best score among the pivots.

Queries and candidates travel in blocks. A place holds many blocks of candidates; a block of
queries goes through them one after another and takes its k best and its thresholds along, so
that a place returns k rows a query at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidestep.llm.common import Scratch, table

PIVOTS = 256
QUERY_BLOCK = 512
BLOCK = 4096
#: Candidates scored first; each further class, in order of bounds, is four times as large.
CLASS = 256
SCALE = 64
#: What rounding can change in a bound, as a share of it, generously.
SLACK = 1e-6


def components_of(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("bigint"))


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of whole-number vectors, in floating point."""
    if not len(pivots):
        return np.zeros((len(x), 0))
    x, p = x.astype(float), pivots.astype(float)
    norm = (x**2).sum(axis=1)[:, None] + (p**2).sum(axis=1)
    return np.sqrt(np.maximum(0, norm - 2 * (x @ p.T)))


def step_of(pivots: np.ndarray) -> float:
    """The width of one step of the table's distances, which are bytes: twice the pivots' spread is 250 steps."""
    return max(1.0, 2 * float(_distances(pivots, pivots).max(initial=0))) / 250


def _table(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances in whole steps, rounded down, 255 at most: neither lessens by more than a step what two of them differ by at least."""
    return np.minimum(_distances(x, pivots) / step_of(pivots), 255).astype(np.uint8)


def _scores(x: np.ndarray, q: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products: in floating point where that is exact, else in whole numbers of any size."""
    return ((x if x.dtype.kind == "f" else x.astype(float)) @ q).astype(np.int64) if exact else (x.astype(object) @ q.astype(object)).astype(np.int64)


def _float(largest: float) -> type | None:
    """The smallest floating type that holds every whole number up to largest."""
    return np.float32 if largest < 2**23 else np.float64 if largest < 2**52 else None


def _pack(pivots: dict[int, np.ndarray], most: int):
    """Rows (part, dim, row, id, v) to blocks of one dimension with their pivot table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        dim, number, part = -1, 0, 0

        def out() -> pa.RecordBatch:
            x = np.array([r[2] for r in held], np.int64).reshape(len(held), dim)
            d = _table(x, pivots[dim])
            values = ((part << 32) + number, dim, len(held), np.array([r[0] for r in held], "<i8").tobytes(), np.array([r[1] for r in held], "<i8").tobytes(), x.astype("<i8").tobytes(), d.tobytes())
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=["block", "dim", "n", "rows", "ids", "x", "d"])

        for b in batches:
            for p, n, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (n != dim or len(held) >= most):
                    yield out()
                    held, number = [], number + 1
                dim, part = n, p
                held.append(tuple(row))
        if held:
            yield out()

    return run


BLOCKS = "block bigint, dim bigint, n bigint, rows binary, ids binary, x binary, d binary"


@dataclass
class Block:
    """Vectors of one dimension with their rows, ids, squared norms, and steps to the pivots (a row a pivot)."""

    rows: np.ndarray
    ids: np.ndarray
    x: np.ndarray
    d: np.ndarray
    norm: np.ndarray

    @classmethod
    def of(cls, s: dict) -> Block:
        take = lambda name, kind, *shape: np.frombuffer(s[name], kind).reshape(s["n"], *shape)
        x = take("x", "<i8", s["dim"])
        d = take("d", np.uint8, len(s["d"]) // s["n"])
        return cls(take("rows", "<i8"), take("ids", "<i8"), x, np.ascontiguousarray(d.T), (x.astype(float) ** 2).sum(axis=1))


class Search:
    """The k best candidates so far of each query of a block; ``scored`` counts the candidates evaluated, ``met`` all."""

    def __init__(self, k: int, queries: Block, pivot_rows: np.ndarray, pivot_x: np.ndarray):
        self.k, self.q, self.scored, self.met = k, queries, 0, 0
        self.best = [np.zeros((0, 3), np.int64) for _ in queries.rows]  # score, id, row
        self.seeds = np.full(len(queries.rows), -np.inf)  # the k-th score among the pivots, which are rows too
        for i, (row, v) in enumerate(zip(queries.rows, queries.x, strict=True)):
            seeds = np.sort(_scores(pivot_x, v, _exact(pivot_x, v))[pivot_rows != row])
            if len(seeds) >= k:
                self.seeds[i] = seeds[-k]
        self.largest, self.step = float(np.abs(queries.x).max(initial=0)), step_of(pivot_x)

    def least(self, i: int) -> float:
        """A score below which nothing can be among the k best of query i."""
        best = self.best[i]
        return max(self.seeds[i], float(best[-1, 0])) if len(best) == self.k else self.seeds[i]

    def meet(self, c: Block) -> None:
        kind = _float(self.largest * float(np.abs(c.x).max(initial=0)) * c.x.shape[1])
        x = c.x.astype(kind) if kind else c.x
        own = {int(r): j for j, r in enumerate(c.rows)}
        above, below, low = np.empty_like(c.d), np.empty_like(c.d), np.zeros(len(c.rows), np.uint8)
        for i, row in enumerate(self.q.rows):
            v = self.q.x[i].astype(kind) if kind else self.q.x[i]
            self.met += len(c.rows) - (int(row) in own)
            at = self.q.d[:, i : i + 1]
            np.subtract(np.maximum(c.d, at, out=above), np.minimum(c.d, at, out=below), out=above)
            np.max(above, axis=0, out=low, initial=0)  # of all pivots
            far = np.maximum(0, low.astype(float) - 1) * self.step
            bound = (self.q.norm[i] + c.norm - far * far) / 2
            bound += SLACK * (1 + np.abs(bound))
            if int(row) in own:
                bound[own[int(row)]] = -np.inf
            left, size = np.flatnonzero(bound >= max(self.least(i), -1e300)), CLASS
            while len(left):
                now, left = (left, left[:0]) if len(left) <= size else np.split(left[np.argpartition(-bound[left], size)], [size])
                self.scored += len(now)
                found = _scores(x[now], v, bool(kind))
                good = found >= self.least(i)
                if good.any():
                    best = np.concatenate([self.best[i], np.stack([found[good], c.ids[now[good]], c.rows[now[good]]], axis=1)])
                    self.best[i] = best[np.lexsort((best[:, 2], best[:, 1], -best[:, 0]))[: self.k]]
                left, size = left[bound[left] >= self.least(i)], 4 * size

    def found(self) -> pa.RecordBatch:
        sizes = [len(b) for b in self.best]
        best = np.concatenate([*self.best, np.zeros((0, 3), np.int64)])
        columns = [np.repeat(self.q.rows, sizes), np.repeat(self.q.ids, sizes), best[:, 1], best[:, 2], best[:, 0]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_row", "query_id", "vec_id", "row", "score"])


def _exact(x: np.ndarray, v: np.ndarray) -> bool:
    """Whether inner products are exact in 64-bit floating point."""
    return float(np.abs(x).max(initial=0)) * float(np.abs(v).max(initial=0)) * len(v) < 2**52


def _meet(k: int, pivots: dict[int, tuple[np.ndarray, np.ndarray]]):
    """Pairs (place, block of queries, block of candidates); neighbouring pairs of one block of queries at one place are one search."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, search = None, None
        for b in batches:
            for place, q, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if at != (place, q["block"]):
                    if search is not None:
                        yield search.found()
                    at, search = (place, q["block"]), Search(k, Block.of(q), *pivots[q["dim"]])
                search.meet(Block.of(c))
        if search is not None:
            yield search.found()

    return run


def top_k(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each query row, exactly.

    Scores are inner products of floor(scale * x), as whole numbers; ties go to the smaller
    id, then to the earlier row. A row never finds itself, but finds repeated rows of its own
    id, which are queries of their own.

    Rows whose id or vector is null, or whose vector holds null, NaN or infinite components,
    take no part; nor do empty vectors. Vectors meet only others of their length. Components
    or scores beyond 64 bits are an error. An empty table, or one row, gives an empty result.

    The more the vectors lie along few directions, the more of them pivots rule out; the
    README has shares. Without any, every candidate of a block is scored, a block at a time.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "topk")
    v = F.col(vector_col)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    sound = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(odd, F.lit(False))
    rows = df.where(sound).select(F.col(id_col).cast("bigint").alias("id"), F.size(v).cast("bigint").alias("dim"), components_of(v, scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked"), F.monotonically_increasing_id().alias("row"))
    rows = scratch.keep(rows, "vectors")

    # one vector for each hash bucket, so that pivots differ however common one vector is
    bucket = F.pmod(F.xxhash64("v"), F.lit(PIVOTS))
    picked = rows.groupBy("dim", bucket.alias("bucket")).agg(F.min_by(F.struct("row", "v"), F.struct(F.xxhash64(F.lit(1), "id"), "row")).alias("p")).orderBy("dim", "bucket").collect()  # PIVOTS rows a length
    pivots: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in sorted({r["dim"] for r in picked}):
        own = [r["p"] for r in picked if r["dim"] == dim]
        pivots[dim] = (np.array([p["row"] for p in own], np.int64), np.array([p["v"] for p in own], np.int64))
    vectors = {dim: x for dim, (_, x) in pivots.items()}

    def blocks(some: DataFrame, most: int) -> DataFrame:
        dealt = some.select(F.spark_partition_id().alias("part"), "dim", "row", "id", "v")
        return dealt.mapInArrow(_pack(vectors, most), BLOCKS)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    count, asked = rows.agg(F.count(F.lit(1)), F.count_if("asked")).first()
    spread = lambda some, n, most: some.repartition(max(1, min(parts, -(-n // most))), F.xxhash64("row"))
    columns = [n.split()[0] for n in BLOCKS.split(", ")]
    candidates = scratch.keep(blocks(spread(rows, count, BLOCK), BLOCK), "candidates")
    places = max(1, min(parts, candidates.count()))
    candidates = candidates.select(F.pmod(F.xxhash64("block"), F.lit(places)).alias("place"), "dim", F.struct(*columns).alias("c"))
    queries = scratch.keep(blocks(spread(rows.where("asked"), asked, QUERY_BLOCK), QUERY_BLOCK), "queries")
    queries = queries.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(places - 1).cast("bigint"))).alias("place"), "dim", F.struct(*columns).alias("q"))
    # a sort-merge join streams the queries, so all pairs of a block of queries come together; any order is right
    pairs = queries.hint("merge").join(candidates, ["place", "dim"]).select("place", "q", "c")
    found = scratch.keep(pairs.mapInArrow(_meet(k, pivots), "query_row bigint, query_id bigint, vec_id bigint, row bigint, score bigint"), "found")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLE_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
      FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
