"""Best-fit packing of token pieces into sequences by a linear grouping scheme.

Lengths are whole numbers up to the capacity, so the whole problem is a histogram of at most
``capacity`` numbers; the plan is made from it on the driver and has as many parts as lengths
and configurations meet, however many documents there are.

1. Large lengths, in descending order, are cut into groups of equal cardinality and rounded
   up to the longest of their group. Groups that one frequent length fills have one size and
   count as one group.
2. A linear program over all configurations of these few sizes gives how often to use each.
3. Actual documents take the places of rounded ones, which leaves room.
4. What rounding down left over, and then the small lengths, go best-fit into the room that
   is left, and then into new sequences.

The plan says for the r-th piece of a length where it goes. Pieces are numbered by length in
parallel: a hash deals them to buckets (more the more pieces, up to a bound), bucket counts
give offsets, and each bucket is sorted on its own.
"""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidestep.llm.common import HIDDEN, Scratch, table
from tidestep.llm.tokens import byte_ids

CAPACITY = 1024
END_ID = 2
GROUPS = 128
#: Lengths over capacity / LARGE are large.
LARGE = 4
ROWS_A_BUCKET = 256
#: Buckets of one length at most, so that the running sum over its buckets stays small.
MOST_BUCKETS = 1 << 14


class Plan:
    """Places for pieces: for each length, parts (first rank, first sequence, offset in it); ranks of a part go to consecutive sequences."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity, self.left, self.used = capacity, {n: c for n, c in counts.items() if c}, dict.fromkeys(counts, 0)
        self.parts: list[tuple[int, int, int, int, int]] = []  # length, first rank, count, first sequence, offset
        self.sequences = 0
        self.room: dict[int, list[tuple[int, int]]] = {}  # room -> ranges of sequences (first, count)
        assert all(0 < n <= capacity for n in self.left)
        self._put_new(capacity, self.left.get(capacity, 0), 1)
        self._configurations()
        for n in sorted(self.left, reverse=True):
            self._best_fit(n)

    def _take(self, length: int, count: int, first: int, offset: int) -> None:
        """The next pieces of a length go to sequences first, first + 1, ..."""
        self.parts.append((length, self.used[length], count, first, offset))
        self.used[length] += count
        self.left[length] -= count

    def _free(self, room: int, first: int, count: int) -> None:
        if room and count:
            ranges = self.room.setdefault(room, [])
            if ranges and sum(ranges[-1]) == first:
                ranges[-1] = (ranges[-1][0], ranges[-1][1] + count)
            else:
                ranges.append((first, count))

    def _put_new(self, length: int, sequences: int, each: int) -> None:
        """New sequences of ``each`` pieces of one length."""
        if sequences:
            for k in range(each):
                self._take(length, sequences, self.sequences, k * length)
            self._free(self.capacity - each * length, self.sequences, sequences)
            self.sequences += sequences

    def _configurations(self) -> None:
        large = sorted((n for n, c in self.left.items() if c and n * LARGE > self.capacity), reverse=True)
        total = sum(self.left[n] for n in large)
        if not total:
            return
        groups: list[list[list[int]]] = []  # of [length, count], longest first
        size, room = -(-total // GROUPS), 0
        for n in large:
            count = self.left[n]
            while count:
                if not room:
                    groups.append([])
                    room = max(size, count)  # one length needs no second group of the same size
                now = min(room, count)
                groups[-1].append([n, now])
                room, count = room - now, count - now
        groups.reverse()  # ascending sizes
        need = np.array([sum(c for _, c in g) for g in groups], float)
        for config, times in cover(np.array([g[0][0] for g in groups]), need, self.capacity).items():
            times = int(min([int(times + 1e-7), *(sum(c for _, c in groups[g]) // config.count(g) for g in set(config))]))
            if times <= 0:
                continue
            slots = []  # of each place in the configuration, the actual lengths that fill it
            for g in config:
                want, got = times, []
                while want:
                    n, c = groups[g][0]
                    now = min(want, c)
                    got.append([n, now])
                    groups[g][0][1] -= now
                    want -= now
                    if not groups[g][0][1]:
                        groups[g].pop(0)
                slots.append(got)
            done = 0
            while done < times:
                step = min(s[0][1] for s in slots)
                offset = 0
                for s in slots:
                    self._take(s[0][0], step, self.sequences + done, offset)
                    offset += s[0][0]
                    s[0][1] -= step
                    if not s[0][1]:
                        s.pop(0)
                self._free(self.capacity - offset, self.sequences + done, step)
                done += step
            self.sequences += times

    def _best_fit(self, length: int) -> None:
        while self.left[length]:
            room = min((r for r, ranges in self.room.items() if r >= length and ranges), default=0)
            if not room:
                each = self.capacity // length
                whole, rest = divmod(self.left[length], each)
                self._put_new(length, whole, each)
                if rest:
                    self._put_new(length, 1, rest)
                return
            first, count = self.room[room].pop()
            now = min(count, self.left[length])
            self._take(length, now, first, self.capacity - room)
            self._free(room - length, first, now)
            self._free(room, first + now, count - now)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys (length << 44 | first rank), first ranks, first sequences and offsets of the parts."""
        p = np.array(sorted(self.parts), np.int64).reshape(-1, 5)
        return (p[:, 0] << 44) | p[:, 1], p[:, 1], p[:, 3], p[:, 4]


def _best_configuration(sizes: np.ndarray, price: np.ndarray, capacity: int) -> tuple[float, tuple[int, ...]]:
    """The configuration of greatest total price that fits the capacity: an unbounded knapsack. sizes: ascending."""
    best, chosen = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for room in range(int(sizes[0]), capacity + 1):
        gain = best[room - sizes[: fits[room]]] + price[: fits[room]]
        k = int(gain.argmax())
        if gain[k] > best[room - 1]:
            best[room], chosen[room] = gain[k], k
        else:
            best[room] = best[room - 1]
    out, room = [], capacity
    while room > 0 and best[room] > 0:
        if chosen[room] < 0:
            room -= 1
        else:
            out.append(int(chosen[room]))
            room -= int(sizes[chosen[room]])
    return float(best[capacity]), tuple(sorted(out))


def cover(sizes: np.ndarray, need: np.ndarray, capacity: int, rounds: int = 5000) -> dict[tuple[int, ...], float]:
    """How often to use each configuration so that all needs are met by the fewest uses in total.

    A linear program over all configurations, solved by the revised simplex method; a
    knapsack finds the configuration that enters. sizes: ascending.
    """
    m = len(need)
    configs: list[tuple[int, ...]] = [(g,) * int(capacity // sizes[g]) for g in range(m)]
    basis = np.diag([float(len(c)) for c in configs])
    x = need * (1 + 1e-9 * np.arange(1, m + 1)) / np.diag(basis)  # a trace of difference keeps the method from cycling
    for step in range(rounds + 1):
        if step == rounds:  # every basis meets all needs; more rounds would only save sequences
            warnings.warn(f"the linear program was not solved in {rounds} rounds; its last solution is used", stacklevel=2)
            break
        price = np.linalg.solve(basis.T, np.ones(m))
        gain, config = _best_configuration(sizes, np.maximum(price, 0), capacity)
        if gain < 1 + 1e-6:
            break
        column = np.bincount(config, minlength=m).astype(float)
        move = np.linalg.solve(basis, column)
        ratio = np.where(move > 1e-9, x / np.where(move > 1e-9, move, 1), np.inf)
        out = int(np.argmin(ratio))
        x = np.maximum(x - ratio[out] * move, 0)
        x[out], configs[out], basis[:, out] = ratio[out], config, column
    found: dict[tuple[int, ...], float] = {}
    for c, v in zip(configs, x, strict=True):
        found[c] = found.get(c, 0) + float(v)
    return found


def _pieces(capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for k, text in enumerate(batch.column(1)):
                ids = np.append(byte_ids(text.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                start, n = 0, len(ids)
                end = n % capacity or min(n, capacity)
                piece = 0
                while start < n:
                    part = ids[start:end]
                    for column, value in zip(out, (k, piece, start, end - start, zlib.crc32(part), part.tobytes() if with_ids else None), strict=True):
                        column.append(value)
                    piece, start, end = piece + 1, end, end + capacity
            columns = [batch.column(0).take(pa.array(out[0], pa.int64())), *(pa.array(c, pa.int64()) for c in out[1:5])]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(out[5], pa.binary())] if with_ids else [])], names=["id", "piece", "start", "length", "crc", *(["ids"] if with_ids else [])])

    return run


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """One row per piece: id, ``piece, start, length, ids_crc32, sequence_id, offset`` and, if asked for, ``ids`` (little-endian uint32).

    A document is its token ids and the end id. Only a longer document than the capacity is
    cut, into pieces of the capacity of which the first may be shorter. In a sequence, pieces
    lie without gaps from offset 0.

    Null and empty texts are documents of the end id alone. Null ids and repeated rows are
    packed like others. Texts of any length are tokenized whole. An empty table gives an empty
    result. Other columns are not read.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "pack")
    kind = df.schema[id_col].dataType.simpleString()
    slim = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {kind}, piece bigint, start bigint, length bigint, crc bigint" + (", ids binary" if with_ids else "")
    pieces = scratch.keep(slim.mapInArrow(_pieces(capacity, with_ids), schema).withColumn("piece", F.col("piece").cast("int")), "pieces")

    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = spark.sparkContext.broadcast(Plan(counts, capacity).arrays())
    spread = spark.createDataFrame([(int(n), min(MOST_BUCKETS, -(-c // ROWS_A_BUCKET))) for n, c in counts.items()], "length bigint, buckets bigint")
    key = F.xxhash64("id", "piece", "crc")
    keyed = pieces.join(F.broadcast(spread), "length").withColumn("bucket", F.pmod(key, "buckets")).drop("buckets")
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keyed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    offsets = offsets.select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy(key, "id", "piece", "start", "crc")
    ranked = keyed.withColumn("rank", F.row_number().over(within) - 1).join(offsets, ["length", "bucket"])

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, first, sequence, offset = plan.value
        at = np.searchsorted(keys, (length.to_numpy(np.int64) << 44) | rank.to_numpy(np.int64), side="right") - 1
        return pd.DataFrame({"sequence_id": sequence[at] + rank.to_numpy(np.int64) - first[at], "offset": offset[at]})

    out = ranked.withColumn(f"{HIDDEN}place", place("length", F.col("rank") + F.col("before")))
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", F.col("crc").alias("ids_crc32"), f"{HIDDEN}place.*", *(["ids"] if with_ids else []))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), with_ids=False)
