"""Token ids in files: canonical length-limited Huffman codes over global counts.

Format, under one folder, on any file system that Spark writes to:

* ``code`` (Parquet, one row): version, block size, and the code length of every id. The
  canonical code follows from the lengths.
* ``data`` (Parquet, one row per segment of about SEGMENT ids, whole documents only):
  part, before (ids of the part before this segment), doc_ids, sizes (ids of each document),
  starts (the bit offset of every block, little-endian int64), payload (the coded ids).

Parts are ranges of document ids in ascending order, and ``before`` ascends within a part, so
(part, before) orders all segments. Blocks decode independently from their bit offsets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidestep.llm.common import Scratch, filled, table
from tidestep.llm.huffman import BLOCK, Code, code_lengths
from tidestep.llm.tokens import word_ids

SEGMENT = 1 << 20
END_ID = 2
VOCABULARY = 49_408
#: Bits of the longest code: a table of 65,536 entries decodes in one look-up.
LIMIT = 16
#: Parts are few enough that a row for each may be broadcast.
MOST_PARTS = 65_536


def _tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    end, before = np.array([END_ID], "<u2").tobytes(), 0
    for b in batches:
        ids = [word_ids(t.as_py()) + end for t in b.column(2).cast(pa.binary())]
        size = np.array([len(i) // 2 for i in ids], np.int64)
        at = before + np.cumsum(size) - size
        before += int(size.sum())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at), b.column(1), pa.array(size), pa.array(ids, pa.binary())], names=["part", "before", "id", "n", "ids"])


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(VOCABULARY, np.int64)
    for b in batches:
        for ids in b.column(0):
            total += np.bincount(np.frombuffer(ids.as_py(), "<u2"), minlength=VOCABULARY)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["sym", "n"])


def _segments(code):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        kind = None

        def out() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(r[4] for r in held), "<u2")
            payload, starts = code.value.encode(ids)
            columns = [pa.array([held[0][0]], pa.int32()), pa.array([held[0][1]], pa.int64()), pa.array([[r[2] for r in held]], pa.list_(kind)), pa.array([[r[3] for r in held]], pa.list_(pa.int64())), pa.array([starts.astype("<i8").tobytes()]), pa.array([payload])]
            return pa.RecordBatch.from_arrays(columns, names=["part", "before", "doc_ids", "sizes", "starts", "payload"])

        size = 0
        for b in batches:
            kind = b.schema.field(2).type
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                # a new part, or rows that another task has read, begin a new segment
                if held and (size + row[3] > SEGMENT or row[0] != held[0][0] or row[1] != held[0][1] + size):
                    yield out()
                    held, size = [], 0
                held.append(row)
                size += row[3]
        if held:
            yield out()

    return run


def write_token_files(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of every text, each followed by the end id, in ascending order of id.

    Null and empty texts have the end id alone. Null ids come first. Rows of equal id are
    ordered by a hash of their text; repeated rows stay repeated. Texts of any length are
    written whole. Other columns are not read.
    An empty table gives files without segments.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "tokens")
    kind = df.schema[id_col].dataType.simpleString()
    parts = min(MOST_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    slim = df.select(F.col(id_col).alias("id"), filled(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    ranged = slim.repartitionByRange(parts, "id", "h").sortWithinPartitions("id", "h").select(F.spark_partition_id().alias("part"), "id", "text")
    held = scratch.keep(ranged.mapInArrow(_tokenized, f"part int, before bigint, id {kind}, n bigint, ids binary"), "ids")

    counted = held.select("ids").mapInArrow(_histogram, "sym bigint, n bigint").groupBy("sym").agg(F.sum("n").alias("n")).collect()  # at most one row per id
    counts = np.zeros(VOCABULARY, np.int64)
    for r in counted:
        counts[r["sym"]] = r["n"]
    lengths = code_lengths(counts, LIMIT)
    spark.createDataFrame([(1, BLOCK, bytearray(lengths.tobytes()))], "version int, block int, lengths binary").coalesce(1).write.parquet(f"{path}/code")
    code = spark.sparkContext.broadcast(Code(lengths))
    schema = f"part int, before bigint, doc_ids array<{kind}>, sizes array<bigint>, starts binary, payload binary"
    held.mapInArrow(_segments(code), schema).write.option("compression", "zstd").parquet(f"{path}/data")
    scratch.drop()


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """One row per document: id, ``start`` (ids before it in all files), ``n_tokens``, ``ids_crc32`` and, if asked for, ``ids``."""
    row = spark.read.parquet(f"{path}/code").first()
    if row["version"] != 1 or row["block"] != BLOCK:
        raise ValueError("these files have another format")
    code = spark.sparkContext.broadcast(Code(np.frombuffer(bytes(row["lengths"]), np.uint8)))
    data = spark.read.parquet(f"{path}/data")
    kind = data.schema["doc_ids"].dataType.elementType.simpleString()
    sizes = F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, b: a + b)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = data.groupBy("part").agg(F.sum(sizes).alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, ids, size, starts, payload in zip(*(c for c in b.columns), strict=True):
                n = np.array(size.values, np.int64)
                at = np.cumsum(n) - n
                all_ids = code.value.decode(payload.as_py(), np.frombuffer(starts.as_py(), "<i8"), int(n.sum())).astype("<u4")
                docs = [all_ids[a : a + k] for a, k in zip(at.tolist(), n.tolist(), strict=True)]
                columns = [ids.values, pa.array(at + first.as_py()), pa.array(n), pa.array([zlib.crc32(d) for d in docs], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array([d.tobytes() for d in docs], pa.binary())] if with_ids else [])], names=[id_col, "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])])

    rows = data.join(F.broadcast(offsets), "part").select((F.col("before") + F.col("offset")).alias("first"), "doc_ids", "sizes", "starts", "payload")
    return rows.mapInArrow(decoded, f"`{id_col}` {kind}, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids binary" if with_ids else ""))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "token-files").root
    write_token_files(table(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path, with_ids=False)
