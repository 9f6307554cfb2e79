"""Token counts of whole texts by a finite-state transducer (transducer.py).

A text of up to ``chunk`` characters is one chunk, counted where it is read. A longer one is
cut into chunks that are dealt out over the cluster. Each gives its map from the states in
which it can be entered to the state it is left in and the tokens emitted. Neighbouring maps
of a text compose, FAN of them in a group at each level of a scan over all texts at once, until
one map a text is left. No task sees more than a chunk of a text, or FAN maps.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidestep.llm.common import HIDDEN, Scratch, filled, table, without
from tidestep.llm.transducer import LOOK, Map, chunk_map, compose, cut_points, total, transducer

CHUNK = 32_768
#: Maps that one step of the scan composes.
FAN = 64
LIMIT = 1024
OUT = ("n_bytes", "n_tokens", "over_limit")
MAPS = "row bigint, k bigint, map array<struct<entry: binary, exit: binary, n: bigint, end: bigint>>"


def _cut(chunk: int, look: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, text in zip(b.column(0), b.column(1), strict=True):
                t = text.as_py()
                at = cut_points(t, chunk, name)
                columns = [pa.array([row.as_py()] * len(at), pa.int64()), pa.array(range(len(at)), pa.int64())]
                columns += [pa.array([k <= look for k in at]), pa.array([t[max(0, k - look) : k] for k in at]), pa.array([t[k:z] for k, z in zip(at, [*at[1:], len(t)], strict=True)])]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "k", "at_start", "before", "text"])

    return run


def _stored(m: Map) -> list[dict]:
    return [{"entry": e, "exit": x, "n": n, "end": z} for e, (x, n, z) in m.items()]


def _map(stored: list) -> Map:
    return {bytes(s["entry"]): (bytes(s["exit"]), s["n"], s["end"]) for s in stored}


def _maps(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            maps = [_stored(chunk_map(t, f, s, name)) for s, f, t in zip(*(c.to_pylist() for c in b.columns[2:]), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(maps, KIND)], names=["row", "k", "map"])

    return run


KIND = pa.list_(pa.struct([("entry", pa.binary()), ("exit", pa.binary()), ("n", pa.int64()), ("end", pa.int64())]))


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, k, maps in order) to one map each."""
    for b in batches:
        out = []
        for maps in b.column(2).to_pylist():
            m = _map(maps[0]["map"])
            for other in maps[1:]:
                m = compose(m, _map(other["map"]))
            out.append(_stored(m))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, KIND)], names=["row", "k", "map"])


def scanned(maps: DataFrame, most: int, fan: int = FAN) -> DataFrame:
    """One map a row of maps (row, k, map), k being below ``most``."""
    while most > 1:
        group = maps.groupBy("row", F.floor(F.col("k") / fan).cast("bigint").alias("k")).agg(F.sort_array(F.collect_list(F.struct("k", "map"))).alias("maps"))  # fan maps at most
        maps = group.mapInArrow(_composed, MAPS)
        most = -(-most // fan)
    return maps


def count_tokens(df: DataFrame, text_col: str = "text", name: str = "byte_bpe_50k", chunk: int = CHUNK, look: int = LOOK) -> DataFrame:
    """df without its text, with ``n_bytes, n_tokens, over_limit`` of each whole text.

    Counts are those of the tokenizers library, special strings in a text being one token, and
    no special tokens added. Null and empty texts have none. Very long texts are counted in
    chunks, with or without white space in them; one whose maps do not compose, which needs a
    piece that remembers more than ``look`` characters, is counted in one run. Repeated rows
    are counted each. An empty table gives an empty result. Input columns named like an output
    column are replaced; others pass through.
    """

    @F.pandas_udf("bigint")
    def whole(texts: pd.Series) -> pd.Series:
        return pd.Series(list(map(transducer(name).count, texts)), dtype="int64")

    @F.pandas_udf("bigint")
    def totals(maps: pd.Series) -> pd.Series:
        return pd.Series([total(_map(m), name) for m in maps], dtype="Int64")

    row, text, tokens = f"{HIDDEN}row", f"{HIDDEN}text", F.col("n_tokens")
    df = without(df, *OUT)
    base = df.withColumn(text, filled(text_col)).drop(text_col).withColumn("n_bytes", F.octet_length(text).cast("long"))
    short = base.where(F.length(text) <= chunk).withColumn("n_tokens", whole(text)).drop(text)

    # written once, so that a row has one number however often it is read
    scratch = Scratch(df.sparkSession, "long")
    long = scratch.keep(base.where(F.length(text) > chunk).withColumn(row, F.monotonically_increasing_id()))
    pieces = long.select(F.col(row).alias("row"), F.col(text).alias("text")).mapInArrow(_cut(chunk, look, name), "row bigint, k bigint, at_start boolean, before string, text string")
    maps = scratch.keep(pieces.repartition("row", "k").mapInArrow(_maps(name), MAPS), "maps")
    most = maps.agg(F.coalesce(F.max("k") + 1, F.lit(0))).first()[0]
    counted = scratch.keep(scanned(maps, most).select(F.col("row").alias(row), totals("map").alias("n_tokens")), "counted")
    long = long.join(counted, row).drop(row)
    composed, lost = long.where(tokens.isNotNull()).drop(text), long.where(tokens.isNull()).withColumn("n_tokens", whole(text)).drop(text)
    return short.unionByName(composed).unionByName(lost).withColumn("over_limit", tokens > LIMIT)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
