"""What several operators of this subpackage share: inputs, scratch tables, column hygiene."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import ClassVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space of every contract, as the inside of a regex class.
SPACES = r"\x20\x09-\x0D"
#: Internal columns start with this, so that no input column is likely to clash.
HIDDEN = "__td_"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset and Spark runs in one process (tests), a local
    folder is made; on a cluster a missing setting is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = sc._jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else None
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tidestep-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


#: Removes the shuffle files of a query when it has ended, without waiting for the driver's garbage collector.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of the batches in which rows go to Python; a longer row is a batch of its own.
#: Executor and worker hold a batch several times over, and keep the room when it is done.
BATCH, BATCH_BYTES = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def tidy(spark: SparkSession) -> None:
    """From now on the session's queries remove their shuffle files as they end, and send Python no more than about BATCH bytes at once."""
    spark.conf.set(CLEANUP, "true")
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_BYTES)) > BATCH:  # a smaller limit stays
        spark.conf.set(BATCH_BYTES, f"{BATCH}b")


class Scratch:
    """Tables written to the shared folder, which cut lineage and survive lost executors.

    An operator that gives its result as a table of its own drops the rest itself. One whose
    result still reads scratch tables leaves them; ``recording`` lets the caller drop these
    when the result is written.
    """

    recorders: ClassVar[list[list[Scratch]]] = []

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{scratch_dir(spark)}/tidestep/{label}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.held: list[DataFrame] = []
        for made in Scratch.recorders:
            made.append(self)

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        """df written as Parquet and read again; its shuffle files go at once."""
        path = f"{self.root}/{len(self.paths)}-{name}"
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.select("*").write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(kept)] = path
        self.held.append(kept)  # so that no other frame gets its id
        return kept

    def drop(self, df: DataFrame | None = None) -> None:
        """Delete the files of one kept table, or all of them."""
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.root if df is None else self.paths[id(df)])
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def recording() -> Iterator[list[Scratch]]:
    """The Scratch objects made inside the block."""
    made: list[Scratch] = []
    Scratch.recorders.append(made)
    try:
        yield made
    finally:
        Scratch.recorders.remove(made)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that would clash with an operator's output.

    Names that begin with ``__td_`` are the operators' own; an input that has one is an error.
    """
    if own := [c for c in df.columns if c.lower().startswith(HIDDEN)]:
        raise ValueError(f"columns {own} have the prefix of internal ones; rename them")
    low = {n.lower() for n in names}
    gone = [c for c in df.columns if c.lower() in low]
    return df.drop(*gone) if gone else df


def join_facts(rows: DataFrame, facts: DataFrame, key: str, how: str = "inner", parts: int = 1024) -> DataFrame:
    """rows joined with facts, which have one row for a key, without hot keys in the shuffle.

    Keys that hold more than 1/parts of all rows are fewer than ``parts``: their facts are
    broadcast. rows should be a written table, for it is read three times.
    """
    total = rows.count()
    heavy = rows.groupBy(key).agg(F.count(F.lit(1)).alias(f"{HIDDEN}n")).where(F.col(f"{HIDDEN}n") * parts > total).select(key)
    light = rows.join(F.broadcast(heavy), key, "left_anti").join(facts, key, how)
    hot = facts.join(F.broadcast(heavy), key, "left_semi") if how == "inner" else heavy.join(facts, key, how)
    return light.unionByName(rows.join(F.broadcast(hot), key))


def filled(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def nulls_last(col: str) -> Column:
    """A sortable struct that puts nulls after all values."""
    return F.struct(F.col(col).isNull().alias("none"), F.col(col).alias("v"))
