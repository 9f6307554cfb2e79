"""Numbering and looking back over a whole ordered table without gathering it in one task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of one block of a look-back; each block also gets the last rows of the block before it.
BLOCK = 1 << 18
NUMBER = "__obs_n"
TOTAL = "__obs_total"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the folder that ``spark.checkpoint.dir`` names, so that numbering is done once."""
    spark: SparkSession = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidestep-")
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/tidestep/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keys(order: list[str]) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in order]


def numbered(df: DataFrame, order: list[str], number: str = NUMBER, total: str = TOTAL, dry: bool = False) -> DataFrame:
    """df with a 1-based place in the order and the number of rows; dry: with columns that only have these names and types.

    Range partitions are sorted each on its own; the numbers of earlier partitions' rows are
    added, a table with one row for each partition.
    """
    if dry:
        return df.withColumns({number: F.lit(1).cast("bigint"), total: F.lit(1).cast("bigint")})
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = "__obs_at"
    placed = df.repartitionByRange(parts, *keys(order)).sortWithinPartitions(*keys(order)).withColumn(at, F.monotonically_increasing_id())
    placed = written(placed, "numbered")
    part, within = F.shiftright(at, 33), F.col(at).bitwiseAND((1 << 33) - 1)
    before = Window.orderBy("__obs_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(part.alias("__obs_part")).agg(F.count(F.lit(1)).alias("__obs_c"))
    offsets = offsets.select("__obs_part", F.coalesce(F.sum("__obs_c").over(before), F.lit(0)).alias("__obs_o"), F.sum("__obs_c").over(Window.partitionBy()).alias(total))
    out = placed.withColumn("__obs_part", part).join(F.broadcast(offsets), "__obs_part")  # one row a partition
    return out.withColumn(number, F.col("__obs_o") + within + 1).drop("__obs_part", "__obs_o", at)


def look_back(df: DataFrame, wanted: dict[str, tuple[str, int]], number: str = NUMBER) -> DataFrame:
    """df, which is numbered, with each new column: the value of a column n rows before.

    Rows are dealt out in blocks of the numbering; the last rows of a block go to the next one
    as well, so no block needs another.
    """
    most = max(n for _, n in wanted.values())
    own, block = "__obs_own", "__obs_block"
    size = max(BLOCK, most)
    place = F.col(number) - 1
    blocks = F.when(place % size >= size - most, F.array(own, F.col(own) + 1)).otherwise(F.array(own))
    dealt = df.withColumn(own, F.floor(place / size)).withColumn(block, F.explode(blocks))
    window = Window.partitionBy(block).orderBy(number)
    out = dealt.withColumns({name: F.lag(c, n).over(window) for name, (c, n) in wanted.items()})
    return out.where(F.col(block) == F.col(own)).drop(own, block)
