"""The bounded training sample that both classifiers fit on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a classifier is fitted on at most: those of least hash.
TRAINING_ROWS = 8192


def remainder(id_col: str, mod: int) -> Column:
    """crc32 of the id as text modulo mod; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(mod)).cast("int")


def training_rows(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, y) of at most ``rows`` labelled documents, chosen by hash of the id.

    The chosen ids are a bounded table and are broadcast, so only their texts are shuffled.
    Rows without id or label are left out; of labels or texts that differ for one id the
    greater counts.
    """
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & usable)
        .groupBy(id_col)
        .agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64(F.lit("train"), id_col), id_col)
        .limit(rows)
    )
    texts = docs.select(id_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), id_col)
    return found.groupBy(id_col).agg(F.max("text").alias("text"), F.max("y").alias("y")).select("text", "y")
