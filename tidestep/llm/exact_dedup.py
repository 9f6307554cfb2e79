"""Exact deduplication with a heavy-hitter split, in DataFrame operations only.

1. Every row gets the SHA-256 of its normalised text; the narrow table of digests is
   written once.
2. A Misra-Gries pass (``stat.freqItems``, the Karp-Shenker-Papadimitriou counters) with
   ``counters`` slots finds a superset of the digests held by more than 1/counters of all
   rows.
3. These candidates, at most ``counters``, are counted exactly; the verified winners are
   broadcast, and their rows are decided map-side, without a shuffle.
4. All other digests have groups of at most 1/counters of the rows, so an ordinary hash
   shuffle on the digest stays even: a grouped minimum and count, joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidestep.llm.common import HIDDEN, SPACES, Scratch, filled, table, without

OUT = ("keep_id", "group_size", "kept", "text_sha256")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 1024, carry: bool = True) -> DataFrame:
    """df with ``keep_id, group_size, kept, text_sha256``; without the text unless ``carry``.

    Texts are equal when they are after replacing every run of ASCII white space by one
    space. Exactly one row of each group is kept: that with the smallest id.

    Null texts count as empty, so null and empty texts are one group. Null ids come after
    all others; keep_id is null only if the whole group has null ids. Repeated rows (same id
    and text) are ordinary copies of which one stays; ties between rows of one id go to the
    earlier row. Texts of any length count whole, as one digest each. An empty table gives an
    empty result.
    Input columns named like an output column are replaced. Other columns pass through.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "exact")
    row, first = f"{HIDDEN}row", f"{HIDDEN}first"
    df = without(df, *OUT)
    text = F.regexp_replace(filled(text_col), f"[{SPACES}]+", " ")
    keyed = df.withColumn("text_sha256", F.sha2(text.cast("binary"), 256))
    if not carry:
        keyed = keyed.drop(text_col)
    keyed = scratch.keep(keyed.withColumn(row, F.monotonically_increasing_id()), "digests")
    total = keyed.count()
    # the smallest id wins, null ids last, then the row number
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(row).alias("row"))

    winners = None
    if total:
        found = keyed.select("text_sha256").stat.freqItems(["text_sha256"], 1.0 / counters)
        found = found.select(F.explode(found.columns[0]).alias("text_sha256"))
        counted = (
            keyed.join(F.broadcast(found), "text_sha256", "left_semi")
            .groupBy("text_sha256")
            .agg(F.min(order).alias(first), F.count(F.lit(1)).alias("group_size"))
            .where(F.col("group_size") * counters > total)
        )
        winners = scratch.keep(counted, "winners")  # fewer than `counters` rows

    light = keyed if winners is None else keyed.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    # combined map-side; the rows stream past one fact a digest, so no group is ever held
    facts = light.groupBy("text_sha256").agg(F.min(order).alias(first), F.count(F.lit(1)).alias("group_size"))
    parts = light.join(facts, "text_sha256")
    if winners is not None:
        parts = parts.unionByName(keyed.join(F.broadcast(winners), "text_sha256"))
    kept = F.col(first)["row"] == F.col(row)
    return parts.withColumns({"keep_id": F.col(first)["id"], "kept": kept}).select(*[c for c in keyed.columns if c not in (row, "text_sha256")], *OUT)


def one_of_each_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts: that with the smallest id.

    Nulls, ties and repeated rows as in ``exact_dedup``. Columns and texts are those of docs.
    Texts don't go through its shuffles: the rows to drop are a table of their own, which
    Spark broadcasts only while it is small.
    """
    scratch, row = Scratch(docs.sparkSession, "exact-keep"), f"{HIDDEN}n"
    rows = scratch.keep(without(docs).withColumn(row, F.monotonically_increasing_id()), "rows")
    decided = exact_dedup(rows.select(F.col(row).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text", carry=False)
    gone = scratch.keep(decided.where("not kept").select(F.col("row").alias(row)), "gone")
    return rows.join(gone, row, "left_anti").drop(row)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs, carry=False).select("doc_id", *OUT)


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
