"""Mixing sources to target weights, in DataFrame operations only.

Every document gets a hash-random key. Within each source, documents are ordered by that
key: the key's leading bits name a range bucket, the bucket sums give distributed prefix
sums, and a running sum inside each bucket completes them. A source's word budget is then
cut exactly: whole epochs, then the documents in key order up to the budget, the last one
in part. Buckets are even because keys are hashes, so a source that holds a third of all
rows is spread like any other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidestep.llm.common import HIDDEN, SPACES, Scratch, filled, table, without

OUT = ("size", "source_size", "target", "taken")
ROWS_A_BUCKET = 256
MOST_BUCKET_BITS = 16


def words(text_col: str) -> Column:
    return F.regexp_count(filled(text_col), F.lit(f"[^{SPACES}]+")).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """The target of each source; sources: one row each, with none, name, source_size.

    Sources by code point, null last, take the weights in turn. A target stops at ``most``
    times its source's size and the excess is shared again by weight: with sources in
    ascending order of most * size / weight, the stopped ones are a prefix of that order,
    so running sums find the level at which the others settle.
    """
    h = lambda n: F.col(f"{HIDDEN}{n}")
    everything = Window.orderBy(h("none"), h("name"))
    turn = (F.row_number().over(everything) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long")
    level = Window.orderBy(h("ratio"), h("none"), h("name"))
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy()
    cap = F.col("source_size") * most
    out = sources.withColumn(f"{HIDDEN}w", weight).withColumn(f"{HIDDEN}ratio", cap.cast("double") / h("w"))
    left = F.sum("source_size").over(total).cast("double") * F.lit(float(share)) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    weight_left = F.sum(h("w")).over(total) - F.coalesce(F.sum(h("w")).over(before), F.lit(0))
    out = out.withColumns({f"{HIDDEN}level": left / weight_left, f"{HIDDEN}n": F.row_number().over(level)})
    out = out.withColumn(f"{HIDDEN}stopped", cap <= h("w") * h("level"))
    settled = F.min(F.when(~h("stopped"), F.struct(h("n"), h("level")))).over(total)[f"{HIDDEN}level"]
    target = F.when(h("stopped"), cap.cast("double")).otherwise(h("w") * settled)
    return out.withColumn("target", target).select(f"{HIDDEN}none", f"{HIDDEN}name", "source_size", "target")


def mix_sources(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.0,
    most: int = 3,
    seed: str = "mix",
    carry: bool = True,
) -> DataFrame:
    """df with ``size, source_size, target, taken``; without the text unless ``carry``.

    size: words of the text; taken: words that the mix takes of this row, repeats counted.
    A source's taken words sum to the whole part of its target; no row gives more than
    ``most`` times its size. Keys come from the seed and the id, so reruns agree.

    Null and empty texts have size 0 and give nothing. Null sources are one source, last in
    order. Null ids share one key; rows that share a key are ordered by id, size and row, so
    repeated rows each take their own turn. Texts of any length are counted whole. An empty
    table gives an empty result. Input columns named like an output column are replaced.

    Targets are settled in one task over one row a source, so sources may be many (hosts, say)
    but must fit a sort; documents never go there.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "mix")
    h = lambda n: F.col(f"{HIDDEN}{n}")
    df = without(df, *OUT)
    sized = df.withColumns({
        "size": words(text_col),
        f"{HIDDEN}key": F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary")),
        f"{HIDDEN}none": F.col(source_col).isNull(),
        f"{HIDDEN}name": F.coalesce(F.col(source_col).cast("string"), F.lit("")),
        f"{HIDDEN}row": F.monotonically_increasing_id(),
    })
    sized = scratch.keep(sized if carry else sized.drop(text_col), "sizes")
    bits = min(MOST_BUCKET_BITS, max(0, math.ceil(math.log2(max(1, sized.count()) / ROWS_A_BUCKET))))
    bucket = F.shiftright(F.conv(F.substring(h("key"), 1, 4), 16, 10).cast("int"), 16 - bits)
    sized = sized.withColumn(f"{HIDDEN}bucket", bucket)

    own = [f"{HIDDEN}none", f"{HIDDEN}name"]
    sums = scratch.keep(sized.groupBy(*own, f"{HIDDEN}bucket").agg(F.sum("size").alias(f"{HIDDEN}sum")), "sums")
    aims = targets(sums.groupBy(*own).agg(F.sum(f"{HIDDEN}sum").alias("source_size")), weights, share, most)
    earlier = Window.partitionBy(*own).orderBy(f"{HIDDEN}bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn(f"{HIDDEN}offset", F.coalesce(F.sum(h("sum")).over(earlier), F.lit(0))).drop(f"{HIDDEN}sum").join(aims, own)

    within = Window.partitionBy(*own, f"{HIDDEN}bucket").orderBy(h("key"), F.col(id_col), F.col("size"), h("row"))
    run = F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    out = sized.withColumn(f"{HIDDEN}run", run).join(sums, [*own, f"{HIDDEN}bucket"])
    budget = F.floor("target")
    full = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(F.lit(0)).cast("long")
    rest = budget - full * F.col("source_size") - h("offset") - h("run")
    taken = full * F.col("size") + F.greatest(F.lit(0), F.least(rest, F.col("size")))
    return out.withColumn("taken", taken.cast("long")).select(*[c for c in sized.columns if not c.startswith(HIDDEN) and c != "size"], *OUT)


def emitted(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """A mix as documents: each row as often as it is taken, a last copy in part cut after its words.

    Rows of which nothing is taken, so all rows without words, are not in it.
    """
    copy = f"{HIDDEN}copy"
    copies = F.ceil(F.col("taken") / F.greatest(F.col("size"), F.lit(1))).cast("int")
    out = mixed.where(F.col("taken") > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), copies)))
    rest = F.col("taken") - F.col("size") * (F.col(copy) - 1)
    head = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(f"[{SPACES}]*[^{SPACES}]+"), F.lit(0)), F.lit(1), rest.cast("int")), "")
    return out.withColumn(text_col, F.when(rest < F.col("size"), head).otherwise(F.col(text_col))).drop(copy, *OUT)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(docs, carry=False).select("doc_id", *OUT)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix|' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
l AS (
  SELECT *, row_number() OVER o AS n,
         (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / (sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level
  FROM w WINDOW o AS (ORDER BY (3 * source_size)::DOUBLE / w, source NULLS LAST)),
t AS (
  SELECT source, source_size,
         CASE WHEN 3 * source_size <= w * level THEN (3 * source_size)::DOUBLE
              ELSE w * (SELECT arg_min(level, n) FROM l WHERE NOT 3 * source_size <= w * level) END AS target
  FROM l),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS run
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN budget // source_size * size
             + greatest(0, least(budget % source_size - run, size)) ELSE 0 END)::BIGINT AS taken
FROM r
"""
