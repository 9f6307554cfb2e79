"""A training corpus from ``documents``: clean, deduplicate, mix, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's docs. All but the last return the columns of documents.
Every stage reads whole texts of any length, takes null texts as empty ones, and turns an
empty table into an empty one; columns that it does not name pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidestep.llm.common import Scratch, recording, table, tidy
from tidestep.llm.exact_dedup import one_of_each_text
from tidestep.llm.mixing import emitted, mix_sources
from tidestep.llm.packing import pack_documents
from tidestep.llm.simhash import one_of_each_similar
from tidestep.llm.toxicity import clean_documents


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Each row is judged by its text alone, so repeated rows and rows without id share a fate;
    an empty text is scored like any other.
    """
    tidy(spark)
    return clean_documents(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document of smallest id stays.

    Null and empty texts are equal. Null ids come last; of rows of one id the first stays.
    """
    tidy(spark)
    return one_of_each_text(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar texts (five-word shingles, Jaccard 0.8 or more, through chains), the document of smallest id stays.

    Candidates come from SimHash tables and are compared in full. Texts without words are one
    group. Null ids come last; of rows of one id and like texts the first stays.
    """
    tidy(spark)
    return one_of_each_similar(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; where a source's budget ends inside a document, a copy of its first words.

    Documents without words weigh nothing in a mix of words and are not in it. Null sources
    are one source. Rows of one id are ordered by size, so reruns agree.
    """
    tidy(spark)
    out = emitted(mix_sources(docs)).select(*docs.columns)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in sequences.

    A text without tokens is the end token alone. Repeated rows are packed each.
    """
    tidy(spark)
    return pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_dedup", drop_near_copies),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL has no SimHash and no tokenizer; tests/llm/test_pipeline.py holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        with recording() as made:
            before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.keep(docs, name)
            for s in made:  # what the stage itself wrote on the way
                s.drop()
            if k:
                scratch.drop(before)
    return docs
