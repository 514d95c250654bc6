"""The corpus pipeline: language, exact copies, near copies, benchmark leaks, packing.

Each stage is a function of (spark, docs, sf_dir) and works on all that the one before it kept.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.llm import common as c
from loglattice.llm.decontamination import clean
from loglattice.llm.exact_dedup import copies
from loglattice.llm.language_id import UNKNOWN, identified, trained
from loglattice.llm.ngram_jaccard_join import representatives
from loglattice.llm.packing import query_packing
from loglattice.llm.registry import query


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts in no language that was learned: null, empty and letterless ones.  Every row is
    judged by its own text; an empty table, or one without labels, leaves nothing."""
    found = identified(docs, trained(docs))
    return found.where(F.col("lang_pred") != UNKNOWN).select(*docs.columns)


def _digest(text: Column) -> Column:
    return F.sha2(c.ascii_lower(F.coalesce(text, F.lit(""))).cast("binary"), 256)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased, null as empty) the row with the largest id stays; rows without
    an id come last; of rows that repeat it too, one.  An empty table stays empty."""
    kept = copies(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_own"), _digest(F.col("text")).alias("_digest"))
    same = F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_sha"))
    return own.join(kept, same, "left_semi").dropDuplicates(["_own", "_digest"]).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near copies stays, that with the smallest id; rows without an id
    are grouped too and come last.  Rows without words all stay.  An empty table stays empty."""
    return representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark item go; rows of the same id, or without one, are judged
    each by its own text.  Null texts and, with an empty benchmark, all rows stay."""
    return clean(docs, c.table(spark, sf_dir, "benchmark")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in sequences of 2048 tokens; every row is packed, repeated ids and null ones
    included.  An empty table gives no pieces."""
    return query_packing(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]
ORACLE_SQL = None  # language identification and tokens are beyond SQL; tests hold it against brute force


@query("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = c.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
