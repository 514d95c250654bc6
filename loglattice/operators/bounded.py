"""Exact top-k over a stored term index, without meeting common tokens.

Every token carries the largest contribution it makes in any chunk.  The rare tokens of a question
are ranked first; their k-th score is a floor under the k-th score of the whole question.  Tokens
whose largest contributions add up to less than the floor cannot lift a chunk into the answer by
themselves, so no (question, chunk) row is made for them.  The other tokens name the candidates;
the common tokens are then looked up for those candidates alone whose bound reaches the floor.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglattice.functions import scoring
from loglattice.functions.predicates import as_of
from loglattice.operators.retrieval import question_terms
from loglattice.operators.scale import fits_broadcast, top_k, written

K1, B = 1.2, 0.75
SEED_ROWS = 8  # a question's rarest tokens are ranked first, until they have 8 k postings
MARGIN = 1e-6  # sums of doubles in another order, and scores rounded to nine places


@dataclass(frozen=True)
class TermStats:
    """Of a stored index: per token its document frequency and largest chunk parts
    (``token, df, top_tf, top_bm25``), and the corpus figures (``n, avgdl``, one row)."""

    tokens: DataFrame
    corpus: DataFrame


def tf_part() -> Column:
    return F.col("tf") / F.col("max_tf")


def bm25_part(avgdl: Column) -> Column:
    """A token's part of the BM25 score that the chunk decides."""
    return F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / avgdl))


def term_stats(index: DataFrame) -> TermStats:
    """Figures of a term index ``(chunk_id, token, tf, dl, max_tf)``, one row per token.

    A common token is summed up by every task before it is shuffled.
    """
    per_chunk = index.groupBy("chunk_id").agg(F.first("dl").alias("dl"))
    corpus = per_chunk.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("dl").alias("avgdl"))
    tokens = index.groupBy("token").agg(
        F.count(F.lit(1)).alias("df"),
        F.max(tf_part()).alias("top_tf"),
        F.max(bm25_part(per_chunk.agg(F.avg("dl")).scalar())).alias("top_bm25"),
    )
    return TermStats(tokens, corpus)


def save_stats(stats: TermStats, root: str) -> None:
    """Store the figures beside the index, once per ingest."""
    stats.tokens.write.mode("overwrite").parquet(f"{root}/tokens")
    stats.corpus.write.mode("overwrite").parquet(f"{root}/corpus")


def load_stats(spark, root: str) -> TermStats:
    return TermStats(spark.read.parquet(f"{root}/tokens"), spark.read.parquet(f"{root}/corpus"))


def _met(index: DataFrame, terms: DataFrame, part: Column, limits: list[str], hint: Callable) -> DataFrame:
    """(query_id, chunk_id, part) of every posting of the given terms that the question may see."""
    met = index.join(hint(terms), "token")
    if "not_after" in limits:
        met = met.where(F.col("not_after").isNull() | as_of(F.col("created_at"), F.col("not_after")))
    if "sources" in limits:
        met = met.where(F.col("sources").isNull() | F.array_contains("sources", F.col("source_type")))
    return met.select("query_id", "chunk_id", (F.col("factor") * part).alias("part"))


def split_terms(index: DataFrame, terms: DataFrame, part: Column, k: int, limits: list[str]) -> DataFrame:
    """``terms`` (query_id, token, df, factor, top, limits) with ``floor``, ``essential``, ``rest``.

    ``essential`` tokens name candidates; ``rest`` is what all others of the question can add.
    Without a floor (fewer than k chunks hold a rare token) all tokens are essential.
    """
    hint = F.broadcast if fits_broadcast(terms) else (lambda df: df)
    rarest = Window.partitionBy("query_id").orderBy("df", "token").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("df").over(rarest), F.lit(0))
    seeds = terms.withColumn("_before", before).where(F.col("_before") < SEED_ROWS * k).drop("_before")
    partial = _met(index, seeds, part, limits, hint).groupBy("query_id", "chunk_id").agg(F.sum("part").alias("part"))
    best = top_k(partial, ["query_id"], [F.desc("part")], k, "_rn")
    floors = best.where(F.col("_rn") == k).select("query_id", F.col("part").alias("floor"))
    largest = F.col("factor") * F.col("top")
    weakest = Window.partitionBy("query_id").orderBy(largest, "token")
    upto = F.sum(largest).over(weakest.rowsBetween(Window.unboundedPreceding, 0))
    split = (
        terms.join(floors, "query_id", "left")
        .withColumn("essential", F.coalesce(upto >= F.col("floor") - MARGIN, F.lit(True)))
    )
    whole = Window.partitionBy("query_id")
    return split.withColumn("rest", F.coalesce(F.sum(F.when(~F.col("essential"), largest)).over(whole), F.lit(0.0)))


def candidates(index: DataFrame, split: DataFrame, part: Column, limits: list[str], hint: Callable) -> DataFrame:
    """(query_id, chunk_id, part): chunks with an essential token whose bound reaches the floor."""
    keep = ["query_id", "token", "factor", *limits]
    named = _met(index, split.where("essential").select(*keep), part, limits, hint)
    sums = named.groupBy("query_id", "chunk_id").agg(F.sum("part").alias("part"))
    bounds = split.groupBy("query_id").agg(F.first("floor").alias("floor"), F.first("rest").alias("rest"))
    reach = F.col("floor").isNull() | (F.col("part") + F.col("rest") >= F.col("floor") - MARGIN)
    return sums.join(hint(bounds), "query_id").where(reach).select("query_id", "chunk_id", "part")


def _ranked(index: DataFrame, terms: DataFrame, part: Column, k: int, limits: list[str]) -> DataFrame:
    terms = written(terms, "terms")
    split = written(split_terms(index, terms, part, k, limits), "split-terms")
    hint = F.broadcast if fits_broadcast(split) else (lambda df: df)
    found = written(candidates(index, split, part, limits, hint), "candidates")
    common = split.where("NOT essential").select("query_id", "token", "factor")
    lookups = found.select("query_id", "chunk_id").join(hint(common), "query_id")
    if fits_broadcast(lookups):
        added = index.join(F.broadcast(lookups), ["chunk_id", "token"])
        parts = found.unionByName(added.select("query_id", "chunk_id", (F.col("factor") * part).alias("part")))
    else:  # bounds that leave so many candidates save nothing: all tokens are met where the postings lie
        parts = _met(index, split.select("query_id", "token", "factor", *limits), part, limits, hint)
    scores = parts.groupBy("query_id", "chunk_id").agg(F.round(F.sum("part"), 9).alias("score"))
    return top_k(scores, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)


def _limits(questions: DataFrame) -> list[str]:
    return [c for c in ("not_after", "sources") if c in questions.columns]


def _terms(questions: DataFrame) -> DataFrame:
    """Tokens of the questions with their tf / max tf and the questions' limits."""
    limits = _limits(questions)
    weighted = question_terms(questions.select("query_id", "question", *[c for c in limits if c == "not_after"]))
    if "sources" in limits:
        weighted = weighted.join(questions.select("query_id", "sources"), "query_id")
    return weighted


def bounded_tf_dot(questions: DataFrame, index: DataFrame, k: int, stats: TermStats | None = None) -> DataFrame:
    """``retrieval.rank_tf_dot``, row for row.

    ``questions(query_id, question[, not_after][, sources])``; the index carries ``created_at`` and
    ``source_type`` where questions are limited by them.  A null limit admits all.
    """
    stats = stats or term_stats(index)
    terms = _terms(questions).withColumnRenamed("qw", "factor").join(stats.tokens, "token").withColumnRenamed("top_tf", "top")
    return _ranked(index, terms.drop("top_bm25"), tf_part(), k, _limits(questions))


def bounded_bm25(questions: DataFrame, index: DataFrame, k: int, stats: TermStats | None = None) -> DataFrame:
    """``retrieval.rank_bm25``, row for row, with the usual constants; limits as above."""
    stats = stats or term_stats(index)
    corpus = stats.corpus.first()
    n, avgdl = F.lit(corpus["n"]), F.lit(corpus["avgdl"])
    idf = scoring.bm25_idf(F.col("df"), n)
    terms = _terms(questions).drop("qw").join(stats.tokens, "token").withColumn("factor", idf)
    return _ranked(index, terms.withColumnRenamed("top_bm25", "top").drop("top_tf"), bm25_part(avgdl), k, _limits(questions))
