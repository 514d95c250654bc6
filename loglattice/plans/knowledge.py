"""Hybrid retrieval: dense and sparse candidates, fusion, reranking, authority."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.functions import scoring
from loglattice.operators import retrieval
from loglattice.operators.scale import fetch_rows, top_k


def retrieve(
    questions: DataFrame,
    chunks: DataFrame,
    max_chunks: int,
    index: DataFrame | None = None,
    sparse: Callable[[DataFrame, DataFrame, int], DataFrame] = retrieval.sparse_bm25,
    scorer: Callable[[Column, Column], Column] = scoring.token_overlap,
    recency_now: datetime | None = None,
) -> DataFrame:
    """Best ``max_chunks`` chunks of every question in one job.

    ``questions(query_id, question, vector[, not_after, source_filters, max_chunks])``; a
    question's own ``max_chunks`` bounds its candidates and its answer (null: the argument), its
    ``source_filters`` the chunks it meets.  ``chunks`` is the stored chunk table with ``vector``
    and metadata.  With ``index``, the stored term index of those chunks
    (carrying ``created_at`` and ``source_type`` when questions are bounded), texts are read only for the few
    candidates reranked; without it ``sparse`` ranks the texts.  With ``recency_now`` the
    stored recency score is replaced by decay up to that moment.
    """
    limits = None
    if "max_chunks" in questions.columns:
        limits = questions.select("query_id", F.coalesce("max_chunks", F.lit(max_chunks)).alias("_limit"))
        max_chunks = max(1, limits.agg(F.max("_limit")).first()[0] or 1)

    def within(ranked: DataFrame, factor: int, rank: str = "rank") -> DataFrame:
        """The rows of each question's own limit."""
        if limits is None:
            return ranked
        return ranked.join(limits, "query_id").where(F.col(rank) <= F.col("_limit") * factor).drop("_limit")

    fetch = max_chunks * retrieval.CANDIDATES
    asked = questions.select(
        "query_id", "question", *[c for c in retrieval.BOUNDS if c in questions.columns]
    )
    dense = within(retrieval.dense_by_source(questions.drop("max_chunks"), chunks, fetch), retrieval.CANDIDATES)
    weights = questions.select("query_id", scoring.query_weights(F.col("question")).alias("w")).select(
        "query_id", "w.*"
    )
    if index is not None:
        terms = retrieval.rank_bm25(asked, index, fetch)
    else:
        terms = sparse(asked, chunks, fetch)
    fused = retrieval.fuse(dense, within(terms, retrieval.CANDIDATES), weights)
    best = top_k(
        fused, ["query_id"], [F.desc("score"), F.asc("chunk_id")],
        max_chunks * retrieval.RERANKED, "fused_rank",
    )
    best = within(best, retrieval.RERANKED, "fused_rank")
    payload = chunks.drop("vector")
    if recency_now is not None:
        now = F.lit(recency_now).cast("timestamp")
        payload = payload.withColumn("recency_score", scoring.recency_factor(F.col("created_at"), now))
    found = fetch_rows(payload, best, "chunk_id", questions, max_chunks * retrieval.RERANKED)
    candidates = found.join(questions.select("query_id", "question"), "query_id")
    return within(retrieval.authority_rank(retrieval.rerank(candidates, scorer), max_chunks), 1)
