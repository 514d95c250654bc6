"""Ranking arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loglattice.functions.text import split_words, tokens

# Fusion smoothing, decay rate, boosts, and the question classes.
WRRF_K = 60
DECAY = 0.02
TIER_A, ACCEPTED, DEPRECATED = 1.25, 1.15, 0.3
ERROR_CODE = r"\b(?:ERR|E)[A-Z0-9_]{2,}\b"
HEX_ID = r"\b[0-9a-f]{8,}\b"
PATH = r"(?<!<)(?:/[^\s<>]+)+"
TECHNICAL_WEIGHTS, PROSE_WEIGHTS, MIXED_WEIGHTS = (0.3, 0.7), (0.7, 0.3), (0.5, 0.5)
SYMBOLS = r"[{}\[\]_\\]"


def query_weights(question: Column, error_code_ignores_case: bool = False) -> Column:
    """``struct<w_dense, w_sparse>`` by question class.

    Ignoring case makes any word of three letters starting with "e" technical; the
    default matches codes as they are written, in capitals.
    """
    code = f"(?U{'i' if error_code_ignores_case else ''}){ERROR_CODE}"
    technical = (
        question.rlike(code) | question.rlike(f"(?Ui){HEX_ID}") | question.rlike(f"(?U){PATH}")
    )
    prose = (F.size(split_words(question)) > 3) & ~question.rlike(SYMBOLS)

    def weight(side: int) -> Column:
        return (
            F.when(technical, TECHNICAL_WEIGHTS[side])
            .when(prose, PROSE_WEIGHTS[side])
            .otherwise(MIXED_WEIGHTS[side])
        )

    return F.struct(weight(0).alias("w_dense"), weight(1).alias("w_sparse"))


def wrrf_term(weight: Column, rank: Column, k: int = WRRF_K) -> Column:
    """``weight / (k + rank)``; an absent rank contributes 0."""
    return F.coalesce(weight * (F.lit(1.0) / (F.lit(k) + rank)), F.lit(0.0))


def recency_factor(created_at: Column, now: Column, decay: float = DECAY) -> Column:
    """Exponential decay by age in days; the future counts as today."""
    micros = F.unix_micros(now.cast("timestamp")) - F.unix_micros(created_at.cast("timestamp"))
    days = F.greatest(F.lit(0.0), micros / F.lit(86_400_000_000.0))
    return F.exp(-F.lit(decay) * days)


def authority_score(
    fused: Column, reranked: Column, tier: Column, accepted: Column, status: Column, recency: Column
) -> Column:
    return (
        F.coalesce(reranked, fused)
        * F.when(tier == "A", TIER_A).otherwise(1.0)
        * F.when(accepted, ACCEPTED).otherwise(1.0)
        * F.when(status == "deprecated", DEPRECATED).otherwise(1.0)
        * recency
    )


def token_overlap(query: Column, content: Column) -> Column:
    """Share of the distinct query tokens present in the content."""
    asked = F.array_distinct(tokens(query))
    found = F.size(F.array_intersect(asked, tokens(content)))
    return F.when(F.size(asked) > 0, found / F.size(asked)).otherwise(F.lit(0.0))


def clamp_confidence(payload: Column) -> Column:
    """``confidence`` of a JSON report: a number into [0, 1], another type 0.5, absent null."""
    value = F.try_variant_get(F.try_parse_json(payload), "$.confidence", "variant")
    numeric = F.schema_of_variant(value).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|BOOLEAN)")
    number = F.try_variant_get(value, "$", "double")
    clamped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), number))
    return F.when(value.isNotNull(), F.when(numeric, clamped).otherwise(0.5))


def confidence(
    supporting: Column, total_hits: Column, chunks: Column, max_chunks: Column, verified: Column
) -> Column:
    """0.6 log-support share, 0.3 chunk share, 0.1 verified edge; an empty base counts 0."""
    share = lambda part, whole: F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
    return (
        share(supporting, total_hits) * 0.6
        + share(chunks, max_chunks) * 0.3
        + F.when(verified, 0.1).otherwise(0.0)
    )


def bm25_idf(df: Column, n: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25_weight(
    tf: Column, df: Column, dl: Column, n: Column, avgdl: Column, k1: float = 1.2, b: float = 0.75
) -> Column:
    return bm25_idf(df, n) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
