"""Service-dependency graph ``(src, dst)``: expansion, checks, hypothesis ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.operators.scale import top_k

MAX_HYPOTHESES, PRUNE_AT = 3, 2  # fixed values


def expand_hints(hints: DataFrame, edges: DataFrame) -> DataFrame:
    """``(request_id, hint)`` plus ``dep-*`` for every dependency of a hinted service."""
    service = F.replace(F.col("hint"), F.lit("-*"), F.lit(""))
    added = (
        hints.withColumn("src", service)
        .join(edges.select("src", "dst").distinct(), "src")
        .select("request_id", F.concat("dst", F.lit("-*")).alias("hint"))
    )
    return hints.select("request_id", "hint").unionByName(added).distinct()


def check_edges(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """Add ``reason`` to claimed edges: unknown source, unknown target, or null when valid."""
    known = edges.select("src", "dst").distinct()
    sources = known.groupBy("src").agg(F.lit(True).alias("_known_src"))
    return (
        claims.join(sources, "src", "left")
        .join(known.withColumn("_known_edge", F.lit(True)), ["src", "dst"], "left")
        .withColumn(
            "reason",
            F.when(F.col("_known_src").isNull(), "E008: unknown source")
            .when(F.col("_known_edge").isNull(), "E008: no such edge"),
        )
        .drop("_known_src", "_known_edge")
    )


def check_time_order(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Flag claimed failure times later than the first symptom of (query, service)."""
    first = evidence.groupBy("query_id", "service").agg(F.min("ts").alias("first_symptom"))
    return claims.join(first, ["query_id", "service"], "left").withColumn(
        "violates", F.coalesce(F.col("claimed_at") > F.col("first_symptom"), F.lit(False))
    )


def rank_hypotheses(hypotheses: DataFrame, k: int = MAX_HYPOTHESES) -> DataFrame:
    """Fewest contradictions, then most support; two or more contradictions drop out."""
    return top_k(
        hypotheses.where(F.col("contradictions") < PRUNE_AT),
        ["query_id"],
        [F.asc("contradictions"), F.desc("supporting_evidence_count"), F.asc("id")],
        k,
    )
