"""Source metadata rules: status, acceptance, authority, times, question routing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loglattice.functions.text import strip

# Status words, chunk sizes and overlaps per source, and the word
# lists that route a question.
RESOLVED = ["resolved", "done", "closed"]
DEPRECATED = ["deprecated", "obsolete"]
OPEN = ["open", "todo", "in_progress", "in progress"]
STATUS_KEYS = ["resolution_status", "jira_status", "status"]
WINDOW_SOURCES = ["runbook", "github"]
PARAGRAPH_SOURCES = ["jira", "slack"]
WINDOW_SIZE, WINDOW_OVERLAP, PARAGRAPH_SIZE = 512, 64, 256
QUANTITATIVE = [r"\bcount\b", r"\bhow many\b", r"\bsum\b", r"\baverage\b"]
DOCS_ONLY = [r"\bbest practice\b", r"\bhow to\b", r"\barchitecture\b"]
TROUBLESHOOTING = [r"\bwhy\b", r"\bfailed\b", r"\berror\b", r"\bcause\b"]


def resolution_status(metadata: Column) -> Column:
    """First non-empty status key of a string map, mapped to four values."""
    raw = F.coalesce(*[F.nullif(metadata[key], F.lit("")) for key in STATUS_KEYS])
    word = F.lower(strip(raw))
    return (
        F.when(word.isin(RESOLVED), "resolved")
        .when(word.isin(DEPRECATED), "deprecated")
        .when(word.isin(OPEN), "open")
        .otherwise("unknown")
    )


def is_accepted(flag: Column) -> Column:
    """True only for a boolean true."""
    return F.coalesce(flag, F.lit(False))


def authority_tier(
    source_type: Column, status: Column, accepted: Column, merged: Column
) -> Column:
    return (
        F.when(source_type == "runbook", "A")
        .when((source_type == "github") & F.coalesce(merged, F.lit(False)), "A")
        .when((source_type == "jira") & (status == "resolved") & accepted, "A")
        .otherwise("B")
    )


def utc(value: Column) -> Column:
    """Timestamp from ISO text; a value without an offset is UTC (the session zone)."""
    return F.try_to_timestamp(value)


def _any(text: Column, patterns: list[str]) -> Column:
    return text.rlike("(?U)(?:" + "|".join(patterns) + ")")


def route(question: Column) -> Column:
    """``struct<logs_needed, docs_needed, is_quantitative, is_qualitative>``."""
    lowered = F.lower(question)
    docs_only = _any(lowered, DOCS_ONLY)
    logs_only = ~docs_only & _any(lowered, QUANTITATIVE) & ~_any(lowered, TROUBLESHOOTING)
    return F.struct(
        (~docs_only).alias("logs_needed"),
        (~logs_only).alias("docs_needed"),
        logs_only.alias("is_quantitative"),
        (~logs_only).alias("is_qualitative"),
    )


def context_sufficient(
    logs_needed: Column,
    hit_count: Column,
    docs_needed: Column | None = None,
    chunk_count: Column | None = None,
    logs_failed: Column | None = None,
    docs_failed: Column | None = None,
) -> Column:
    """Log hits present when logs are needed; the document and failure rules if given."""
    enough = ~(logs_needed & (F.coalesce(hit_count, F.lit(0)) == 0))
    if docs_needed is not None and chunk_count is not None:
        enough = enough & ~(docs_needed & (F.coalesce(chunk_count, F.lit(0)) == 0))
    if logs_failed is not None and docs_failed is not None:
        enough = enough & ~(logs_failed & docs_failed)
    return enough
