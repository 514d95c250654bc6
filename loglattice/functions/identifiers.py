"""Technical identifiers: tagging, extraction, and survival after compaction."""

from __future__ import annotations

import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Kinds in order of precedence, pattern, captured group, ignore case.
KINDS = [
    ("IP_ADDR", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", 0, False),
    (
        "TRACE_ID",
        r"\b(?:trace|trace_id|trace-id|span|span_id|span-id)[=:]\s*([A-Za-z0-9-]{6,64})\b",
        1,
        True,
    ),
    ("HASH", r"\b[0-9a-f]{7,40}\b", 0, False),
    ("PATH", r"(?<!<)(?:/[^\s<>]+)+", 0, False),
    ("ERROR_CODE", r"\b(?:ERR|E)[A-Z0-9_]{2,}\b", 0, False),
]

_COMPILED = [(k, re.compile(p, re.IGNORECASE if i else 0), g) for k, p, g, i in KINDS]


def tag_string(text: str) -> str:
    """Wrap identifiers as ``<KIND:value>``.

    Kinds claim text in order of precedence; a match that touches claimed text is
    dropped whole, so claimed spans stay disjoint and sorted.
    """
    starts: list[int] = []
    spans: list[tuple[int, int, str]] = []
    for kind, pattern, group in _COMPILED:
        for found in pattern.finditer(text):
            start, end = found.span(group)
            at = bisect_left(starts, end)
            if at and spans[at - 1][1] > start:
                continue
            starts.insert(at, start)
            spans.insert(at, (start, end, kind))
    if not spans:
        return text
    pieces, done = [], 0
    for start, end, kind in spans:
        pieces += (text[done:start], "<", kind, ":", text[start:end], ">")
        done = end
    pieces.append(text[done:])
    return "".join(pieces)


@F.pandas_udf(T.StringType())
def tag_identifiers(text: pd.Series) -> pd.Series:
    """Arrow-batched tagging; needs match positions, which no built-in returns."""
    return pd.Series([None if t is None else tag_string(t) for t in text], dtype=object)


def _pattern(kind: str) -> tuple[str, int]:
    _, pattern, group, ignore_case = next(row for row in KINDS if row[0] == kind)
    return f"(?U{'i' if ignore_case else ''}){pattern}", group


def tag_single(text: Column, kind: str) -> Column:
    """Tag one whole-match kind with built-ins."""
    pattern, group = _pattern(kind)
    if group:
        raise ValueError(f"{kind} tags only part of its match")
    return F.regexp_replace(text, pattern, f"<{kind}:$0>")


def extract(text: Column, kind: str) -> Column:
    """All values of one kind, in text order."""
    pattern, group = _pattern(kind)
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def extract_all(text: Column) -> Column:
    """``array<struct<kind, value>>`` over the five kinds."""

    def labelled(kind: str) -> Column:
        return F.transform(
            extract(text, kind), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
        )

    return F.concat(*[labelled(kind) for kind, *_ in KINDS])


# Fixed value: the shape of a tag.
TAG = r"<(?:IP_ADDR|TRACE_ID|HASH|PATH|ERROR_CODE):[^<>]+>"


def tags(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(TAG), F.lit(0)))


def lost_tags(original: Column, compacted: Column) -> Column:
    """Tags of the original that its compacted form no longer holds."""
    return F.array_except(tags(original), tags(compacted))


def reinject(original: Column, compacted: Column) -> Column:
    """Append the lost tags to the compacted text."""
    return F.concat_ws(" ", compacted, F.array_join(lost_tags(original, compacted), " "))
