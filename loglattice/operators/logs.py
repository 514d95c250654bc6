"""Log search results: normalisation, caps, totals, status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_RESULTS, HARD_CAP = 500, 2000  # fixed values
# Output field and the source fields it is read from, in order.
HIT_FIELDS = [
    ("timestamp", ["@timestamp"]),
    ("service", ["service.name", "service"]),
    ("level", ["log.level", "level"]),
    ("message", ["message"]),
    ("trace_id", ["trace.id", "trace_id"]),
]


def _resolve(schema: T.StructType, name: str) -> Column | None:
    if name in schema.fieldNames():
        flat = schema[name].dataType
        return None if isinstance(flat, T.StructType) else F.col(f"`{name}`")
    current: T.DataType = schema
    for part in name.split("."):
        if not isinstance(current, T.StructType) or part not in current.fieldNames():
            return None
        current = current[part].dataType
    return F.col(".".join(f"`{p}`" for p in name.split(".")))


def normalise_hits(df: DataFrame, extras: Sequence[str] = ()) -> DataFrame:
    """The five hit fields, each from the first source field present; null when none is."""
    columns = []
    for out, names in HIT_FIELDS:
        found = [c for c in (_resolve(df.schema, n) for n in names) if c is not None]
        value = F.coalesce(*found) if found else F.lit(None).cast("string")
        columns.append(value.alias(out))
    return df.select(*columns, *extras)


def result_size(max_results: int | None) -> int:
    return min(max_results or DEFAULT_RESULTS, HARD_CAP)


def capped(df: DataFrame, order: Sequence[Column], max_results: int | None = None) -> DataFrame:
    """First rows in a fixed order, at most the hard cap."""
    return df.orderBy(*order).limit(result_size(max_results))


def hit_totals(matched: DataFrame, max_results: int | None = None) -> DataFrame:
    """All matches, and how many of them a capped answer returns."""
    total = F.count(F.lit(1))
    return matched.agg(
        total.alias("total"), F.least(total, F.lit(result_size(max_results))).alias("returned")
    )


def result_status(timed_out: Column, shards_failed: Column) -> Column:
    return F.when(timed_out | (shards_failed > 0), "partial").otherwise("success")
