"""A keyed memory table ``(key, value, saved_at, seq)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglattice.operators.scale import latest_wins, running_total

XML_ROWS_PER_PART = 1000

# The memory block's format.
OPENING, CLOSING = "<memories>\n", "</memories>"
ELEMENT = '  <memory key="%s">%s</memory>\n'


def save(memories: DataFrame) -> DataFrame:
    """Current row per key: the latest save replaces earlier ones."""
    return latest_wins(memories, ["key"], [F.desc("saved_at"), F.desc("seq")])


def fetch_one(memories: DataFrame, wanted: DataFrame) -> DataFrame:
    """Value per requested key, the empty string when absent."""
    return wanted.join(memories.select("key", "value"), "key", "left").withColumn(
        "value", F.coalesce("value", F.lit(""))
    )


def fetch_many(memories: DataFrame, wanted: DataFrame) -> DataFrame:
    """Existing, non-empty values of ``wanted(request_id, pos, key)``; ``pos`` keeps the order."""
    return wanted.join(memories.where(F.col("value") != "").select("key", "value"), "key")


def number(rows: DataFrame, group: str, ask: str) -> DataFrame:
    """Dense 1-based ``pos`` per request by an integer ``ask`` order, for requests of any length."""
    segment = F.floor(F.col(ask) / XML_ROWS_PER_PART)
    return running_total(rows, [group], segment, [F.asc(ask), F.asc("key")], F.lit(1), "pos")


def fetch_prefix(memories: DataFrame, prefix: str | Column) -> DataFrame:
    """Keys starting with a literal prefix; ``%`` and ``_`` have no special meaning."""
    start = prefix if isinstance(prefix, Column) else F.lit(prefix)
    return memories.where(F.startswith(F.col("key"), start))


def remove(memories: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remaining rows, and per requested key whether it existed."""
    found = doomed.join(memories.select("key", F.lit(True).alias("found")), "key", "left")
    report = found.select("key", F.coalesce("found", F.lit(False)).alias("found"))
    return memories.join(doomed.select("key"), "key", "left_anti"), report


def list_keys(memories: DataFrame) -> DataFrame:
    return memories.select("key", "saved_at").orderBy("saved_at", "key")


def memory_element(key: Column, value: Column) -> Column:
    return F.format_string(ELEMENT, key, value)


def render_xml(rows: DataFrame, group: str, rows_per_part: int = XML_ROWS_PER_PART) -> DataFrame:
    """``<memories>`` text per request from rows carrying a dense 1-based ``pos``.

    Long requests come as consecutive ``part`` rows of bounded size: joined in order
    they are the block.  Usually there is one part.
    """
    parted = rows.withColumn("part", F.floor((F.col("pos") - 1) / rows_per_part))
    pieces = parted.groupBy(group, "part").agg(
        F.array_sort(F.collect_list(F.struct("pos", "key", "value"))).alias("items")
    )
    ends = Window.partitionBy(group)
    body = F.array_join(
        F.transform("items", lambda m: memory_element(m["key"], m["value"])), ""
    )
    first = F.when(F.col("part") == F.min("part").over(ends), OPENING).otherwise("")
    last = F.when(F.col("part") == F.max("part").over(ends), CLOSING).otherwise("")
    return pieces.select(group, "part", F.concat(first, body, last).alias("xml"))
