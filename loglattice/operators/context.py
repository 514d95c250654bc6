"""Budgeted, ordered context for conversations and evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglattice.functions import text as tx
from loglattice.operators.scale import running_total, top_k

LAST_MESSAGES = 20  # fixed value: messages a session keeps
TURNS_PER_SEGMENT = 256


def last_messages(messages: DataFrame, n: int = LAST_MESSAGES) -> DataFrame:
    """Newest ``n`` messages per conversation; rank 1 is the newest."""
    return top_k(messages, ["conv_id"], [F.desc("turn")], n)


def edge_position(rank0: Column, size: Column) -> Column:
    """0-based place that puts the best items at both edges and the weakest in the middle."""
    half = F.floor(rank0 / 2)
    return F.when(rank0 % 2 == 0, half).otherwise(size - 1 - half).cast("bigint")


def reorder(ranked: DataFrame, group: Sequence[str], rank: str = "rank") -> DataFrame:
    """Add ``position`` to rows ranked from 1; groups are already cut to a bounded size."""
    size = F.count(F.lit(1)).over(Window.partitionBy(*group))
    return ranked.withColumn("position", edge_position(F.col(rank) - 1, size))


def within_budget(
    rows: DataFrame,
    group: Sequence[str],
    segment: Column,
    order: Sequence[Column],
    tokens: Column,
    budget: Column | int,
    segment_desc: bool = False,
) -> DataFrame:
    """Rows in order until the running token sum would pass the budget; adds ``used``."""
    limit = budget if isinstance(budget, Column) else F.lit(budget)
    total = running_total(rows, group, segment, order, tokens, "used", segment_desc)
    return total.where(F.col("used") <= limit)


def prune_tiered(evidence: DataFrame, budget: int) -> DataFrame:
    """Tiered pruning of ``(query_id, kind, item_id, tier, ts, message, rank, tokens)``.

    Items leave in three waves until the rest fits: tier-B chunks oldest first, then
    repeats of a log message, then tier-A chunks beyond the best three.  Read from the
    keep end this is one running sum; items in no wave always stay.
    """
    first = top_k(
        evidence.where(F.col("kind") == "log").select("query_id", "message", "ts", "item_id"),
        ["query_id", "message"],
        [F.asc("ts"), F.asc("item_id")],
        1,
        "_rn",
    ).select("query_id", "item_id", F.lit(True).alias("first_of_message"))
    best = top_k(
        evidence.where((F.col("kind") == "chunk") & (F.col("tier") == "A")).select(
            "query_id", "item_id", F.col("rank").alias("r")
        ),
        ["query_id"],
        [F.asc("r"), F.asc("item_id")],
        3,
        "_rn",
    ).select("query_id", "item_id", F.lit(True).alias("best_of_tier"))
    marked = evidence.join(
        first.withColumn("kind", F.lit("log")), ["query_id", "kind", "item_id"], "left"
    ).join(best.withColumn("kind", F.lit("chunk")), ["query_id", "kind", "item_id"], "left")
    wave = (
        F.when((F.col("kind") == "chunk") & (F.col("tier") == "B"), 1)
        .when((F.col("kind") == "log") & F.col("first_of_message").isNull(), 2)
        .when((F.col("kind") == "chunk") & F.col("best_of_tier").isNull(), 3)
        .otherwise(4)
    )
    # keep order: highest wave first, newest first inside a wave
    waved = marked.withColumn("wave", wave)
    day = F.datediff(F.col("ts"), F.lit("1970-01-01").cast("date"))
    kept = running_total(
        waved,
        ["query_id"],
        F.struct((-F.col("wave")).alias("w"), (-day).alias("d")),
        [F.desc("wave"), F.desc("ts"), F.asc("kind"), F.asc("item_id")],
        F.col("tokens"),
        "used",
    )
    return kept.where((F.col("used") <= budget) | (F.col("wave") == 4)).drop(
        "first_of_message", "best_of_tier"
    )


def bursts(events: DataFrame, group: Sequence[str], ts: str, gap_seconds: int = 300) -> DataFrame:
    """Sessions separated by gaps of at least ``gap_seconds``, safe for hot groups.

    Rows first collapse to one per (group, gap-wide tile): two rows in a tile are
    closer than the gap, so they share a session.  Only tiles are then sorted.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    tiles = (
        events.withColumn("_us", micros)
        .groupBy(*group, F.floor(F.col("_us") / (gap_seconds * 1_000_000)).alias("_tile"))
        .agg(F.min("_us").alias("_lo"), F.max("_us").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    )
    ordered = Window.partitionBy(*group).orderBy("_tile")
    starts = F.coalesce(
        F.col("_lo") - F.lag("_hi").over(ordered) >= gap_seconds * 1_000_000, F.lit(True)
    )
    numbered = tiles.withColumn("_start", starts.cast("int")).withColumn(
        "burst", F.sum("_start").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    )
    return numbered.groupBy(*group, "burst").agg(
        F.timestamp_micros(F.min("_lo")).alias("burst_start"),
        F.timestamp_micros(F.max("_hi")).alias("last_event"),
        F.sum("_n").alias("n_events"),
    )


def region_totals(regions: DataFrame, group: Sequence[str], budget: int) -> DataFrame:
    """Token totals of the four regions ``(region, text)`` and the remaining budget."""
    names = ["memory", "fetched", "conversation", "output"]
    tokens = tx.token_estimate(F.col("text"))
    totals = regions.groupBy(*group).agg(
        *[
            F.coalesce(F.sum(F.when(F.col("region") == n, tokens)), F.lit(0)).alias(f"t_{n}")
            for n in names
        ]
    )
    total = sum((F.col(f"t_{n}") for n in names), F.lit(0))
    return totals.withColumn("total", total).withColumn("remaining", F.lit(budget) - total)


def assemble(rows: DataFrame, budget: Column) -> DataFrame:
    """Fit memory, fetched, conversation and output text columns into a token budget.

    The budget must be positive, and memory and output must fit as they are, else ``error``
    is set and ``context`` is null.  Too long a fetched
    text is cut at its end to half of what remains; the conversation gets the rest and
    loses its oldest characters.
    """
    tok = tx.token_estimate
    text = lambda name: F.coalesce(F.col(name), F.lit(""))
    part = lambda c: F.when(c != "", F.concat(c, F.lit("\n"))).otherwise("")
    return (
        rows.withColumn("_room", budget - tok(text("memory")) - tok(text("output")))
        .withColumn(
            "_fetched",
            F.when(
                tok(text("fetched")) > F.col("_room"),
                tx.truncate_back(text("fetched"), F.floor(F.col("_room") / 2)),
            ).otherwise(text("fetched")),
        )
        .withColumn("_left", F.col("_room") - tok(F.col("_fetched")))
        .withColumn(
            "_convo",
            F.when(
                tok(text("conversation")) > F.col("_left"),
                tx.truncate_front(text("conversation"), F.col("_left")),
            ).otherwise(text("conversation")),
        )
        .withColumn(
            "context",
            F.when(
                (budget > 0) & (F.col("_room") >= 0),
                F.concat(part(text("memory")), part(F.col("_fetched")), part(F.col("_convo")), text("output")),
            ),
        )
        .withColumn(
            "error",
            F.when(budget <= 0, "budget is not positive").when(
                F.col("_room") < 0, "budget exceeded by required regions"
            ),
        )
        .drop("_room", "_fetched", "_left", "_convo")
    )


def conversation_tail(messages: DataFrame, max_tokens: int | Column) -> DataFrame:
    """Newest messages joined by newlines, just enough to fill ``max_tokens`` (of the conversation).

    Whole older messages that a cut from the front would remove anyway are left out
    before anything is gathered, so a group holds a bounded number of characters.
    """
    chars = F.length("text") + 1
    needed = max_tokens * 4 + 3
    kept = running_total(
        messages, ["conv_id"], F.floor(F.col("turn") / TURNS_PER_SEGMENT), [F.desc("turn")],
        chars, "_chars", segment_desc=True,
    ).where(F.col("_chars") - chars <= needed)
    listed = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return kept.groupBy("conv_id").agg(
        F.array_join(F.transform(listed, lambda m: m["text"]), "\n").alias("conversation")
    )
