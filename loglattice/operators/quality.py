"""Run-log metrics, retrieval quality, and lint of saved filter strings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.functions import text as tx
from loglattice.operators.scale import exact_percentile

# Histogram bounds in seconds, and the lint patterns.
BUCKETS = [0.5, 1.0, 2.0, 3.0, 5.0, 6.0, 10.0, 15.0]
DOUBLED = r"(?i)\b(AND\s+AND|OR\s+OR|NOT\s+NOT|AND\s+OR|OR\s+AND)\b"
STARTS = r"(?i)^\s*(AND|OR)\s+"
ENDS = r"(?i)\s+(AND|OR|NOT)\s*$"
NO_VALUE = r"(?iU)([\w.@]+)\s*:\s*(?=AND\b|OR\b|NOT\b|$)"
FIELD_USE = r"(?U)([\w.@]+)\s*[:<>!=]"
OPERATORS = ["AND", "OR", "NOT"]

# Lint messages.
EMPTY = "KQL string is empty."
UNEXPECTED = "Unexpected closing '%s' at position %d."
MISMATCHED = "Mismatched bracket: opened with '%s' at position %d but closed with '%s' at position %d."
UNCLOSED = "Unclosed '%s' at position %d."
DOUBLED_MESSAGE = "Double or conflicting boolean operator: %s"
STARTS_MESSAGE = "KQL expression starts with a boolean operator (AND/OR)."
ENDS_MESSAGE = "KQL expression ends with a boolean operator (AND/OR/NOT)."
NO_VALUE_MESSAGE = "Field '%s' has a colon but no value."
UNKNOWN_MESSAGE = "Field '%s' not found in schema."


def latency_histogram(runs: DataFrame, seconds: str, group: Sequence[str] = ()) -> DataFrame:
    """Cumulative bucket counts in long form; ``le`` null is the total."""
    s = F.col(seconds)
    counts = runs.groupBy(*group).agg(
        *[F.count(F.when(s <= b, 1)).alias(f"b{i}") for i, b in enumerate(BUCKETS)],
        F.count(s).alias("b_all"),
    )
    cells = F.array(
        *[
            F.struct(F.lit(b).cast("double").alias("le"), F.col(f"b{i}").alias("n"))
            for i, b in enumerate(BUCKETS)
        ],
        F.struct(F.lit(None).cast("double").alias("le"), F.col("b_all").alias("n")),
    )
    return counts.select(*group, F.inline(cells))


def catalog_age(refreshes: DataFrame, refreshed_at: str, now: Column) -> DataFrame:
    """Seconds since the last refresh."""
    latest = F.unix_micros(F.max(refreshed_at).cast("timestamp"))
    return refreshes.agg(
        ((F.unix_micros(now.cast("timestamp")) - latest) / 1_000_000).alias("age_seconds")
    )


def run_rates(runs: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Quality rates of ``(ok, attempts, exact, unknown_fields, fields, leaked)`` rows."""
    rate = lambda cond: F.avg(cond.cast("double"))
    fields = F.sum("fields")
    return runs.groupBy(*group).agg(
        rate(F.col("ok")).alias("execution_success_rate"),
        rate(F.col("attempts") > 0).alias("refinement_rate"),
        F.avg("attempts").alias("mean_attempts"),
        F.sum("attempts").alias("total_attempts"),
        rate(F.col("exact")).alias("exact_match"),
        F.when(fields > 0, F.sum("unknown_fields") / fields).otherwise(0.0).alias("hallucination_rate"),
        rate(F.col("leaked")).alias("leak_rate"),
    )


def p95(runs: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    return exact_percentile(runs, group, value, 0.95, "p95")


def retrieval_quality(ranking: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Recall@k and mean reciprocal rank of a ranking against (query_id, doc_id) truth.

    Ranking rows are (query_id, doc_id, rank); a question without truth is not counted.
    """
    cut = ranking.where(F.col("rank") <= k)
    found = cut.join(truth, ["query_id", "doc_id"], "left_semi")
    per_query = found.groupBy("query_id").agg(
        F.countDistinct("doc_id").alias("hits"), F.min("rank").alias("best")
    )
    wanted = truth.groupBy("query_id").agg(F.countDistinct("doc_id").alias("n_true"))
    return (
        wanted.join(per_query, "query_id", "left")
        .agg(
            F.count(F.lit(1)).alias("n_queries"),
            F.sum("n_true").alias("n_true"),
            F.sum(F.coalesce("hits", F.lit(0))).alias("n_found"),
            F.avg(F.coalesce(F.col("hits") / F.col("n_true"), F.lit(0.0))).alias("recall"),
            F.avg(F.coalesce(1.0 / F.col("best"), F.lit(0.0))).alias("mrr"),
        )
    )


# --------------------------------------------------------------------------- lint


def bracket_error(kql: Column) -> Column:
    """First unbalanced bracket with its 0-based position, else null.

    Texts holding a bracket are folded over their brackets, carrying the stack of open ones.
    """
    chars = F.transform(
        F.split(kql, ""), lambda c, i: F.struct(c.alias("c"), i.cast("int").alias("i"))
    )
    brackets = F.filter(chars, lambda x: x["c"].isin("(", ")", "{", "}"))
    stack_type = "array<struct<c:string,i:int>>"
    start = F.struct(
        F.array().cast(stack_type).alias("open"), F.lit(None).cast("string").alias("bad")
    )

    def step(acc: Column, x: Column) -> Column:
        top = F.try_element_at(acc["open"], F.lit(-1))
        opens = x["c"].isin("(", "{")
        partner = F.when(x["c"] == ")", "(").otherwise("{")
        unexpected = F.format_string(UNEXPECTED, x["c"], x["i"])
        mismatch = F.format_string(MISMATCHED, top["c"], top["i"], x["c"], x["i"])
        bad = (
            F.when(acc["bad"].isNotNull(), acc["bad"])
            .when(opens, F.lit(None).cast("string"))
            .when(F.size(acc["open"]) == 0, unexpected)
            .when(top["c"] != partner, mismatch)
        )
        popped = F.slice(acc["open"], F.lit(1), F.greatest(F.size(acc["open"]) - 1, F.lit(0)))
        left = F.when(opens, F.concat(acc["open"], F.array(x))).otherwise(popped)
        return F.struct(left.alias("open"), bad.alias("bad"))

    def finish(acc: Column) -> Column:
        top = F.try_element_at(acc["open"], F.lit(-1))
        unclosed = F.format_string(UNCLOSED, top["c"], top["i"])
        return F.coalesce(acc["bad"], F.when(F.size(acc["open"]) > 0, unclosed))

    return F.when(kql.rlike(r"[(){}]"), F.aggregate(brackets, start, step, finish))


def doubled_operators(kql: Column) -> Column:
    return F.regexp_extract_all(kql, F.lit(DOUBLED), F.lit(1))


def dangling_operator(kql: Column) -> Column:
    return (
        F.when(kql.rlike(STARTS), STARTS_MESSAGE).when(kql.rlike(ENDS), ENDS_MESSAGE)
    )


def fields_without_value(kql: Column) -> Column:
    found = F.regexp_extract_all(kql, F.lit(NO_VALUE), F.lit(1))
    return F.filter(found, lambda name: ~F.upper(name).isin(OPERATORS))


def used_fields(kql: Column) -> Column:
    """Distinct field names a filter string uses."""
    found = F.regexp_extract_all(kql, F.lit(FIELD_USE), F.lit(1))
    return F.array_distinct(F.filter(found, lambda name: ~F.upper(name).isin([*OPERATORS, "NOW"])))


def unknown_fields(saved: DataFrame, catalog: DataFrame) -> DataFrame:
    """``(query_id, field)`` used but absent from the query's catalog ``(query_id, field)``.

    Queries without any catalog row are not checked.
    """
    used = saved.select("query_id", F.explode(used_fields(F.col("kql"))).alias("field"))
    checked = used.join(catalog.select("query_id").distinct(), "query_id", "left_semi")
    return checked.join(catalog.select("query_id", "field"), ["query_id", "field"], "left_anti")


def lint(saved: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """``valid`` and ``errors`` for every saved filter string ``(query_id, kql)``."""
    rows = saved.withColumn("kql", tx.strip(F.col("kql")))
    doubled = doubled_operators(F.col("kql"))
    errors = F.array_compact(
        F.concat(
            F.array(
                bracket_error(F.col("kql")),
                F.when(
                    F.size(doubled) > 0,
                    F.format_string(DOUBLED_MESSAGE, F.array_join(doubled, ", ")),
                ),
                dangling_operator(F.col("kql")),
            ),
            F.transform(
                fields_without_value(F.col("kql")),
                lambda f: F.format_string(NO_VALUE_MESSAGE, f),
            ),
        )
    )
    checked = rows.withColumn(
        "errors",
        F.when(F.col("kql") == "", F.array(F.lit(EMPTY))).otherwise(errors),
    )
    if catalog is not None:
        unknown = unknown_fields(rows, catalog).groupBy("query_id").agg(
            F.array_sort(
                F.collect_set(F.format_string(UNKNOWN_MESSAGE, F.col("field")))
            ).alias("_unknown")
        )
        checked = checked.join(unknown, "query_id", "left").withColumn(
            "errors",
            F.concat("errors", F.coalesce("_unknown", F.array().cast("array<string>"))),
        ).drop("_unknown")
    return checked.withColumn("valid", F.size("errors") == 0)
