"""Field catalogs: building, matching to requests, merging, sampling."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglattice.functions.text import glob_to_regex
from loglattice.operators.scale import latest_wins, top_k

STALE_SECONDS, SAMPLE_VALUES, DESCRIBED_FIELDS, SEMANTIC_K = 300, 5, 15, 2  # fixed values

# Spark type names to catalog type names.
TYPE_NAMES = {
    "string": "keyword", "integer": "integer", "long": "long", "double": "double",
    "float": "float", "boolean": "boolean", "timestamp": "date", "timestamp_ntz": "date",
    "date": "date", "short": "short", "byte": "byte", "binary": "binary", "map": "object",
}
CATALOG_SCHEMA = (
    "index string, pos int, field string, type string, is_nested boolean, nested_path string"
)


def _walk(schema: T.StructType, prefix: str, nested_path: str | None) -> list[tuple]:
    rows: list[tuple] = []
    for f in schema.fields:
        name = f"{prefix}{f.name}"
        kind = f.dataType
        repeated = isinstance(kind, T.ArrayType)
        if repeated:
            kind = kind.elementType
        is_struct = isinstance(kind, T.StructType)
        is_nested = repeated and is_struct
        path = name if is_nested else nested_path
        label = "nested" if is_nested else "object" if is_struct else TYPE_NAMES.get(
            kind.typeName(), kind.typeName()
        )
        rows.append((name, label, is_nested, path))
        if is_struct:
            rows += _walk(kind, f"{name}.", path)
    return rows


def field_catalog(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per field of every visible table, read from the schemas alone."""
    spark = next(iter(tables.values())).sparkSession
    rows = [
        (index, pos, *row)
        for index, df in tables.items()
        if not index.startswith(".")
        for pos, row in enumerate(_walk(df.schema, "", None))
    ]
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def visible(indices: DataFrame) -> DataFrame:
    """Names starting with a dot are hidden."""
    return indices.where(~F.startswith(F.col("index"), F.lit(".")))


def match_hints(indices: DataFrame, hints: DataFrame) -> DataFrame:
    """``(query_id, index)`` where some hint of the query matches the index name.

    Each distinct hint is matched once.  Hint and name first meet on the hint's literal
    prefix, so the pattern is tried only on names that share it.
    """
    patterns = hints.select("hint").distinct().select(
        "hint",
        F.regexp_extract("hint", r"^[^*?\[]*", 0).alias("_prefix"),
        glob_to_regex(F.col("hint")).alias("_regex"),
    )
    prefixes = F.transform(
        F.sequence(F.lit(0), F.length("index")), lambda n: F.left(F.col("index"), n)
    )
    names = indices.select("index").distinct().select("index", F.explode(prefixes).alias("_prefix"))
    matched = patterns.join(names, "_prefix").where(F.expr("index rlike _regex"))
    return hints.join(matched.select("hint", "index"), "hint").select("query_id", "index").distinct()


def describe(catalog: DataFrame) -> DataFrame:
    """``(index, description)`` from the name and the first fifteen fields."""
    first = top_k(catalog, ["index"], [F.asc("pos"), F.asc("field")], DESCRIBED_FIELDS, "_rn")
    names = F.array_sort(F.collect_list(F.struct("_rn", "field")))
    listed = F.array_join(F.transform(names, lambda x: x["field"]), ", ")
    return first.groupBy("index").agg(
        F.concat(F.lit("Index "), F.col("index"), F.lit(". Fields: "), listed).alias("description")
    )


def link(
    queries: DataFrame, hinted: DataFrame, similar: DataFrame, indices: DataFrame
) -> DataFrame:
    """Selected indices per query: hint matches, else similar ones, else all of them.

    The catalog holds one name per table, so all names travel as one array.  An empty
    catalog gives one row with error E001 per query.
    """
    everything = indices.agg(F.array_sort(F.collect_set("index")).alias("names")).scalar()
    collected = [
        df.groupBy("query_id").agg(F.array_sort(F.collect_set("index")).alias(alias))
        for df, alias in ((hinted, "_hinted"), (similar, "_similar"))
    ]
    picked = F.coalesce(F.col("_hinted"), F.col("_similar"), everything)
    return (
        queries.select("query_id")
        .join(collected[0], "query_id", "left")
        .join(collected[1], "query_id", "left")
        .select(
            "query_id",
            F.when(F.col("_hinted").isNotNull(), "hint")
            .when(F.col("_similar").isNotNull(), "similar")
            .otherwise("all")
            .alias("step"),
            F.explode_outer(picked).alias("index"),
        )
        .withColumn("error", F.when(F.col("index").isNull(), "E001"))
    )


def merge_fields(selected: DataFrame, catalog: DataFrame, known: DataFrame) -> DataFrame:
    """Fields of the selected indices, first of a name wins; unknown extras become keyword."""
    fields = selected.select("query_id", "index").join(
        catalog.select("index", "pos", "field", "type"), "index"
    )
    merged = latest_wins(fields, ["query_id", "field"], [F.asc("index"), F.asc("pos")])
    extra = (
        known.select("query_id", "field")
        .distinct()
        .join(merged.select("query_id", "field"), ["query_id", "field"], "left_anti")
    )
    return merged.select("query_id", "field", "type").unionByName(
        extra.withColumn("type", F.lit("keyword"))
    )


def _long_form(df: DataFrame) -> DataFrame:
    scalar = [
        f.name
        for f in df.schema.fields
        if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))
    ]
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("string").alias("value"))
            for c in scalar
        ]
    )
    return df.select(F.inline(cells))


def sample_values(df: DataFrame, k: int = SAMPLE_VALUES) -> DataFrame:
    """Most frequent values per scalar field, ties by value."""
    counts = (
        _long_form(df)
        .where(F.col("value").isNotNull())
        .groupBy("field", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return top_k(counts, ["field"], [F.desc("n"), F.asc("value")], k)


def profile(df: DataFrame) -> DataFrame:
    """Rows, null share and approximate distinct values per scalar field."""
    return (
        _long_form(df)
        .groupBy("field")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.avg(F.col("value").isNull().cast("double")).alias("null_share"),
            F.approx_count_distinct("value").alias("approx_distinct"),
        )
    )


def status(catalog: DataFrame, refreshed_at: Column, now: Column) -> DataFrame:
    """Counts of indices and fields, last refresh, and staleness at ``now``."""
    seconds = F.unix_micros(now.cast("timestamp")) - F.unix_micros(
        F.max(refreshed_at).cast("timestamp")
    )
    return catalog.agg(
        F.countDistinct("index").alias("index_count"),
        F.count(F.lit(1)).alias("field_count"),
        F.max(refreshed_at).alias("last_refreshed"),
        F.coalesce(seconds > STALE_SECONDS * 1_000_000, F.lit(True)).alias("is_stale"),
    )
