"""Text-document sources conforming to one raw-document schema."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.functions.metadata import utc
from loglattice.functions.text import strip

RAW_SCHEMA = (
    "doc_id string, source_type string, source_uri string, title string, raw_text string, "
    "created_at timestamp, updated_at timestamp, author string, metadata map<string,string>"
)

# A source is any function of (session, lower bound) returning RAW_SCHEMA rows.
Source = Callable[[SparkSession, datetime | None], DataFrame]

FRONT_MATTER = r"(?s)\A---\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)"


def front_matter(text: Column) -> Column:
    """Flat ``key: value`` header as a map; a text without a header gives an empty map."""
    block = F.regexp_extract(text, FRONT_MATTER, 1)
    pairs = F.filter(F.split(block, r"\r?\n"), lambda line: line.rlike(r"^[^\s:#][^:]*:"))
    entries = F.transform(
        pairs,
        lambda line: F.struct(
            F.trim(F.substring_index(line, ":", 1)).alias("k"),
            F.regexp_replace(
                F.trim(F.regexp_replace(line, r"^[^:]*:", "")), r"^(['\"])(.*)\1$", "$2"
            ).alias("v"),
        ),
    )
    distinct = F.filter(
        entries,
        lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["k"] == e["k"]),
    )
    return F.map_from_entries(distinct)


def local_files(folder: str, source_type: str = "runbook") -> Source:
    """Every ``.md``/``.txt`` file below ``folder``; a missing folder is an empty source."""

    def fetch(spark: SparkSession, since: datetime | None = None) -> DataFrame:
        try:
            files = (
                spark.read.option("recursiveFileLookup", "true")
                .option("pathGlobFilter", "*.{[mM][dD],[tT][xX][tT]}")
                .text(folder, wholetext=True)
                .select("value", "_metadata.file_path", "_metadata.file_modification_time")
            )
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return spark.createDataFrame([], RAW_SCHEMA)
        return newer_than(parse_files(files, source_type), since)

    return fetch


def parse_files(files: DataFrame, source_type: str = "runbook") -> DataFrame:
    """Raw documents from (value, file_path, file_modification_time) rows."""
    meta = F.col("metadata")
    name = F.url_decode(F.element_at(F.split("file_path", "/"), -1))
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    touched = F.col("file_modification_time")
    given = lambda key: F.nullif(meta[key], F.lit(""))
    return files.withColumn("metadata", front_matter(F.col("value"))).select(
        F.coalesce(given("doc_id"), stem).alias("doc_id"),
        F.lit(source_type).alias("source_type"),
        F.coalesce(given("source_uri"), name).alias("source_uri"),
        F.coalesce(given("title"), stem).alias("title"),
        strip(F.regexp_replace("value", FRONT_MATTER, "")).alias("raw_text"),
        F.coalesce(utc(given("created_at")), touched).alias("created_at"),
        F.coalesce(utc(given("updated_at")), touched).alias("updated_at"),
        F.coalesce(given("author"), F.lit("unknown")).alias("author"),
        "metadata",
    )


def newer_than(docs: DataFrame, since: datetime | Column | None) -> DataFrame:
    """Documents updated strictly after the bound; no bound keeps all."""
    if since is None:
        return docs
    bound = since if isinstance(since, Column) else F.lit(since)
    return docs.where(F.col("updated_at") > bound)


def _source_of(rows: DataFrame) -> str:
    return "source" if "source" in rows.columns else "source_type"


def newer_than_marks(docs: DataFrame, marks: DataFrame, full_reindex: bool = False) -> DataFrame:
    """Documents past their source's mark (see ``high_water_marks``)."""
    if full_reindex:
        return docs
    joined = docs.join(marks, _source_of(marks), "left")
    fresh = F.col("last_indexed_at").isNull() | (F.col("updated_at") > F.col("last_indexed_at"))
    return joined.where(fresh).drop("last_indexed_at")


def high_water_marks(docs: DataFrame) -> DataFrame:
    """Next mark ``last_indexed_at`` per ``source``, or per ``source_type`` of plain raw documents."""
    return docs.groupBy(_source_of(docs)).agg(F.max("updated_at").alias("last_indexed_at"))


def fetch_from(
    registry: dict[str, Source], name: str, spark: SparkSession, since: datetime | None = None
) -> DataFrame:
    """Rows of a registered source."""
    if name not in registry:
        raise ValueError(f"Unsupported source_type: {name}")
    return registry[name](spark, since)
