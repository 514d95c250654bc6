"""Queries of this package: name, Spark callable, and the check SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from loglattice.session import configure

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
SQL: dict[str, str] = {}

MODULES = (
    "html_extraction", "url_filters", "lm_scoring", "packing", "ngram_jaccard_join",
    "substring_dedup", "language_id", "exact_dedup", "sharding", "decontamination",
    "chat_formatting", "phrase_mining", "embedding_whitening",
)


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register ``fn(spark, folder)``; the session gets the runtime settings first."""

    def register(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(configure(spark), folder)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def load_all() -> None:
    for module in MODULES:
        import_module(f"loglattice.llm.{module}")
