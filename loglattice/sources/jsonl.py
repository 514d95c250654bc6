"""JSON-lines readers: tolerant and strict."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

EXAMPLE_SCHEMA = "id string, nl string, kql string"


def read_examples(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Question and filter pairs.

    Tolerant mode skips blank, malformed and incomplete lines; strict mode fails on
    the first malformed line when the rows are read.
    """
    mode = "FAILFAST" if strict else "DROPMALFORMED"
    rows = spark.read.schema(EXAMPLE_SCHEMA).option("mode", mode).json(path)
    return rows if strict else rows.dropna(subset=["nl", "kql"])
