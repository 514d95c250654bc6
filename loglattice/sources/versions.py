"""Keyed parquet tables written as versions: upsert, read, compact.

An upsert appends only its own rows under a new version, so its cost follows the
batch, not the table; readers keep the latest row per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.operators.scale import latest_wins


def merge_latest(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``old`` replaced or extended by ``new``, one per key."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest_wins(both, keys, [F.desc("_new")]).drop("_new")


def upsert(rows: DataFrame, root: str, version: int) -> None:
    """Write a batch as ``version``; writing the same version again replaces it."""
    rows.write.mode("overwrite").parquet(f"{root}/version={version}")


def read_current(spark: SparkSession, root: str, keys: Sequence[str]) -> DataFrame | None:
    """Latest row per key over all versions, or None before the first write."""
    try:
        rows = spark.read.parquet(root)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise
    return latest_wins(rows, keys, [F.desc("version")]).drop("version")


def compact(spark: SparkSession, root: str, target: str, keys: Sequence[str]) -> None:
    """Rewrite the current rows as the first version of a fresh table."""
    current = read_current(spark, root, keys)
    if current is not None:
        upsert(current, target, 0)
