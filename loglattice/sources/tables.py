"""Reading tables and scanning several of them as one log."""

from __future__ import annotations

import os
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-spread a scan that has fewer splits than cores; leave larger scans alone.

    Row-local text work on a small file would otherwise run in one task.  A scan with
    at least one split per core is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() > cores:
        return df
    return df.repartition(cores, *keys)


def scan_indices(tables: Mapping[str, DataFrame], label: str = "_index") -> DataFrame:
    """Union of differently shaped log tables; absent columns are null."""
    labelled = [df.withColumn(label, F.lit(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), labelled)
