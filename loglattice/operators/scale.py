"""Skew-safe building blocks shared by the operators.

A single key may own a third of all rows, so nothing here ever sorts or collects
a whole group in one task: top-k filters prune before the exchange, running
totals are computed per segment and then offset, quantiles narrow to a bracket
first, and a side is broadcast only after its size has been measured.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglattice.session import shared_dir

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024
SEGMENT_ROWS = 500_000  # one task sorts


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later plans do not repeat its work."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _cell_bytes(field: T.StructField) -> Column:
    cell = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(cell), F.lit(0)) + 16
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(cell))), F.lit(0)) + 32
    return F.lit(16)


def fits_broadcast(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> bool:
    """Measure ``df`` against both bounds, by counts and sums that every task adds up first."""
    size = sum((_cell_bytes(f) for f in df.schema.fields), F.lit(0)).cast("long")
    rows, size_bytes = (
        df.select(size.alias("_size"))
        .agg(F.count(F.lit(1)), F.coalesce(F.sum("_size"), F.lit(0)))
        .first()
    )
    return rows <= max_rows and size_bytes <= max_bytes


def small_side(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """``df`` with a broadcast hint when it was measured small, else unchanged.

    Unchanged means Spark plans a shuffled join, whose skewed partitions AQE splits.
    """
    return F.broadcast(df) if fits_broadcast(df, max_rows, max_bytes) else df


def fetch_rows(table: DataFrame, wanted: DataFrame, key: str, owners: DataFrame, per_owner: int) -> DataFrame:
    """Rows of a large table for a few wanted keys, without shuffling the table when few.

    ``wanted`` holds at most ``per_owner`` fixed-width rows per row of ``owners``; counting
    the owners therefore proves its size before it is broadcast.
    """
    limit = max(1, BROADCAST_ROWS // per_owner)
    few = owners.count() <= limit
    return table.join(F.broadcast(wanted) if few else wanted, key)


def salted_join(
    large: DataFrame, small: DataFrame, key: str, salts: int, spread_by: Sequence[str]
) -> DataFrame:
    """Inner equi-join for a hot ``key``: rows of ``large`` spread over ``salts`` buckets."""
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    return (
        large.withColumn("_salt", salt)
        .join(small.withColumn("_salt", copies), [key, "_salt"])
        .drop("_salt")
    )


def top_k(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """First ``k`` rows per group with their 1-based ``rank``.

    The rank filter sits directly on the window, so Spark keeps at most ``k`` rows
    per group and input partition before the exchange (WindowGroupLimit).
    """
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def latest_wins(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order``."""
    return top_k(df, keys, order, 1, "_rn").drop("_rn")


def running_total(
    df: DataFrame,
    group: Sequence[str],
    segment: Column,
    order: Sequence[Column],
    value: Column,
    out: str,
    segment_desc: bool = False,
) -> DataFrame:
    """Inclusive running sum of ``value`` per group, safe for groups of any size.

    ``segment`` must be monotone in the order (e.g. ``turn div 256``).  Sums run
    inside (group, segment); one small row per segment carries the offset of all
    earlier segments, so a hot group is spread over as many tasks as it has segments.
    Where a segment itself holds more than ``SEGMENT_ROWS`` rows (all on one day, say),
    the rows are cut into equal ranges of their order instead; ``order`` must be total.
    """
    keys = [*group, "_segment"]
    rows = df.withColumn("_segment", segment).withColumn("_value", value)
    if _most_rows(rows.select(*keys), keys) > SEGMENT_ROWS:
        return ranged_total(df, group, order, value, out)
    local = F.sum("_value").over(
        Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    by_segment = F.col("_segment").desc() if segment_desc else F.col("_segment").asc()
    earlier = (
        Window.partitionBy(*group).orderBy(by_segment).rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        rows.groupBy(*keys)
        .agg(F.sum("_value").alias("_total"))
        .select(*keys, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    )
    return (
        rows.withColumn("_local", local)
        .join(offsets, keys)
        .withColumn(out, F.col("_local") + F.col("_offset"))
        .drop("_segment", "_value", "_local", "_offset")
    )


def _most_rows(rows: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest group; tasks count before anything moves."""
    return rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def ranged_total(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], value: Column, out: str
) -> DataFrame:
    """Inclusive running sum over range partitions of (group, order).

    The rows are range-partitioned by group and order and written, so the ranges stand.  A
    range sums its own rows per group; the sum of each range, one row per group and range,
    is the offset of all later ranges of that group.  A single group fills every task.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(tasks, -(-df.count() // SEGMENT_ROWS))
    ranges = df.withColumn("_value", value).repartitionByRange(tasks, *[F.asc(g) for g in group], *order)
    placed = written(ranges.withColumn("_range", F.spark_partition_id()), "ranges")
    upto = Window.partitionBy("_range", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_range", *group).agg(F.sum("_value").alias("_total"))
        .select(
            F.col("_range").alias("_r"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
            F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"),
        )
    )
    same = F.col("_range") == F.col("_r")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return (
        placed.withColumn("_local", F.sum("_value").over(upto))
        .join(offsets, same)
        .withColumn(out, F.col("_local") + F.col("_offset"))
        .select(*df.columns, out)
    )


def exact_percentile(
    df: DataFrame, group: Sequence[str], value: str, q: float, out: str, accuracy: int = 100_000
) -> DataFrame:
    """Exact linearly interpolated quantile per group without gathering a group.

    A sketch brackets the two ranks that matter.  Values inside the bracket are
    counted one by one; everything below it enters as a single count per group.
    Groups too short for the sketch bound to hold are bracketed by min and max.
    """
    slack = 2.0 / accuracy
    rows = df.select(*group, F.col(value).alias("_v")).where(F.col("_v").isNotNull())
    edges = F.array(F.lit(max(0.0, q - slack)), F.lit(min(1.0, q + slack)))
    bounds = rows.groupBy(*group).agg(
        F.percentile_approx("_v", edges, F.lit(accuracy)).alias("_s"),
        F.count(F.lit(1)).alias("_n"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
    )
    # one fixed-width row per group: counting the groups bounds what is broadcast
    few_groups = fits_broadcast(rows.select(*group).distinct(), max_rows=10_000)
    short = F.col("_n") <= 4 * accuracy
    low_edge, high_edge = F.lit(q <= slack), F.lit(q >= 1.0 - slack)
    bounds = bounds.select(
        *group,
        "_n",
        F.when(short | low_edge, F.col("_min")).otherwise(F.col("_s")[0]).alias("_lo"),
        F.when(short | high_edge, F.col("_max")).otherwise(F.col("_s")[1]).alias("_hi"),
    )
    counts = (
        rows.join(F.broadcast(bounds) if few_groups else bounds, list(group))
        .where(F.col("_v") <= F.col("_hi"))
        .withColumn("_v", F.when(F.col("_v") >= F.col("_lo"), F.col("_v")))
        .groupBy(*group, "_n", "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    upto = (
        Window.partitionBy(*group)
        .orderBy(F.col("_v").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    ranked = counts.withColumn("_end", F.sum("_c").over(upto)).withColumn(
        "_pos", F.lit(q) * (F.col("_n") - 1)
    )

    def value_at(rank: Column) -> Column:
        inside = (rank >= F.col("_end") - F.col("_c")) & (rank < F.col("_end"))
        return F.max(F.when(inside, F.col("_v")))

    return (
        ranked.groupBy(*group)
        .agg(
            value_at(F.floor("_pos")).alias("_a"),
            value_at(F.ceil("_pos")).alias("_b"),
            F.max("_pos").alias("_p"),
        )
        .select(
            *group,
            (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_p") - F.floor("_p"))).alias(out),
        )
    )
