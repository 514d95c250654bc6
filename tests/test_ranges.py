"""Running sums over range partitions: one group on one day, in all tasks."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loglattice.operators import context, scale

T0 = datetime(2026, 1, 1)


@pytest.fixture(scope="module")
def one_day(spark):
    """4,000 of 4,300 rows belong to one group and one day; some rows have no group."""
    rows = [(None if i >= 4200 else "hot" if i < 4000 else f"g{i % 7}", i, T0 + timedelta(seconds=(i * 7919) % 80_000), (i * 31) % 97) for i in range(4300)]
    return spark.createDataFrame(rows, "g string, id int, ts timestamp, tokens int").repartition(5)


def order_by(direction="asc"):
    return [getattr(F, direction)("ts"), F.asc("id")]


@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_ranged_total_equals_the_window(one_day, direction):
    order = order_by(direction)
    got = scale.ranged_total(one_day, ["g"], order, F.col("tokens"), "used")
    whole = Window.partitionBy("g").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    expected = one_day.withColumn("used", F.sum("tokens").over(whole))
    assert got.columns == expected.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))


def test_one_hot_day_fills_all_tasks(spark, one_day, monkeypatch):
    monkeypatch.setattr(scale, "SEGMENT_ROWS", 100)
    seen = []
    real = scale.written
    monkeypatch.setattr(scale, "written", lambda df, label: seen.append(real(df, label)) or seen[-1])
    day = F.to_date("ts")
    named = one_day.where("g IS NOT NULL")
    kept = context.within_budget(named, ["g"], day, order_by(), F.col("tokens"), 9000)
    whole = Window.partitionBy("g").orderBy(*order_by()).rowsBetween(Window.unboundedPreceding, 0)
    expected = named.withColumn("used", F.sum("tokens").over(whole)).where("used <= 9000")
    assert sorted(map(str, kept.collect())) == sorted(map(str, expected.collect()))
    per_task = [r["count"] for r in seen[0].groupBy("_range").count().collect()]
    assert len(per_task) == 42 and max(per_task) < 4 * 4200 / 42  # 4,200 rows in 42 ranges


def test_tiered_pruning_of_one_day(spark, monkeypatch):
    rows = [("q", "log" if i % 2 else "chunk", f"i{i:04d}", "AB"[i % 4 // 2], T0 + timedelta(seconds=i % 50), f"m{i % 40}", i % 300, 3) for i in range(1200)]
    evidence = spark.createDataFrame(rows, "query_id string, kind string, item_id string, tier string, ts timestamp, message string, rank int, tokens int")
    expected = sorted(map(str, context.prune_tiered(evidence, 1500).select("item_id", "wave", "used").collect()))
    monkeypatch.setattr(scale, "SEGMENT_ROWS", 50)
    assert sorted(map(str, context.prune_tiered(evidence, 1500).select("item_id", "wave", "used").collect())) == expected


def test_empty(one_day):
    assert scale.ranged_total(one_day.limit(0), ["g"], order_by(), F.col("tokens"), "used").count() == 0
