from datetime import datetime

import pytest
from helpers import values
from pyspark.sql import functions as F

from loglattice.functions import predicates as p

NOW = datetime(2026, 4, 10, 15, 42, 7)


@pytest.fixture(scope="module")
def hits(spark):
    rows = [
        (1, "payments", "ERROR", "Connection refused to db-primary", 500, [("Alice", "Smith"), ("John", "White")], datetime(2026, 4, 10, 15, 0)),
        (2, "auth", "WARN", "Timeout while calling 50%_done", 404, [("Alice", "White")], datetime(2026, 4, 10, 0, 30)),
        (3, None, None, None, None, None, None),
    ]
    schema = (
        "id int, `service.name` string, `log.level` string, message string, status int, "
        "users array<struct<first:string,last:string>>, `@timestamp` timestamp_ntz"
    )
    return spark.createDataFrame(rows, schema)


def found(df, spec):
    return [r[0] for r in values(p.search(df, spec, now=NOW), "id")]


@pytest.mark.parametrize(
    ("spec", "ids"),
    [
        ({}, [1, 2, 3]),
        ({"term": {"service.name": "payments"}}, [1]),
        ({"term": {"service.name": "Payments"}}, []),
        ({"term": {"service.name": "unknown"}}, []),
        ({"terms": {"log.level": ["ERROR", "WARN"]}}, [1, 2]),
        ({"match": {"message": "REFUSED please"}}, [1]),
        ({"match": {"message": ""}}, []),
        ({"multi_match": "warn connection"}, [1, 2]),
        ({"exists": "service.name"}, [1, 2]),
        ({"wildcard": {"service.name": "pay*"}}, [1]),
        ({"wildcard": {"message": "*50%_done"}}, [2]),
        ({"wildcard": {"message": "*50%xdone"}}, []),
        ({"range": {"status": {"gte": 400, "lt": 500}}}, [2]),
        ({"range": {"@timestamp": {"gte": "now-1h"}}}, [1]),
        ({"range": {"@timestamp": {"gte": "now/d"}}}, [1, 2]),
        ({"all": [{"term": {"service.name": "payments"}}, {"term": {"log.level": "ERROR"}}]}, [1]),
        ({"any": [{"term": {"log.level": "WARN"}}, {"range": {"status": {"gte": 500}}}]}, [1, 2]),
        ({"none": [{"term": {"service.name": "payments"}}]}, [2, 3]),
        ({"none": [{"all": [{"term": {"service.name": "auth"}}, {"range": {"status": {"gt": 1}}}]}]}, [1, 3]),
        ({"nested": {"users": {"all": [{"term": {"first": "Alice"}}, {"term": {"last": "White"}}]}}}, [2]),
        ({"nested": {"users": {"term": {"last": "White"}}}}, [1, 2]),
    ],
)
def test_filter(hits, spec, ids):
    assert found(hits, spec) == ids


def test_array_term_and_sources(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"])], "id int, tags array<string>")
    assert values(df.where(p.array_term(F.col("tags"), "b")), "id") == [(1,)]
    assert df.where(p.exists(F.col("tags"), is_array=True)).count() == 2
    assert df.where(p.in_sources(F.lit("jira"), [])).count() == 2


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("now", NOW),
        ("now-1h", datetime(2026, 4, 10, 14, 42, 7)),
        ("now-30m", datetime(2026, 4, 10, 15, 12, 7)),
        ("now/d", datetime(2026, 4, 10)),
        ("now-1d/d", datetime(2026, 4, 9)),
        ("now/w", datetime(2026, 4, 6)),
        ("now+2h", datetime(2026, 4, 10, 17, 42, 7)),
        ("now-1M", datetime(2026, 3, 10, 15, 42, 7)),
        ("now/M-1d-2M", datetime(2026, 1, 31)),
        ("now/y", datetime(2026, 1, 1)),
        ("now+50d-3M", datetime(2026, 2, 28, 15, 42, 7)),
        ("now-1d-2h/d", datetime(2026, 4, 9)),
        ("now-1y/H", datetime(2025, 4, 10, 15)),
    ],
)
def test_relative_time(spark, text, expected):
    assert p.relative_time(text, NOW) == expected
    column = p.relative_time_column(F.lit(text), F.lit(NOW))
    shown = spark.range(1).select(F.date_format(column, "yyyy-MM-dd HH:mm:ss")).first()[0]
    assert shown == expected.strftime("%Y-%m-%d %H:%M:%S")


@pytest.mark.parametrize(
    ("spec", "ids"),
    [
        ({"term": {"tags": "b"}}, [1]),
        ({"terms": {"tags": ["b", "c"]}}, [1, 2]),
        ({"wildcard": {"tags": "a*"}}, [1]),
        ({"exists": "tags"}, [1, 2]),
        ({"none": [{"term": {"tags": "b"}}]}, [2, 3, 4, 5]),
        ({"range": {"codes": {"gte": 5, "lt": 9}}}, [1]),
        ({"term": {"parts.name": "Disk Full"}}, [2]),
        ({"exists": "parts.name"}, [1, 2]),
        ({"multi_match": "full"}, [2]),
        ({"multi_match": "deep"}, [3]),
        ({"multi_match": "valued"}, [4]),
        ({"nested": {"parts": {"multi_match": "disk"}}}, [2]),
    ],
)
def test_filter_on_arrays_and_nested_fields(spark, spec, ids):
    rows = [
        (1, ["a", "b"], [1, 7], [("ok",)], None, None),
        (2, ["c", None], [9], [("ok",), ("Disk Full",)], None, None),
        (3, [], [], [], (("Deep",),), None),
        (4, None, None, None, None, {"key": "valued"}),
        (5, [None], [None], [(None,)], None, {}),
    ]
    schema = (
        "id int, tags array<string>, codes array<int>, parts array<struct<name:string>>, "
        "outer struct<inner:struct<text:string>>, notes map<string,string>"
    )
    assert found(spark.createDataFrame(rows, schema), spec) == ids


def test_unknown_relative_bound_is_named(hits):
    with pytest.raises(ValueError, match="now-1q"):
        p.compile_spec({"range": {"@timestamp": {"gte": "now-1q"}}}, hits.schema, NOW)


def test_relative_time_rejects_other_text():
    with pytest.raises(ValueError):
        p.relative_time("yesterday", NOW)


def test_filter_reaches_the_scan(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet")
    spec = {"all": [{"term": {"event_type": "error"}}, {"range": {"ts": {"gte": "now-2d"}}}]}
    plan = p.search(events, spec, now=datetime(2024, 1, 20)).select("event_id")._jdf.queryExecution()
    text = plan.executedPlan().toString()
    assert "EqualTo(event_type,error)" in text and "GreaterThanOrEqual(ts," in text
