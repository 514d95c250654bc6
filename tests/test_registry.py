"""Registered queries equal their check SQL on the smallest tables.

A few run by default; LOGLATTICE_ALL=1 runs every one (python tests/compare.py does too).
"""

import os

import duckdb
import pytest
from compare import compare, connect, rows_of

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()
FEW = [
    "log_search", "mask_nested_rows", "tag_identifiers", "ingest_summary", "hybrid_retrieval",
    "quality_bm25", "assembled_context", "render_memories", "check_edges", "merge_fields",
    "lint_saved_filters", "stream_metrics",
]
CHOSEN = sorted(QUERIES) if os.environ.get("LOGLATTICE_ALL") else FEW


@pytest.fixture(scope="module")
def con(folder):
    connection = connect(folder)
    yield connection
    connection.close()


def test_check_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES) and isinstance(duckdb.__version__, str)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["timestamp", "service", "level", "message", "trace_id", "event_id", "took"]
    assert df.count() > 0


@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, con, folder, name):
    df = QUERIES[name](spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name in SQL:
        cursor = con.execute(SQL[name])
        expected = rows_of([d[0] for d in cursor.description], cursor.fetchall())
        assert compare(got, expected) == ""
