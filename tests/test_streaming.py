"""Streams give the batch answer once all input is consumed, also over several batches."""

from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from helpers import values
from pyspark.sql import functions as F

from loglattice.functions.masking import mask_rows
from loglattice.operators.indexing import prepare_chunks
from loglattice.plans import load_all
from loglattice.plans.registry import QUERIES
from loglattice.sources import versions
from loglattice.streaming import jobs

DOC = (
    "doc_id string, source_type string, source_uri string, raw_text string, created_at timestamp, "
    "metadata map<string,string>, accepted_flag boolean, merged_flag boolean"
)


def write_docs(spark, path, ids, text):
    rows = [(i, "runbook", "u", f"{text} {i} ERR_X", datetime(2026, 1, 1), {}, None, None) for i in ids]
    spark.createDataFrame(rows, DOC).coalesce(1).write.mode("append").parquet(path)


def test_ingest_is_incremental_and_idempotent(spark, tmp_path):
    source, root, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    write_docs(spark, source, ["a", "b"], "first")
    schema = spark.read.parquet(source).schema

    def run():
        docs = jobs.read_stream(spark, source, "*.parquet", schema)
        jobs.drain(jobs.ingest_stream(docs, root), check)

    run()
    run()  # nothing new
    write_docs(spark, source, ["b", "c"], "second")
    run()
    got = dict(values(versions.read_current(spark, root, ["chunk_id"]), "doc_id", "content"))
    assert got["a"].startswith("first") and got["b"].startswith("second") and set(got) == {"a", "b", "c"}
    batch = prepare_chunks(spark.read.parquet(source).where("raw_text like 'second%'"))
    assert dict(values(batch, "doc_id", "content"))["c"] == got["c"]


def test_masking_stream_equals_batch(spark, tmp_path, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet").withColumn("mail", F.lit("a@b.io"))
    source = str(tmp_path / "pages")
    pages.repartition(3).write.parquet(source)
    stream = jobs.mask_stream(jobs.read_stream(spark, source, "*.parquet", pages.schema))
    out = str(tmp_path / "out")
    jobs.drain(stream.writeStream.format("parquet").option("path", out), str(tmp_path / "c"))
    assert values(spark.read.parquet(out), "page_id", "mail") == values(mask_rows(pages), "page_id", "mail")


def test_failed_refresh_keeps_the_old_catalog(spark, tmp_path, folder):
    root = str(tmp_path / "catalog")
    ticks = str(tmp_path / "ticks")
    state = {"fail": False}

    def build(session):
        if state["fail"]:
            raise RuntimeError("unreachable")
        return session.range(3)

    for n, fail in enumerate([False, True]):
        state["fail"] = fail
        spark.range(n + 1).write.mode("append").parquet(ticks)
        stream = jobs.read_stream(spark, ticks, "*.parquet", spark.range(1).schema)
        jobs.drain(jobs.refresh_stream(stream, build, root), str(tmp_path / "check"))
    assert jobs.newest_version(spark, root).count() == 3


@pytest.mark.parametrize("gap", [jobs.BURST_SECONDS, jobs.SESSION_TTL_SECONDS])
def test_bursts_close_behind_the_watermark(spark, tmp_path, gap):
    source = str(tmp_path / "in")
    rows = [("u", datetime(2026, 1, 1, 0, 0, s)) for s in range(5)] + [("u", datetime(2026, 1, 2))]
    spark.createDataFrame(rows, "u string, ts timestamp_ntz").write.parquet(source)
    stream = jobs.read_stream(spark, source, "*.parquet", spark.read.parquet(source).schema)
    found = jobs.burst_stream(stream, ["u"], "ts", gap)
    out = str(tmp_path / "out")
    jobs.drain(found.writeStream.format("parquet").option("path", out), str(tmp_path / "c"))
    assert values(spark.read.parquet(out), "u", "n_events") == [("u", 5)]


@pytest.mark.parametrize("name", ["stream_catalog_refresh", "stream_ingest", "stream_masking"])
def test_a_streamed_table_may_be_a_file_or_a_folder(spark, tmp_path, name):
    load_all()
    tables = {
        "labels": [{"doc_id": i, "quality": i % 2, "toxic": 0} for i in range(6)],
        "documents": [{"doc_id": i, "text": f"text {i} ERR_X", "lang": "en", "source": f"src{i}"} for i in range(6)],
        "pages": [{"page_id": i, "url": f"http://a.b/{i}", "html": f"<p>mail a{i}@b.io</p>"} for i in range(6)],
        "customer": [{"c_custkey": i, "c_name": f"n{i}", "c_nationkey": i % 3, "c_acctbal": 1.5 * i, "c_mktsegment": "x"} for i in range(6)],
    }
    files, folders = tmp_path / "files", tmp_path / "folders"
    for table, rows in tables.items():
        (folders / f"{table}.parquet").mkdir(parents=True)
        files.mkdir(exist_ok=True)
        pq.write_table(pa.Table.from_pylist(rows), files / f"{table}.parquet")
        for i, part in enumerate([rows[:2], rows[2:]]):
            pq.write_table(pa.Table.from_pylist(part), folders / f"{table}.parquet" / f"part-{i}.parquet")
    whole, parts = (QUERIES[name](spark, str(f)) for f in (files, folders))
    assert values(parts, *whole.columns) == values(whole, *whole.columns) != []
