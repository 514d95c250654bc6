"""One connected source read whole, past a mark and as a stream."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from helpers import values

from loglattice.operators.indexing import prepare_chunks
from loglattice.plans.views import as_raw
from loglattice.sources import connector, versions
from loglattice.sources.tables import read_table
from loglattice.streaming import jobs


@pytest.fixture(scope="module")
def store(spark, folder, tmp_path_factory):
    """The documents in files of small row groups, as they arrive."""
    root = tmp_path_factory.mktemp("store")
    rows = pq.read_table(f"{folder}/documents.parquet").sort_by("doc_id")
    connector.register(spark, "documents_store", lambda o: connector.ParquetClient(o["path"], "doc_id"))
    for i, (a, b) in enumerate([(0, 90), (90, 140)]):
        pq.write_table(rows.slice(a, b - a), root / f"part-{i}.parquet", row_group_size=25)
    return root, rows


def test_batch_by_mark_and_stream_give_one_chunk_table(spark, folder, store, tmp_path):
    root, rows = store
    labels = read_table(spark, folder, "labels")
    reader = lambda: spark.read.format("documents_store").option("path", str(root))
    chunked = lambda docs: prepare_chunks(as_raw(docs, labels))
    stream = spark.readStream.format("documents_store").option("path", str(root)).load()
    place, checkpoint = str(tmp_path / "rows"), str(tmp_path / "checkpoint")
    jobs.drain(jobs.ingest_stream(as_raw(stream, labels), place), checkpoint)
    mark = rows["doc_id"][139].as_py()
    first = chunked(reader().option("upto", str(mark)).load())
    assert values(versions.read_current(spark, place, ["chunk_id"]), "chunk_id", "content") == values(first, "chunk_id", "content")
    # more arrives: the stream goes on behind its mark, a batch reads past the mark
    pq.write_table(rows.slice(140), root / "part-2.parquet", row_group_size=25)
    jobs.drain(jobs.ingest_stream(as_raw(stream, labels), place), checkpoint)
    whole = chunked(read_table(spark, folder, "documents"))
    got = versions.read_current(spark, place, ["chunk_id"])
    assert values(got, "chunk_id", "content") == values(whole, "chunk_id", "content")
    later = chunked(reader().option("after", str(mark)).load())
    assert values(first.unionByName(later), "chunk_id", "content") == values(whole, "chunk_id", "content")
    assert spark.read.parquet(place).where("version = 1").count() == later.count() > 0


def test_filters_on_the_mark_narrow_the_slices(spark, store):
    root, _ = store
    client = connector.ParquetClient(str(root), "doc_id")
    assert len(client.slices(None, None)) >= 6 and len(client.slices(None, 30)) == 2 and client.slices(10**9, None) == []
    batch = connector._Batch(client, None, None)
    rest = list(batch.pushFilters([connector.GreaterThan(("doc_id",), 80), connector.GreaterThan(("n_chars",), 3)]))
    assert [f.attribute for f in rest] == [("n_chars",)] and len(batch.partitions()) < len(client.slices(None, None))
    df = spark.read.format("documents_store").option("path", str(root)).load().where("doc_id > 80 AND n_chars > 100")
    files = spark.read.parquet(str(root)).where("doc_id > 80 AND n_chars > 100")
    assert values(df, "doc_id", "text") == values(files, "doc_id", "text")


def test_null_marks_and_empty_stores(spark, tmp_path):
    pq.write_table(pa.table({"m": pa.array([1, None, 3]), "t": ["a", "b", "c"]}), tmp_path / "x.parquet")
    connector.register(spark, "marked", lambda o: connector.ParquetClient(o["path"], "m"))
    read = lambda **o: spark.read.format("marked").options(path=str(tmp_path / "x.parquet"), **o).load()
    assert values(read(), "t") == [("a",), ("b",), ("c",)]
    assert values(read(after="1"), "t") == [("c",)] and values(read(upto="1"), "t") == [("a",)]
    pq.write_table(pa.table({"m": pa.array([], pa.int64()), "t": pa.array([], pa.string())}), tmp_path / "y.parquet")
    empty = spark.readStream.format("marked").option("path", str(tmp_path / "y.parquet")).load()
    jobs.drain(empty.writeStream.format("parquet").option("path", str(tmp_path / "out")), str(tmp_path / "cp"))
    assert spark.read.schema(empty.schema).parquet(str(tmp_path / "out")).count() == 0


def test_a_large_row_group_is_read_in_small_batches(tmp_path):
    pq.write_table(pa.table({"m": range(5000), "t": ["a" * 50] * 5000}), tmp_path / "x.parquet")
    client = connector.ParquetClient(str(tmp_path / "x.parquet"), "m")
    [part] = client.slices(None, None)
    batches = list(client.rows(part, 99, 4899))
    assert max(b.num_rows for b in batches) <= 1000
    assert [m for b in batches for m in b.column("m").to_pylist()] == list(range(100, 4900))
