import hashlib
import os
import uuid
from datetime import datetime

import pytest
from helpers import values
from pyspark.sql import functions as F

from loglattice.functions import metadata as meta
from loglattice.functions import text as tx
from loglattice.operators import indexing
from loglattice.sources import documents as src
from loglattice.sources import versions
from loglattice.sources.jsonl import read_examples

DOC = (
    "doc_id string, source_type string, source_uri string, raw_text string, created_at timestamp, "
    "metadata map<string,string>, accepted_flag boolean, merged_flag boolean"
)


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(column).first()[0]


def doc(source, text, metadata=None, accepted=None, merged=None, doc_id="d"):
    return (doc_id, source, "uri", text, datetime(2026, 4, 1), metadata or {}, accepted, merged)


def words(n):
    return " ".join(f"w{i}" for i in range(n))


@pytest.mark.parametrize(("n", "chunks"), [(1, 1), (511, 1), (512, 1), (513, 2), (960, 2), (961, 3), (1000, 3)])
def test_window_count(spark, n, chunks):
    got = one(spark, tx.word_windows(F.col("t"), 512, 64), words(n))
    assert len(got) == chunks
    assert got[0].split()[0] == "w0" and got[-1].split()[-1] == f"w{n - 1}"
    if chunks > 1:
        assert got[1].split()[0] == "w448" and len(got[0].split()) == 512


def test_windows_split_on_any_whitespace(spark):
    assert one(spark, tx.word_windows(F.col("t"), 2), " a b\tc \x1dd ") == ["a b", "c d"]
    assert one(spark, tx.word_windows(F.col("t"), 2), "  \n ") == []


def test_paragraphs(spark):
    assert one(spark, tx.paragraphs(F.col("t")), "one\n \n\n two \n\nthree") == ["one", "two", "three"]
    assert one(spark, tx.paragraph_windows(F.col("t"), 2), "a b c\n\nd") == ["a b", "c", "d"]


def test_runbook_of_1000_words(spark):
    df = spark.createDataFrame([doc("runbook", words(1000), doc_id="runbook-doc")], DOC)
    assert [r[0] for r in values(indexing.prepare_chunks(df), "chunk_id")] == [
        f"runbook-doc-chunk-{i}" for i in range(3)
    ]


def test_chunks_tag_and_number(spark):
    docs = [
        doc("jira", "ip 10.0.0.1 down\n\nsecond", doc_id="j"),
        doc("wiki", "kept  as   is", doc_id="o"),
        doc("slack", " \n ", doc_id="blank"),
    ]
    got = values(indexing.prepare_chunks(spark.createDataFrame(docs, DOC)), "chunk_id", "content")
    assert got == [
        ("j-chunk-0", "ip <IP_ADDR:10.0.0.1> down"), ("j-chunk-1", "second"), ("o-chunk-0", "kept  as   is"),
    ]


@pytest.mark.parametrize(
    ("source", "metadata", "accepted", "merged", "tier"),
    [
        ("runbook", {}, None, None, "A"),
        ("github", {}, None, True, "A"),
        ("github", {}, None, False, "B"),
        ("jira", {"jira_status": "Resolved"}, True, None, "A"),
        ("jira", {"jira_status": "Resolved"}, None, None, "B"),
        ("jira", {"status": "open"}, True, None, "B"),
        ("slack", {}, True, True, "B"),
    ],
)
def test_authority_tier(spark, source, metadata, accepted, merged, tier):
    df = spark.createDataFrame([doc(source, "x", metadata, accepted, merged)], DOC)
    assert indexing.enrich(df).first()["authority_tier"] == tier


@pytest.mark.parametrize(
    ("metadata", "status"),
    [
        ({"status": " Closed "}, "resolved"),
        ({"resolution_status": "", "jira_status": "obsolete"}, "deprecated"),
        ({"resolution_status": "todo", "status": "done"}, "open"),
        ({"status": "parked"}, "unknown"),
        ({}, "unknown"),
    ],
)
def test_resolution_status(spark, metadata, status):
    df = spark.createDataFrame([(metadata,)], "m map<string,string>")
    assert df.select(meta.resolution_status(F.col("m"))).first()[0] == status


@pytest.mark.parametrize("name", ["doc-chunk-0", "", "é", "x" * 100])
def test_uuid5(spark, name):
    assert one(spark, tx.uuid5(F.col("t")), name) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


@pytest.mark.parametrize("text", ["ERR_X", "/var/log", "a"])
def test_token_index(spark, text):
    expected = int.from_bytes(hashlib.sha1(text.encode()).digest()[:4], "big")
    assert one(spark, tx.token_index(F.col("t")), text) == expected


def test_hash_vector(spark):
    digest = hashlib.sha256(b"hello").digest()
    got = one(spark, tx.hash_vector(F.col("t"), 70), "hello")
    assert got == pytest.approx([digest[i % 32] / 255 for i in range(70)])


def test_term_weights(spark):
    df = spark.createDataFrame([(1, "A a b /x:1"), (2, "")], "id int, t string")
    got = values(indexing.term_weights(df, "id", "t"), "id", "token", "weight")
    assert got == [(1, "/x:1", 0.5), (1, "a", 1.0), (1, "b", 0.5)]


@pytest.mark.parametrize("budget", [-1, 0, 1, 3])
def test_truncation_is_the_longest_fit(spark, budget):
    text = words(5)
    head = one(spark, tx.truncate_back(F.col("t"), F.lit(budget)), text)
    tail = one(spark, tx.truncate_front(F.col("t"), F.lit(budget)), text)
    if budget <= 0:
        assert head == tail == ""
    else:
        best = max(n for n in range(len(text) + 1) if n // 4 <= budget)
        assert head == text[:best] and tail == text[-best:]


def test_local_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.md").write_text(
        "---\ntitle: Pay\ndoc_id: rb-1\nsource_uri: wiki:x\nupdated_at: 2026-04-10T00:00:00Z\n---\nbody ERR_X\n"
    )
    (tmp_path / "b c.txt").write_text("plain")
    (tmp_path / "skip.pdf").write_text("no")
    os.utime(tmp_path / "b c.txt", (1_700_000_000, 1_700_000_000))
    source = src.local_files(str(tmp_path))
    got = values(source(spark, None), "doc_id", "title", "source_uri", "author", "raw_text", "source_type")
    assert got == [
        ("b c", "b c", "b c.txt", "unknown", "plain", "runbook"),
        ("rb-1", "Pay", "wiki:x", "unknown", "body ERR_X", "runbook"),
    ]
    assert values(source(spark, datetime(2026, 4, 5)), "doc_id") == [("rb-1",)]
    assert src.local_files(str(tmp_path / "absent"))(spark, None).count() == 0
    with pytest.raises(ValueError):
        src.fetch_from({"files": source}, "jira", spark)


def test_examples(spark, tmp_path):
    path = tmp_path / "e.jsonl"
    path.write_text('{"id":"1","nl":"a","kql":"b"}\n\nnot json\n{"id":"2","nl":"only"}\n')
    assert values(read_examples(spark, str(path)), "id") == [("1",)]
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        read_examples(spark, str(path), strict=True).collect()


def test_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    assert versions.read_current(spark, root, ["k"]) is None
    rows = lambda *r: spark.createDataFrame(list(r), "k int, v string")
    versions.upsert(rows((1, "a"), (2, "b")), root, 0)
    versions.upsert(rows((2, "c"), (3, "d")), root, 1)
    versions.upsert(rows((2, "c"), (3, "d")), root, 1)
    expected = [(1, "a"), (2, "c"), (3, "d")]
    assert values(versions.read_current(spark, root, ["k"]), "k", "v") == expected
    versions.compact(spark, root, str(tmp_path / "u"), ["k"])
    assert values(versions.read_current(spark, str(tmp_path / "u"), ["k"]), "k", "v") == expected


def test_fences_and_utc(spark):
    assert one(spark, tx.strip_fences(F.col("t")), '```json\n{"a": 1}\n```') == '{"a": 1}'
    shown = F.date_format(meta.utc(F.col("t")), "HH:mm")
    assert one(spark, shown, "2026-04-01T12:30:00+02:00") == "10:30"
    assert one(spark, shown, "2026-04-01T12:30:00") == "12:30"


def test_files_become_chunks(spark, tmp_path):
    from loglattice.operators.indexing import prepare_chunks
    from loglattice.sources.documents import high_water_marks, local_files, newer_than_marks

    for i in range(5):
        header = "---\nstatus: done\nis_accepted_answer: true\nupdated_at: 2026-01-0%d\n---\n" % (i + 1)
        (tmp_path / f"note{i}.md").write_text(header + f"Restart service {i} and wait.")
    docs = local_files(str(tmp_path), "jira")(spark)
    rows = prepare_chunks(docs).orderBy("doc_id").collect()
    assert [r.chunk_id for r in rows] == [f"note{i}-chunk-0" for i in range(5)]
    assert {(r.authority_tier, r.resolution_status, r.is_accepted_answer) for r in rows} == {("A", "resolved", True)}
    marks = high_water_marks(docs)
    assert marks.selectExpr("source_type", "date(last_indexed_at)").first()[0] == "jira"
    assert newer_than_marks(docs, marks).count() == 0
    assert newer_than_marks(docs, marks.limit(0)).count() == 5
