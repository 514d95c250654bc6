"""Documents: reading, metadata, chunks, terms, vectors, upserts."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from loglattice.functions import metadata as meta
from loglattice.functions import text as tx
from loglattice.functions.identifiers import tag_identifiers
from loglattice.operators import indexing
from loglattice.plans.privacy import TAGGED, _text_with_ids
from loglattice.plans.registry import query
from loglattice.plans.views import (
    CHUNKS, DOCS, SQL_WS, chunk_sql, chunks, day, questions, raw_documents,
)
from loglattice.session import shared_dir
from loglattice.sources import documents as src
from loglattice.sources import versions
from loglattice.sources.jsonl import read_examples
from loglattice.sources.tables import read_table, spread


def scratch(spark, name: str) -> str:
    """A fresh folder below the shared one."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


# ------------------------------------------------------------------------- sources


@query(
    "load_documents",
    f"""SELECT CASE WHEN doc_id % 2 = 0 THEN 'rb-' || doc_id ELSE 'note-' || doc_id END AS doc_id,
          'runbook' AS source_type,
          CASE WHEN doc_id % 2 = 0 THEN 'wiki:' || doc_id || ':x' ELSE 'note-' || doc_id || '.md' END AS source_uri,
          CASE WHEN doc_id % 2 = 0 THEN 'Title ' || doc_id ELSE 'note-' || doc_id END AS title,
          CASE WHEN doc_id % 2 = 0 THEN 'Kim' ELSE 'unknown' END AS author,
          CASE WHEN doc_id % 2 = 0 THEN '2026-04-01 10:30:00' ELSE '2026-01-05 00:00:00' END AS updated_at,
          regexp_replace(text, '^{SQL_WS}+|{SQL_WS}+$', '', 'g') AS raw_text
        FROM documents""",
)
def load_documents(spark, folder):
    """Front matter gives ids, titles and times; files without it fall back to name and file time."""
    n = F.col("doc_id")
    header = F.concat(
        F.lit("---\ntitle: Title "), n, F.lit("\ndoc_id: rb-"), n, F.lit("\nauthor: Kim\nsource_uri: 'wiki:"),
        n, F.lit(":x'\nupdated_at: 2026-04-01T12:30:00+02:00\n---\n"),
    )
    docs = spread(read_table(spark, folder, "documents"), "doc_id")
    files = docs.select(
        F.when(n % 2 == 0, F.concat(header, F.col("text"))).otherwise(F.col("text")).alias("value"),
        F.concat(F.lit("file:///docs/team%20a/note-"), n, F.lit(".md")).alias("file_path"),
        F.expr("timestamp'2026-01-05 00:00:00'").alias("file_modification_time"),
    )
    parsed = src.parse_files(files)
    return parsed.select(
        "doc_id", "source_type", "source_uri", "title", "author",
        F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"), "raw_text",
    )


_MARKS = """marks AS (SELECT source, TIMESTAMP '2024-01-01' + to_days(CAST(substr(source, 4) AS INTEGER) * 15) AS mark
  FROM (SELECT DISTINCT source FROM documents) WHERE source <> 'src3')"""


@query(
    "incremental_fetch",
    f"""WITH {DOCS}, {_MARKS} SELECT doc_id, source, strftime(updated_at, '%Y-%m-%d') AS updated_at
        FROM docs LEFT JOIN marks USING (source) WHERE mark IS NULL OR updated_at > mark""",
)
def incremental_fetch(spark, folder):
    """Documents past their source's mark; a source without a mark is read whole."""
    docs = raw_documents(spark, folder)
    number = F.substring("source", 4, 9).cast("int")
    marks = (
        docs.select("source").distinct().where("source <> 'src3'")
        .withColumn(
            "last_indexed_at", F.expr("timestamp'2024-01-01 00:00:00'") + F.make_dt_interval(number * 15)
        )
    )
    fresh = src.newer_than_marks(docs, marks)
    return fresh.select("doc_id", "source", day("updated_at").alias("updated_at"))


@query(
    "high_water_marks",
    f"WITH {DOCS} SELECT source, strftime(max(updated_at), '%Y-%m-%d') AS last_indexed_at FROM docs GROUP BY source",
)
def high_water_marks(spark, folder):
    marks = src.high_water_marks(raw_documents(spark, folder))
    return marks.select("source", day("last_indexed_at").alias("last_indexed_at"))


def _write_examples(spark, folder, with_bad_lines: bool) -> str:
    n = F.col("query_id")
    good = F.to_json(
        F.struct(
            F.concat(F.lit("fe-"), n).alias("id"), F.col("question").alias("nl"),
            F.concat(F.lit("user: "), n).alias("kql"),
        )
    )
    line = (
        F.when(n % 7 == 0, F.lit("{not json"))
        .when(n % 7 == 1, F.lit('{"id": "x", "nl": "no filter"}'))
        .otherwise(good)
        if with_bad_lines
        else good
    )
    path = scratch(spark, "examples")
    questions(spark, folder).select(line.alias("value")).write.text(path)
    return path


@query(
    "read_examples_tolerant",
    "SELECT 'fe-' || item_id AS id, text AS nl, 'user: ' || item_id AS kql FROM benchmark WHERE item_id % 7 > 1",
)
def read_examples_tolerant(spark, folder):
    return read_examples(spark, _write_examples(spark, folder, with_bad_lines=True))


@query(
    "read_examples_strict",
    "SELECT 'fe-' || item_id AS id, text AS nl, 'user: ' || item_id AS kql FROM benchmark",
)
def read_examples_strict(spark, folder):
    return read_examples(spark, _write_examples(spark, folder, with_bad_lines=False), strict=True)


@query(
    "custom_source",
    """SELECT 'page-' || page_id AS doc_id, 'github' AS source_type, url AS source_uri, length(html) AS n_chars
       FROM pages WHERE page_id % 30 + 1 > 10""",
)
def custom_source(spark, folder):
    """Pages supplied through the source interface, fetched past a bound."""

    def pages(session, since=None):
        stamp = F.expr("timestamp'2024-02-01 00:00:00'") + F.make_dt_interval(
            (F.col("page_id") % 30).cast("int")
        )
        rows = read_table(session, folder, "pages").select(
            F.concat(F.lit("page-"), F.col("page_id")).alias("doc_id"),
            F.lit("github").alias("source_type"),
            F.col("url").alias("source_uri"),
            F.col("url").alias("title"),
            F.col("html").alias("raw_text"),
            stamp.alias("created_at"),
            stamp.alias("updated_at"),
            F.lit("unknown").alias("author"),
            F.create_map().cast("map<string,string>").alias("metadata"),
        )
        return src.newer_than(rows, since)

    bound = F.expr("timestamp'2024-02-10 00:00:00'")
    return src.fetch_from({"pages": pages}, "pages", spark, bound).select(
        "doc_id", "source_type", "source_uri", F.length("raw_text").alias("n_chars")
    )


# ------------------------------------------------------------------------- metadata


@query(
    "chunk_metadata",
    f"""WITH {DOCS} SELECT doc_id, source_type, resolution_status, accepted AS is_accepted_answer,
          tier AS authority_tier, 1.0::DOUBLE AS recency_score FROM tiered""",
)
def chunk_metadata(spark, folder):
    """Status words, accepted flags and tiers derived from source metadata."""
    return indexing.enrich(raw_documents(spark, folder)).select(
        "doc_id", "source_type", "resolution_status", "is_accepted_answer", "authority_tier", "recency_score"
    )


@query(
    "resolution_status",
    """WITH m AS (SELECT o_orderkey,
          CASE o_orderkey % 3 WHEN 0 THEN o_orderstatus ELSE '' END AS first_key,
          CASE o_orderpriority WHEN '1-URGENT' THEN ' OPEN ' WHEN '2-HIGH' THEN 'In Progress'
               WHEN '3-MEDIUM' THEN 'Closed' WHEN '4-NOT SPECIFIED' THEN 'obsolete' END AS third_key FROM orders),
        w AS (SELECT o_orderkey, lower(trim(coalesce(nullif(first_key, ''), third_key))) AS word FROM m)
        SELECT o_orderkey, CASE WHEN word IN ('resolved', 'done', 'closed') THEN 'resolved'
               WHEN word IN ('deprecated', 'obsolete') THEN 'deprecated'
               WHEN word IN ('open', 'todo', 'in_progress', 'in progress') THEN 'open' ELSE 'unknown' END AS status
        FROM w""",
)
def resolution_status(spark, folder):
    """First non-empty of three metadata keys, mapped to four values."""
    words = {
        "1-URGENT": " OPEN ", "2-HIGH": "In Progress", "3-MEDIUM": "Closed", "4-NOT SPECIFIED": "obsolete",
    }
    priority = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    orders = read_table(spark, folder, "orders")
    metadata = F.map_from_arrays(
        F.array(F.lit("resolution_status"), F.lit("status")),
        F.array(
            F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).otherwise(""),
            F.try_element_at(priority, F.col("o_orderpriority")),
        ),
    )
    return orders.withColumn("metadata", metadata).select(
        "o_orderkey", meta.resolution_status(F.col("metadata")).alias("status")
    )


@query(
    "utc_times",
    """SELECT event_id, strftime(ts - CASE WHEN user_id % 3 = 0 THEN INTERVAL 2 HOUR
          WHEN user_id % 3 = 1 THEN INTERVAL (-330) MINUTE ELSE INTERVAL 0 HOUR END, '%Y-%m-%d %H:%M:%S') AS utc
       FROM events""",
)
def utc_times(spark, folder):
    """ISO text with and without offsets, normalised to UTC."""
    zones = F.array(F.lit("+02:00"), F.lit("-05:30"), F.lit(""))
    text = F.concat(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"),
        F.element_at(zones, (F.col("user_id") % 3 + 1).cast("int")),
    )
    return read_table(spark, folder, "events").select(
        "event_id", F.date_format(meta.utc(text), "yyyy-MM-dd HH:mm:ss").alias("utc")
    )


@query(
    "json_fields",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
          CAST(json_extract(props, '$.k') AS BIGINT) >= 50 AS high FROM events""",
)
def json_fields(spark, folder):
    """Nested payload read through VARIANT, so unknown shapes need no schema."""
    events = read_table(spark, folder, "events")
    k = F.try_variant_get(F.parse_json("props"), "$.k", "bigint")
    return events.select("event_id", k.alias("k")).withColumn("high", F.col("k") >= 50)


@query(
    "fenced_json",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE user_id % 4 <> 3
       UNION ALL SELECT event_id, NULL FROM events WHERE user_id % 4 = 3""",
)
def fenced_json(spark, folder):
    """Stored model output: code fences removed, JSON parsed, broken text gives null."""
    body = F.col("props")
    stored = F.element_at(
        F.array(
            F.concat(F.lit("```json\n"), body, F.lit("\n```")),
            F.concat(F.lit("  ```"), body, F.lit("```\n")),
            body,
            F.lit("```json\n{broken\n```"),
        ),
        (F.col("user_id") % 4 + 1).cast("int"),
    )
    parsed = F.from_json(tx.strip_fences(stored), "k bigint")
    return read_table(spark, folder, "events").select("event_id", parsed["k"].alias("k"))


# ------------------------------------------------------------------------- chunks


@query("chunk_documents", f"WITH {CHUNKS} SELECT chunk_id, doc_id, ordinal, content FROM chunks")
def chunk_documents(spark, folder):
    """Word windows or paragraphs by source, ordinals over the whole document."""
    return chunks(spark, folder).select("chunk_id", "doc_id", "ordinal", "content")


@query(
    "word_windows",
    f"""WITH {DOCS}, one AS (SELECT * REPLACE ('github' AS source_type) FROM tiered), {chunk_sql("one")}
        SELECT doc_id, CAST(max(ordinal) + 1 AS BIGINT) AS n_windows, CAST(sum(length(content)) AS BIGINT) AS n_chars
        FROM chunks GROUP BY doc_id""",
)
def word_windows(spark, folder):
    windows = tx.word_windows(F.col("raw_text"), meta.WINDOW_SIZE, meta.WINDOW_OVERLAP)
    lengths = F.aggregate(windows, F.lit(0).cast("bigint"), lambda acc, w: acc + F.length(w))
    return (
        raw_documents(spark, folder)
        .select("doc_id", F.size(windows).cast("bigint").alias("n_windows"), lengths.alias("n_chars"))
        .where("n_windows > 0")
    )


@query(
    "paragraph_windows",
    f"""WITH {DOCS}, one AS (SELECT * REPLACE ('slack' AS source_type) FROM tiered), {chunk_sql("one")}
        SELECT doc_id, ordinal, content FROM chunks""",
)
def paragraph_windows(spark, folder):
    docs = raw_documents(spark, folder).withColumn("raw_text", tx.strip(F.col("raw_text")))
    pieces = tx.paragraph_windows(F.col("raw_text"), meta.PARAGRAPH_SIZE)
    return docs.where("raw_text <> ''").select("doc_id", F.posexplode(pieces).alias("ordinal", "content"))


_INGEST_SQL = f"""WITH {TAGGED}, {DOCS},
  ready AS (SELECT d.* REPLACE (regexp_replace(g.tagged, '^{SQL_WS}+|{SQL_WS}+$', '', 'g') AS raw_text)
            FROM tiered d JOIN tagged g ON g.doc_id = d.doc_id), {chunk_sql("ready")}"""


def ingest_documents(spark, folder):
    """Documents with identifier-rich tails, through tagging, chunking and enrichment."""
    docs = raw_documents(spark, folder)
    return indexing.prepare_chunks(docs.withColumn("raw_text", _text_with_ids(F.col("raw_text"))))


@query(
    "ingest_chunks",
    f"""{_INGEST_SQL} SELECT chunk_id, doc_id, content, ordinal, source_type, source_uri, tier AS authority_tier,
          strftime(created_at, '%Y-%m-%d') AS created_at, resolution_status, accepted AS is_accepted_answer,
          1.0::DOUBLE AS recency_score FROM chunks""",
)
def ingest_chunks(spark, folder):
    return ingest_documents(spark, folder).withColumn("created_at", day("created_at"))


@query(
    "ingest_summary",
    f"""{_INGEST_SQL} SELECT 'success' AS status, source_type, documents_indexed, chunks_indexed
        FROM (SELECT source_type, count(*) AS documents_indexed FROM docs GROUP BY source_type)
        JOIN (SELECT source_type, count(*) AS chunks_indexed FROM chunks GROUP BY source_type) USING (source_type)""",
)
def ingest_summary(spark, folder):
    return indexing.ingest_summary(raw_documents(spark, folder), ingest_documents(spark, folder))


@query("knowledge_payload", f"""WITH {CHUNKS} SELECT chunk_id, source_type, source_uri, tier AS authority_tier,
          1.0::DOUBLE AS recency_score, content, '2024-01-20' AS retrieved_at, ordinal FROM chunks""")
def knowledge_payload(spark, folder):
    """Output columns of a retrieved chunk with an explicit retrieval stamp."""
    return chunks(spark, folder).select(
        "chunk_id", "source_type", "source_uri", "authority_tier", "recency_score", "content",
        F.lit("2024-01-20").alias("retrieved_at"), "ordinal",
    )


@query(
    "point_ids",
    f"""WITH {CHUNKS}, h AS (
          SELECT chunk_id, sha1(unhex('{tx.URL_NAMESPACE}') || encode(chunk_id)) AS x FROM chunks)
        SELECT chunk_id, x[1:8] || '-' || x[9:12] || '-5' || x[14:16] || '-'
          || substr('89ab89ab89ab89ab', instr('0123456789abcdef', x[17]), 1) || x[18:20] || '-' || x[21:32] AS point_id
        FROM h""",
)
def point_ids(spark, folder):
    return indexing.with_point_id(chunks(spark, folder)).select("chunk_id", "point_id")


# ------------------------------------------------------------------------- terms and vectors

TERMS = f"""tok AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '{tx.TOKEN}'))) AS token FROM documents),
tf AS (SELECT doc_id, token, count(*) AS tf FROM tok GROUP BY doc_id, token)"""


@query(
    "tokens",
    f"WITH {TERMS} SELECT doc_id, count(*) AS n_tokens, CAST(sum(length(token)) AS BIGINT) AS n_chars FROM tok GROUP BY doc_id",
)
def tokens(spark, folder):
    docs = spread(read_table(spark, folder, "documents"), "doc_id")
    found = tx.tokens(F.col("text"))
    lengths = F.aggregate(found, F.lit(0).cast("bigint"), lambda acc, t: acc + F.length(t))
    return docs.select(
        "doc_id", F.size(found).cast("bigint").alias("n_tokens"), lengths.alias("n_chars")
    ).where("n_tokens > 0")


@query(
    "term_weights",
    f"""WITH {TERMS} SELECT doc_id, token, CAST('0x' || substr(sha1(token), 1, 8) AS BIGINT) AS idx,
          round(tf / max(tf) OVER (PARTITION BY doc_id), 6) AS weight FROM tf""",
)
def term_weights(spark, folder):
    """Sparse vectors in long form: hashed index and tf / max tf."""
    docs = read_table(spark, folder, "documents")
    return indexing.term_weights(docs, "doc_id", "text").withColumn("weight", F.round("weight", 6))


@query(
    "hash_vectors",
    """WITH h AS (SELECT item_id, sha256(text) AS x FROM benchmark)
       SELECT item_id, 768 AS dims, round(list_sum(list_transform(range(0, 768), lambda i:
          (i + 1) * CAST('0x' || substr(x, CAST((i % 32) * 2 + 1 AS BIGINT), 2) AS INTEGER) / 255.0::DOUBLE)), 6) AS weighted_sum
       FROM h""",
)
def hash_vectors(spark, folder):
    """The stand-in vector, checked through a position-weighted sum."""
    vectors = questions(spark, folder).select(
        F.col("query_id").alias("item_id"), tx.hash_vector(F.col("question")).alias("v")
    )
    weighted = F.aggregate(
        F.transform("v", lambda x, i: x * (i + 1)), F.lit(0.0), lambda acc, x: acc + x
    )
    return vectors.select("item_id", F.size("v").alias("dims"), F.round(weighted, 6).alias("weighted_sum"))


@query(
    "vector_cosine",
    """SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]),
          list_transform(range(1, 65), lambda i: CAST(i AS DOUBLE))), 6) AS cosine FROM embeddings""",
)
def vector_cosine(spark, folder):
    ramp = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: i.cast("double"))
    return read_table(spark, folder, "embeddings").select(
        "vec_id", F.round(tx.cosine(F.col("embedding"), ramp), 6).alias("cosine")
    )


# ------------------------------------------------------------------------- upserts


@query(
    "chunk_upsert",
    f"""WITH {CHUNKS} SELECT chunk_id, CASE WHEN doc_id % 3 = 0 THEN 'second: ' || content ELSE content END AS content,
          CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS revision FROM chunks""",
)
def chunk_upsert(spark, folder):
    """Re-ingesting some documents overwrites their chunks; repeating a batch changes nothing."""
    base = chunks(spark, folder).select("chunk_id", "doc_id", "content")
    root = scratch(spark, "chunks")
    versions.upsert(base.withColumn("revision", F.lit(1)), root, 0)
    again = base.where("doc_id % 3 = 0").select(
        "chunk_id", "doc_id", F.concat(F.lit("second: "), "content").alias("content"), F.lit(2).alias("revision")
    )
    versions.upsert(again, root, 1)
    versions.upsert(again, root, 1)
    current = versions.read_current(spark, root, ["chunk_id"])
    return current.select("chunk_id", "content", "revision")


@query(
    "example_upsert",
    """SELECT 'fe-' || item_id AS id, text AS nl,
          CASE WHEN item_id % 2 = 0 THEN 'kql v2 ' ELSE 'kql v1 ' END || item_id AS kql FROM benchmark""",
)
def example_upsert(spark, folder):
    """Question/filter pairs merged by id, the newer pair winning."""
    n = F.col("query_id")

    def pairs(label: str):
        return questions(spark, folder).select(
            F.concat(F.lit("fe-"), n).alias("id"), F.col("question").alias("nl"),
            F.concat(F.lit(label), n).alias("kql"), (n % 2 == 0).alias("even"),
        )

    merged = versions.merge_latest(pairs("kql v1 "), pairs("kql v2 ").where("even"), ["id"])
    return merged.select("id", "nl", "kql")
