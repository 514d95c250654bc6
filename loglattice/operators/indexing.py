"""Documents to chunks, chunk metadata, and the term index."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglattice.functions import metadata as meta
from loglattice.functions import text as tx
from loglattice.functions.identifiers import tag_identifiers


def tag_documents(docs: DataFrame) -> DataFrame:
    """Trim the text, drop blank documents, tag identifiers."""
    stripped = docs.where(tx.not_blank(F.col("raw_text"))).withColumn(
        "raw_text", tx.strip(F.col("raw_text"))
    )
    return stripped.withColumn("raw_text", tag_identifiers("raw_text"))


def split_chunks(docs: DataFrame) -> DataFrame:
    """One row per chunk by the rule of the document's source; other columns are kept.

    Texts are not blank here, so no chunk is either.
    """
    source, text = F.col("source_type"), F.col("raw_text")
    windowed = source.isin(meta.WINDOW_SOURCES)
    sections = F.when(windowed, F.array(text)).otherwise(tx.paragraphs(text))
    size = F.when(windowed, meta.WINDOW_SIZE).otherwise(meta.PARAGRAPH_SIZE)
    overlap = F.when(windowed, meta.WINDOW_OVERLAP).otherwise(0)
    cut = F.flatten(F.transform(sections, lambda s: tx.word_windows(s, size, overlap)))
    known = source.isin(meta.WINDOW_SOURCES + meta.PARAGRAPH_SOURCES)
    pieces = F.when(known, cut).otherwise(F.array(text))
    kept = [c for c in docs.columns if c != "raw_text"]
    rows = docs.select(*kept, F.posexplode(pieces).alias("ordinal", "content"))
    return rows.withColumn("chunk_id", tx.chunk_id(F.col("doc_id"), F.col("ordinal")))


def _flag(rows: DataFrame, column: str, key: str) -> Column:
    """The flag's column, or where a source has none, its entry in ``metadata``."""
    return F.col(column) if column in rows.columns else F.lower(F.col("metadata")[key]) == "true"


def enrich(rows: DataFrame) -> DataFrame:
    """Status, acceptance and tier from ``metadata``, and ``accepted_flag`` and ``merged_flag`` if given."""
    status = meta.resolution_status(F.col("metadata"))
    accepted = meta.is_accepted(_flag(rows, "accepted_flag", "is_accepted_answer"))
    merged = _flag(rows, "merged_flag", "pr_merged")
    tier = meta.authority_tier(F.col("source_type"), status, accepted, merged)
    return rows.select(
        *[c for c in rows.columns if c not in ("metadata", "accepted_flag", "merged_flag")],
        status.alias("resolution_status"),
        accepted.alias("is_accepted_answer"),
        tier.alias("authority_tier"),
        F.lit(1.0).alias("recency_score"),
    )


PAYLOAD = [
    "chunk_id", "doc_id", "content", "ordinal", "source_type", "source_uri", "authority_tier",
    "created_at", "resolution_status", "is_accepted_answer", "recency_score",
]


def prepare_chunks(docs: DataFrame) -> DataFrame:
    """Raw documents to indexable chunk rows; narrow, no shuffle."""
    return split_chunks(enrich(tag_documents(docs))).select(*PAYLOAD)


def with_vectors(
    chunks: DataFrame, embedder: Callable[[Column], Column] = tx.hash_vector
) -> DataFrame:
    """Add ``vector`` by a supplied pandas UDF or Column function over the content."""
    return chunks.withColumn("vector", embedder(F.col("content")))


def with_point_id(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("point_id", tx.uuid5(F.col("chunk_id")))


TASK_TEXT = 4 * 1024 * 1024  # bytes of text whose terms one task counts; these take some fifty times as much


def text_tasks(rows: DataFrame, text: str) -> int:
    """Tasks over which the terms of ``text`` are spread: by its measured size, at least one per core.

    What a task holds, its terms and their (question, text) sums, then stays the same however
    much text there is.
    """
    size = rows.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_TEXT))


def place(rows: DataFrame, key: str, text: str, carry: Sequence[str] = (), tasks: int | None = None) -> DataFrame:
    """Texts placed by ``key`` once, over ``tasks`` (None: by ``text_tasks``).

    Counting, per-text maxima and per-text sums reuse the placement instead of
    shuffling terms, and several branches of one plan share the exchange.
    """
    return rows.select(key, *carry, text).repartition(tasks or text_tasks(rows, text), key)


def tokenised(placed: DataFrame, text: str) -> DataFrame:
    """Replace ``text`` by ``_tokens`` and their number ``dl``."""
    kept = [c for c in placed.columns if c != text]
    listed = placed.select(*kept, tx.tokens(F.col(text)).alias("_tokens"))
    return listed.withColumn("dl", F.size("_tokens"))


def term_counts(
    rows: DataFrame, key: str, text: str, carry: Sequence[str] = (), tasks: int | None = None
) -> DataFrame:
    """``(key, token, tf, dl)``: occurrences of each token and tokens in the text."""
    return placed_counts(place(rows, key, text, carry, tasks), key, text, carry)


def placed_counts(
    placed: DataFrame, key: str, text: str, carry: Sequence[str] = (), only: DataFrame | None = None
) -> DataFrame:
    """Counts from placed texts, of the tokens in ``only`` when given.

    explode_outer: plain explode would have Spark tokenise a second time in a size filter.
    """
    terms = (
        tokenised(placed, text)
        .select(key, *carry, "dl", F.explode_outer("_tokens").alias("token"))
        .where(F.col("token").isNotNull())
    )
    if only is not None:
        terms = terms.join(only, "token", "left_semi")
    return terms.groupBy(key, "token").agg(
        F.count(F.lit(1)).alias("tf"), *[F.first(c).alias(c) for c in ("dl", *carry)]
    )


def term_weights(rows: DataFrame, key: str, text: str, carry: Sequence[str] = ()) -> DataFrame:
    """Sparse vector rows ``(key, token, idx, weight)`` with weight = tf / max tf of the text."""
    top = F.max("tf").over(Window.partitionBy(key))
    return term_counts(rows, key, text, carry).select(
        key,
        "token",
        tx.token_index(F.col("token")).alias("idx"),
        (F.col("tf") / top).alias("weight"),
        *carry,
    )


def postings(chunks: DataFrame, carry: Sequence[str] = (), tasks: int | None = None) -> DataFrame:
    """The term index of a chunk table: ``(chunk_id, token, tf, dl, max_tf)``, placed by chunk."""
    top = F.max("tf").over(Window.partitionBy("chunk_id"))
    return term_counts(chunks, "chunk_id", "content", carry, tasks).withColumn("max_tf", top)


def save_postings(index: DataFrame, table: str, buckets: int, path: str | None = None) -> None:
    """Store a term index bucketed by chunk, so ranking over it shuffles no term again.

    A ranking reads a bucket per task, so ``buckets`` follows the text (``text_tasks``); postings
    placed over as many tasks write one file each.
    """
    writer = index.write.mode("overwrite").format("parquet").bucketBy(buckets, "chunk_id")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def ingest_summary(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents fetched and chunks indexed per source."""
    fetched = docs.groupBy("source_type").agg(F.count(F.lit(1)).alias("documents_indexed"))
    made = chunks.groupBy("source_type").agg(F.count(F.lit(1)).alias("chunks_indexed"))
    return fetched.join(made, "source_type", "left").select(
        F.lit("success").alias("status"),
        "source_type",
        "documents_indexed",
        F.coalesce("chunks_indexed", F.lit(0)).alias("chunks_indexed"),
    )
