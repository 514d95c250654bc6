"""Exact dedup by content-defined chunk recipes.

A text is cut where its own bytes say so, each chunk is named by a digest, and the digests are
verified: one digest seen with two contents (told apart by a second, independent hash and the
length) becomes two identifiers.  Equal texts are those with equal ordered identifier lists, so
only short lists are shuffled and no long text ever moves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.llm import common as c
from loglattice.llm.registry import query

MEAN_BITS = 10  # a cut after about 2**10 bytes
SPAN = 16  # bytes that decide on a cut
SLICE = 1 << 16  # chunks handed on at a time
NAME, PROOF = 16, 12  # bytes of a digest, and of what verifies it


def cut_points(data: np.ndarray) -> np.ndarray:
    """Ends of the chunks of ``data`` (uint8): where a rolling hash of the last bytes has
    ``MEAN_BITS`` zeros, and at the end.  Depends on the nearby bytes only."""
    n = len(data)
    if n <= SPAN:
        return np.array([n] if n else [], np.int64)
    h = np.zeros(n - SPAN + 1, np.uint32)
    wide = (data.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    for i in range(SPAN):
        h *= np.uint32(0x01000193)
        h += wide[i : n - SPAN + 1 + i]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    ends = np.flatnonzero(h >> np.uint32(32 - MEAN_BITS) == 0) + SPAN
    return ends if len(ends) and ends[-1] == n else np.append(ends, n)


def recipe(raw: bytes) -> tuple[bytes, bytes]:
    """The digest, and the proof (length and another hash), of each chunk in order."""
    names, proofs, at = [], [], 0
    for end in cut_points(np.frombuffer(raw, np.uint8)):
        piece = raw[at:end]
        names.append(hashlib.blake2b(piece, digest_size=NAME).digest())
        proofs.append(len(piece).to_bytes(4, "little") + xxhash.xxh3_64_digest(piece))
        at = end
    return b"".join(names), b"".join(proofs)


def recipes(docs: DataFrame) -> DataFrame:
    """One row per document: a number of its own (once the result is stored), the digest of its
    normalised text and its chunk list."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = 0
        for batch in batches:
            raws = ((x.as_py() or "").encode("utf-8", "surrogatepass").lower() for x in batch.column(1))
            found = [(hashlib.sha256(raw).hexdigest(), *recipe(raw)) for raw in raws]
            columns = [pa.array([f[i] for f in found], k) for i, k in enumerate((pa.string(), pa.binary(), pa.binary()))]
            row = pa.array(np.arange(count, count + batch.num_rows) + (TaskContext.get().partitionId() << 33))
            count += batch.num_rows
            yield pa.RecordBatch.from_arrays([row, batch.column(0), *columns], ["row", "doc_id", "text_sha256", "names", "proofs"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        cut, "row long, doc_id long, text_sha256 string, names binary, proofs binary"
    )


def pieces(found: DataFrame) -> DataFrame:
    """``(row, name, proof)`` of every chunk: its own few bytes, never beside the whole list."""

    def column(data: np.ndarray) -> pa.Array:
        raw = pa.py_buffer(np.ascontiguousarray(data))
        return pa.Array.from_buffers(pa.binary(data.shape[1]), len(data), [None, raw]).cast(pa.binary())

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, proofs = (
                np.frombuffer(b"".join(x.to_pylist()), np.uint8).reshape(-1, size)
                for x, size in ((batch.column(1), NAME), (batch.column(2), PROOF))
            )
            lengths = [len(x) // NAME for x in batch.column(1).to_pylist()]
            rows = np.repeat(batch.column(0).to_numpy(), lengths)
            for at in range(0, len(rows), SLICE):
                own = slice(at, at + SLICE)
                yield pa.RecordBatch.from_arrays([pa.array(rows[own]), column(names[own]), column(proofs[own])], ["row", "name", "proof"])

    return found.select("row", "names", "proofs").mapInArrow(split, "row long, name binary, proof binary")


def verified(found: DataFrame) -> DataFrame:
    """Turn digests into identifiers.  A digest that stands for two contents is in doubt; the
    recipes that hold one are widened by their proofs, which tell its contents apart.  Rows are
    joined with their doubt only where there is one, and then by their own number."""
    listed = pieces(found)
    doubtful = c.stored(
        listed.groupBy("name").agg(F.min("proof").alias("lo"), F.max("proof").alias("hi")).where("lo <> hi").select("name"), "doubtful"
    )
    if doubtful.isEmpty():
        return found.select("doc_id", "text_sha256", F.col("names").alias("ids"))
    held = listed.join(doubtful, "name", "left_semi").select("row").distinct().withColumn("_doubt", F.lit(True))
    return found.join(held, "row", "left").select(
        "doc_id", "text_sha256",
        F.when(F.col("_doubt"), F.concat(F.lit(b"\1"), "names", "proofs")).otherwise(F.col("names")).alias("ids"),
    )


def copies(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, and all empty
    texts form one group.  The row with the largest doc_id stays (null is smaller than any id).
    Rows that repeat an id with an equal text belong to one group; exactly one of them is kept.
    An empty table gives an empty one; other columns are not read.

    Groups are counted with partial aggregation, so one that holds a third of all rows meets as
    partial counts.  Only groups of two rows or more are joined back, by an equality join of two
    plain exchanges, whose full partitions Spark splits.
    """
    rows = verified(c.stored(recipes(docs), "recipes"))
    counted = rows.groupBy("ids", "text_sha256", "doc_id").agg(F.count("*").alias("_n"))
    counted = c.stored(counted, "counted")
    groups = counted.groupBy("ids").agg(F.max("doc_id").alias("keep_id"), F.sum("_n").alias("group_size"))
    groups = c.stored(groups.where("group_size > 1"), "groups")
    return (
        counted.join(groups, "ids", "left")
        .select("doc_id", "text_sha256", "keep_id", "group_size", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_i"))
        .select(
            "doc_id",
            F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
            (F.col("group_size").isNull() | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_i") == 1))).alias("kept"),
            "text_sha256",
        )
    )


SQL = f"""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), '{c.A_Z}', '{c.a_z}') AS t FROM documents)
WINDOW same AS (PARTITION BY t)
"""


@query("op8_exact_dedup", SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return copies(c.table(spark, folder, "documents"))
