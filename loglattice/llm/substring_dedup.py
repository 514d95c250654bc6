"""Substring dedup by a join of word windows against every earlier document.

A reference block indexes all windows of ``n`` words whose hash falls to it, each with the first
place it starts at: smallest document id, then position.  Every document asks the blocks for its
windows, and its answers are joined into factors: a factor runs on while the next window's first
place continues that of the one before.  This stands in for a relative Lempel-Ziv parse: no longest
match is sought, so a factor ends where a window has an earlier first place elsewhere.  Every factor
has at least ``n`` words and is a duplicate span; together they cover all duplicate windows.

Windows travel as packed arrays, once per batch of documents: within a batch the copies of a
window are settled on the spot, so a passage that all documents share reaches its block once per
batch.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.llm import common as c
from loglattice.llm.registry import query

N = 13
LAST = (1 << 63) - 1  # the order of a null id: after all others
ASKS, HITS = 0, 1
SENT = "shard int, kind int, load binary"
HIT = "_bucket int, hits binary"


def windows_of(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows of a batch, their row, and their position in the row's text."""
    hashes, owner, place = [], [], []
    for row in np.argsort(batch.column(0).to_numpy(), kind="stable").tolist():  # first places first
        text = batch.column(2)[row]
        items = c.words(text.as_py())
        if len(items) >= n:
            found = c.window_hashes(c.word_hashes(items, len(items)), n)
            hashes.append(found)
            owner.append(np.full(len(found), row, np.int32))
            place.append(np.arange(len(found), dtype=np.int32))
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.int32)
    return np.concatenate(hashes), np.concatenate(owner), np.concatenate(place)


def bucket_of(order: int, crc: int, buckets: int) -> int:
    """Where a document's answers meet it (``own_bucket`` says the same in Spark)."""
    return zlib.crc32(f"{order}:{crc}".encode()) % buckets


def own_bucket(buckets: int) -> Column:
    return F.pmod(F.crc32(F.concat_ws(":", "_order", "_crc").cast("binary")), F.lit(buckets)).cast("int")


def packed_hits(buckets: int, order: np.ndarray, crc: np.ndarray, *figures: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Rows (document, position, source, source position), packed per bucket of documents."""
    docs, owner = np.unique(np.stack([order, crc], 1), axis=0, return_inverse=True) if len(order) else (np.empty((0, 2), np.int64), order)
    bucket = np.array([bucket_of(o, k, buckets) for o, k in docs.tolist()], np.int64)
    rank = np.empty(len(docs), np.int64)
    rank[np.argsort(bucket, kind="stable")] = np.arange(len(docs))  # documents of a bucket side by side
    by = np.argsort(rank[owner.ravel()] << 32 | figures[0], kind="stable")
    owner, figures = owner.ravel()[by], tuple(f[by] for f in figures)
    for s, part in c.cut(bucket[owner]):
        at, source, there = (f[part] for f in figures)
        run = np.flatnonzero(np.concatenate([[True], np.diff(owner[part]) != 0]))
        counts = np.diff(np.append(run, len(at)))
        step = np.diff(at.astype(np.int64), prepend=0)
        step[run] = at[run]  # positions start anew with each document
        offset = np.diff(there.astype(np.int64) - at, prepend=0)  # mostly zero along a copied passage
        arrays = [docs[owner[part][run]].ravel(), counts.astype(np.int32), np.frombuffer(c.gaps(np.cumsum(step)), np.uint8)]
        yield s, c.squeezed([*arrays, np.diff(source, prepend=0), offset.astype(np.int32)])


def unpacked_hits(raw: bytes) -> tuple[np.ndarray, ...]:
    """The inverse: document (order, crc), position, source, source position, row by row."""
    docs, counts, coded, source, offset = c.unsqueezed(raw)
    at = restarted(c.positions(coded.tobytes()), counts)
    docs = np.repeat(docs.reshape(-1, 2), counts, axis=0)
    return docs[:, 0], docs[:, 1], at, np.cumsum(source), np.cumsum(offset, dtype=np.int64) + at


def restarted(run: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions that grow through all runs, counted from the start of each."""
    before = np.concatenate([[0], run[np.cumsum(counts)[:-1] - 1]])
    return run - np.repeat(before, counts)


def asked(docs: DataFrame, n: int, shards: int, buckets: int) -> DataFrame:
    """Per batch of documents and block, the windows asked for; and what the batch settles."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in c.sliced(batches, 2):
            ids, crcs = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            h, owner, place = windows_of(batch, n)
            _, first, group = np.unique(h, return_index=True, return_inverse=True)
            lead = first[group]
            late = ids[owner] > ids[owner[lead]]
            out: list[tuple[int, int, bytes]] = []
            mine, src = owner[late], lead[late]
            for bucket, load in packed_hits(buckets, ids[mine], crcs[mine], place[late], ids[owner[src]], place[src]):
                out.append((bucket % shards, HITS, bucket.to_bytes(4, "little") + load))
            h, owner, place = h[~late], owner[~late], place[~late]
            shard = c.shard_of(h, shards)
            by = np.argsort(shard.astype(np.uint16) if shards < 65536 else shard, kind="stable")
            h, owner, place = h[by], owner[by], place[by]
            for s, own in c.cut(shard[by]):
                run = np.flatnonzero(np.concatenate([[True], np.diff(owner[own]) != 0]))
                rows, counts = owner[own][run], np.diff(np.append(run, own.stop - own.start))
                step = np.diff(place[own].astype(np.int64), prepend=0)
                step[run] = place[own][run]
                coded = np.frombuffer(c.gaps(np.cumsum(step)), np.uint8)
                out.append((s, ASKS, c.squeezed([ids[rows], crcs[rows], counts.astype(np.int32), coded, h[own]])))
            kinds = (pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], ["shard", "kind", "load"])

    return docs.mapInArrow(ask, SENT)


def answered(sent: DataFrame, buckets: int) -> DataFrame:
    """The blocks: find the first place of every window, and tell the later ones about it."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, crc, place, h = [], [], [], []

        def rows(found: list[tuple[int, bytes]]) -> pa.RecordBatch:
            columns = [pa.array([f[i] for f in found], k) for i, k in enumerate((pa.int32(), pa.binary()))]
            return pa.RecordBatch.from_arrays(columns, ["_bucket", "hits"])

        for batch in batches:
            ready = []
            for kind, load in zip(batch.column(1).to_pylist(), batch.column(2)):
                raw = load.as_py()
                if kind == HITS:
                    ready.append((int.from_bytes(raw[:4], "little"), raw[4:]))
                    continue
                ids, crcs, counts, coded, hashes = c.unsqueezed(raw)
                order.append(np.repeat(ids, counts))
                crc.append(np.repeat(crcs, counts))
                place.append(restarted(c.positions(coded.tobytes()), counts).astype(np.int32))
                h.append(hashes)
            if ready:
                yield rows(ready)
        if not h:
            return
        by = np.argsort(np.concatenate(h))
        h = np.concatenate(h)[by]
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        length = np.diff(np.append(start, len(h)))
        shared = np.repeat(length > 1, length)  # the others are unique windows
        by, length = by[shared], length[length > 1]
        if not len(by):
            return
        start = np.cumsum(length) - length
        order, crc, place = (np.concatenate(x)[by] for x in (order, crc, place))
        first = np.repeat(np.minimum.reduceat(order, start), length)
        there = np.repeat(np.minimum.reduceat(np.where(order == first, place, np.iinfo(np.int32).max), start), length)
        late = order > first
        found = list(packed_hits(buckets, order[late], crc[late], place[late], first[late], there[late]))
        if found:
            yield rows(found)

    return sent.mapInArrow(answer, HIT)


def factors(at: np.ndarray, source: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of one document's hits: first window, number of windows, source, place in it."""
    by = np.argsort(at, kind="stable")
    at, source, there = at[by], source[by], there[by]
    starts = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(source) != 0) | (np.diff(there) != 1)])
    first = np.flatnonzero(starts)
    return at[first], np.diff(np.append(first, len(at))), source[first], there[first]


def deduplicated(docs: DataFrame, n: int = N) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256``, ``kept_text`` and ``factors`` per row.

    A word goes if a window of ``n`` words over it also starts in a document with a smaller id;
    all windows are judged on the input.  ``factors`` lists (start, end, source id, source start)
    in words.  A null id comes after every other id and has no smaller one among nulls; rows that
    repeat an id leave each other alone; a null or empty text has no words; texts shorter than
    ``n`` words keep all.  Words are kept as they are, joined by one space.  An empty table gives
    an empty one; other columns are not read.  Windows are compared by 64-bit hashes of 64-bit
    hashes of their words.
    """
    shards = c.shards_for(docs)
    text = F.col("text").cast("string")
    base = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_order"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("_crc"),
        text.alias("text"),
        F.col("doc_id").cast("long").alias("doc_id"),
    )
    buckets = 4 * shards
    sent = asked(base, n, shards, buckets).repartition(shards, "shard")
    hits = answered(sent, buckets)
    kinds = "factors array<struct<start int, end int, source_id long, source_start int>>"
    out = f"doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text binary, {kinds}"

    def parse(docs: pa.Table, hits: pa.Table) -> pa.Table:
        factor = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("source_id", pa.int64()), ("source_start", pa.int32())])
        types = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(factor)]
        loads = [unpacked_hits(x) for x in hits.column("hits").to_pylist()]
        order, crc, at, source, there = (np.concatenate([x[i] for x in loads] or [np.empty(0, np.int64)]) for i in range(5))
        by = np.lexsort((crc, order))
        order, crc, at, source, there = (x[by] for x in (order, crc, at, source, there))
        edge = np.flatnonzero(np.concatenate([[True], (np.diff(order) != 0) | (np.diff(crc) != 0)])[: len(order)])
        where = {(int(order[a]), int(crc[a])): slice(a, b) for a, b in zip(edge, [*edge[1:], len(order)])}
        rows = []
        for o, k, body in zip(*(docs.column(x).to_pylist() for x in ("_order", "_crc", "text"))):
            items = c.words(body)
            spans, keep = [], items
            if own := where.get((o, k)):
                first, length, src, place = factors(at[own], source[own], there[own])
                ends = first + length + n - 1
                edge = np.zeros(len(items) + 1, np.int32)
                np.add.at(edge, first, 1)
                np.add.at(edge, ends, -1)
                gone = np.cumsum(edge[:-1]) > 0
                keep = [w for w, g in zip(items, gone.tolist()) if not g]
                spans = [dict(zip(("start", "end", "source_id", "source_start"), x)) for x in zip(*(v.tolist() for v in (first, ends, src, place)))]
            rest = b" ".join(keep)
            rows.append((len(items), len(items) - len(keep), hashlib.sha256(rest).hexdigest(), rest, spans))
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(types)]
        names = ["n_words", "n_removed", "kept_sha256", "kept_text", "factors"]
        return pa.table([docs.column("doc_id"), *columns], ["doc_id", *names])

    found = (
        base.withColumn("_bucket", own_bucket(buckets)).groupBy("_bucket")
        .cogroup(hits.groupBy("_bucket")).applyInArrow(parse, out)
    )
    return found.withColumn("kept_text", F.decode("kept_text", "UTF-8"))


@query("op6_substring_dedup")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    found = deduplicated(c.table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")
