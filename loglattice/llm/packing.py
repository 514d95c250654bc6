"""Mixture-controlled packing: deficit round-robin over source queues.

Each source is a queue of tokens.  A window of 2048 tokens is filled by serving, token by token,
the source that is furthest behind its target share, so every source's deficit (target minus
served) stays about one token and is carried from window to window.  What has been served after
k windows then follows from k alone (``served``), so any task can work out any window: deficits
cross partitions without a pass from one to the next, and no token moves.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loglattice.llm import common as c
from loglattice.llm.registry import query
from loglattice.operators.scale import small_side

WINDOW = 2048
END = 1  # the id behind every document
SPECIAL = "<|endoftext|>"
CACHED = 400_000  # chunks of text whose ids a worker remembers
NO_SOURCE = "\x00none"  # the queue of rows without a source
CHUNK = re.compile(r" (?=\S)")
BESIDE = re.compile(r"\s |[ ](?:\s|\Z)")


def encoding(ranks_file: str, pattern: str) -> tiktoken.Encoding:
    with open(ranks_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})


class Encoder:
    """Token ids, equal to those of ``tokenizers`` with the same vocabulary.

    The pre-tokeniser always breaks before a single space that a visible character follows, so a
    text is encoded chunk by chunk there, and the ids of chunks seen before are looked up.
    """

    def __init__(self, ranks_file: str, pattern: str):
        self.inner = c.kept(f"{ranks_file}\n{pattern}", lambda: encoding(ranks_file, pattern))
        self.first: dict[str, bytes] = {}  # ids of a text's first chunk
        self.later: dict[str, bytes] = {}  # ids of a chunk with the space before it

    def ids(self, text: str) -> bytes:
        found = self.inner.encode(text, allowed_special="all") if SPECIAL in text else self.inner.encode_ordinary(text)
        return np.array(found, "<u2").tobytes()

    def __call__(self, text: str) -> bytes:
        """Two bytes per id, the end included."""
        if len(self.first) + len(self.later) > CACHED:
            self.first.clear()
            self.later.clear()
        # a space beside other white space is left to the pattern; elsewhere every space is a break
        chunks = CHUNK.split(text) if BESIDE.search(text) else text.split(" ")
        head, rest = chunks[0], chunks[1:]
        for chunk in set(rest).difference(self.later):
            self.later[chunk] = self.ids(" " + chunk)
        if head not in self.first:
            self.first[head] = self.ids(head)
        return b"".join([self.first[head], *map(self.later.__getitem__, rest), END.to_bytes(2, "little")])


def tokenised(docs: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """doc_id, source, ids (two bytes each), doc_tokens, and where the document starts within the
    queue of its source in its partition (``_part``, ``_at``)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, queued, part = Encoder(ranks_file, pattern), {}, TaskContext.get().partitionId()
        for batch in batches:
            blobs, counts, starts = [], [], []
            for text, source in zip(batch.column(2), batch.column(1).to_pylist()):
                blobs.append(encoder(text.as_py() or ""))
                counts.append(len(blobs[-1]) // 2)
                starts.append(queued.get(source, 0))
                queued[source] = starts[-1] + counts[-1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(blobs, pa.binary()), pa.array(counts, pa.int64()),
                 pa.array([part] * len(counts), pa.int32()), pa.array(starts, pa.int64())],
                ["doc_id", "source", "ids", "doc_tokens", "_part", "_at"],
            )

    return docs.select(
        F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit(NO_SOURCE)).alias("source"),
        F.col("text").cast("string"),
    ).mapInArrow(encode, "doc_id long, source string, ids binary, doc_tokens long, _part int, _at long")


class Mixture:
    """Which tokens of which queue each window holds.

    The i-th token of queue s is due at (2 i + 1) / weight; tokens are served in order of their
    due time, equal times by queue.  ``served(k)`` counts, per queue, the tokens among the first
    ``k * window`` so served; it grows with k and sums to exactly that number.
    """

    def __init__(self, sizes: list[int], weights: list[float], window: int = WINDOW):
        self.sizes, self.window = np.array(sizes, np.int64), window
        self.weights = np.array(weights, np.float64)
        self.total = int(self.sizes.sum())
        self.known: dict[int, np.ndarray] = {}
        self.filled: dict[int, tuple[list[int], list[int], list[int]]] = {}
        # what all queues have served when each runs dry: between these times the sum is linear
        self.dry = np.concatenate([[0.0], np.sort(self.sizes / self.weights)])
        self.by_then = np.array([np.minimum(self.sizes, t * self.weights).sum() for t in self.dry])

    def due(self, counts: np.ndarray) -> np.ndarray:
        """When the token after the first ``counts`` of each queue is due; never for a dry one."""
        return np.where(counts < self.sizes, (2.0 * counts + 1.0) / self.weights, np.inf)

    def served(self, k: int) -> np.ndarray:
        if k not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[k] = self._served(min(k * self.window, self.total))
        return self.known[k]

    def _served(self, goal: int) -> np.ndarray:
        i = min(max(int(np.searchsorted(self.by_then, goal)), 1), len(self.dry) - 1)
        span = self.by_then[i] - self.by_then[i - 1]
        share = (goal - self.by_then[i - 1]) / span if span else 1.0
        time = self.dry[i - 1] + share * (self.dry[i] - self.dry[i - 1])
        counts = np.minimum(self.sizes, np.floor(time * self.weights + 0.5)).astype(np.int64)
        left, top = goal - int(counts.sum()), len(counts) - 1
        while True:  # a few tokens are missing or too many; then no waiting one may be due before a served one
            ahead, last = self.due(counts), np.where(counts > 0, (2.0 * counts - 1.0) / self.weights, -np.inf)
            a, b = int(np.argmin(ahead)), top - int(np.argmax(last[::-1]))
            if not left and (a == b or (ahead[a], a) >= (last[b], b)):
                return counts
            if left >= 0:
                counts[a] += 1
            if left <= 0:
                counts[b] -= 1
            left -= (left > 0) - (left < 0)

    def bounds(self, k: int) -> tuple[list[int], list[int], list[int]]:
        """Per queue: tokens served before and after window ``k``, and where its run begins in it."""
        if k not in self.filled:
            if len(self.filled) > 100_000:
                self.filled.clear()
            before, after = self.served(k), self.served(k + 1)
            taken = after - before
            self.filled[k] = before.tolist(), after.tolist(), (np.cumsum(taken) - taken).tolist()
        return self.filled[k]

    def window_of(self, s: int, token: int) -> int:
        """The window that holds a token of queue ``s``."""
        lo, hi = 0, -(-self.total // self.window)
        guess = int(np.minimum(self.sizes, (token + 0.5) / self.weights[s] * self.weights).sum()) // self.window
        step = 1
        if self.served(guess)[s] <= token:  # gallop from the guess, then halve
            lo = guess
            while lo + step < hi and self.served(lo + step)[s] <= token:
                lo, step = lo + step, step * 2
            hi = min(hi, lo + step)
        else:
            hi = guess
            while hi - step > 0 and self.served(hi - step)[s] > token:
                hi, step = hi - step, step * 2
            lo = max(0, hi - step)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self.served(mid)[s] <= token else (lo, mid)
        return lo

    def pieces(self, s: int, start: int, length: int) -> Iterator[tuple[int, int, int, int]]:
        """Window, offset in it, first token and length for each part of a run of queue ``s``."""
        k, at, end = self.window_of(s, start), start, start + length
        while at < end:
            before, after, offsets = self.bounds(k)
            stop = min(end, after[s])
            if stop > at:
                yield k, offsets[s] + at - before[s], at, stop - at
                at = stop
            k += 1


def packed(
    docs: DataFrame, ranks_file: str, pattern: str, weights: dict[str, float] | None = None, window: int = WINDOW
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    ``weights`` are target proportions by source; a source without one has as its weight the
    tokens it holds, so that by default every window has the proportions of the whole table.  A
    queue that runs dry leaves its share to the others.  Every sequence but the last is full.
    Null texts are empty (one id: the end); rows without a source are a queue of their own; null
    ids and repeated rows are packed like any other row; an empty table gives an empty one; other
    columns are not read.  The number of sources is taken to be small: their totals are collected.
    """
    tokens = c.stored(tokenised(docs, ranks_file, pattern), "tokens")
    sums = tokens.groupBy("source", "_part").agg(F.sum("doc_tokens").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("source").orderBy("_part")) - F.col("_n")
    bases = sums.select("source", "_part", before.alias("_base"))
    totals = sorted((r["source"], r["n"]) for r in sums.groupBy("source").agg(F.sum("_n").alias("n")).collect())
    names = {name: i for i, (name, _) in enumerate(totals)}
    sizes = [n for _, n in totals]
    aims = [float((weights or {}).get(name, n)) for name, n in totals]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixture = Mixture(sizes, aims, window)
        for batch in batches:
            rows, owners = [], []
            columns = [batch.column(i).to_pylist() for i in (1, 3, 4)]
            for i, (source, count, base) in enumerate(zip(*columns)):
                ids = np.frombuffer(batch.column(2)[i].as_buffer(), "<u2").astype("<u4")
                for k, offset, at, length in mixture.pieces(names[source], base, count):
                    start = at - base
                    rows.append((start, length, zlib.crc32(ids[start : start + length]), count, k, offset))
                    owners.append(i)
            take = pa.array(owners, pa.int64())
            figures = [pa.array([r[j] for r in rows], pa.int64()) for j in range(6)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), *figures, batch.column(1).take(take)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"],
            )

    # one row per source and partition, measured before it is sent; beyond that the join shuffles
    placed = tokens.join(small_side(c.stored(bases, "bases")), ["source", "_part"]).select(
        "doc_id", "source", "ids", "doc_tokens", (F.col("_base") + F.col("_at")).alias("_start")
    )
    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"
    found = placed.mapInArrow(pack, kinds)
    return found.withColumn("source", F.when(F.col("source") != NO_SOURCE, F.col("source")))


def query_packing(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return packed(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op4_packing")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return query_packing(c.table(spark, folder, "documents"))
