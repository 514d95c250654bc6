"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of words.

Test items travel to the documents in blocks of bounded size.  Every n-gram that an item and a
document share seeds an alignment of the two, however many documents hold it.  Stretches of the
document with too few of the item's words to reach the least score are left out beforehand, which
changes no result.  The alignment, which allows for changed, missing and added words, is scored
against that of an exact copy.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.llm import common as c
from loglattice.llm.registry import query

N = 4  # words of a seed
LEAST = 0.5  # of an exact copy's score
MATCH, MISS, GAP = 2, -1, -1
BLOCK_BYTES = 4 << 20  # of items that are broadcast at once
FILTER_BITS = 22
WORD = regex.compile(r"[\p{L}\p{N}\p{M}]+")


BLOCK_CHARS = 1 << 20  # code points that are hashed at once


def code_points() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: whether it is part of a word, and its 64 random-looking bits."""
    inside = np.zeros(0x110000, bool)
    for found in WORD.finditer("".join(map(chr, range(len(inside))))):
        inside[found.start() : found.end()] = True
    return inside, c.mixed(np.arange(1, len(inside) + 1, dtype=np.uint64) * c.MULTIPLIER)


def word_codes(text: str | None) -> np.ndarray:
    """A hash per word (letters, digits and marks, lower-cased: punctuation and case are no difference).

    A long text is hashed in blocks that end between words, so memory beside the text is bounded
    by the block, or by a longer word.
    """
    inside, bits = c.kept("code points", code_points)
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    out, at = [], 0
    while at < len(points):
        end = min(at + BLOCK_CHARS, len(points))
        while end < len(points) and inside[points[end]] and inside[points[end - 1]]:
            end += 1
        out.append(block_codes(points[at:end], inside, bits))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def block_codes(points: np.ndarray, inside: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The hash of every run of word characters: its characters' bits times powers by place, summed."""
    edge = np.flatnonzero(np.diff(inside[points], prepend=False, append=False))
    start, length = edge[::2], edge[1::2] - edge[::2]
    if not len(start):
        return np.empty(0, np.uint64)
    first = np.cumsum(length) - length
    power = np.multiply.accumulate(np.full(int(length.max()), c.MULTIPLIER))
    place = np.arange(int(length.sum())) - np.repeat(first, length)
    terms = bits[points[place + np.repeat(start, length)]] * power[place]
    return c.mixed(np.add.reduceat(terms, first))


def grams(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words; of all words if there are fewer."""
    return c.window_hashes(codes, min(n, len(codes))) if len(codes) else np.empty(0, np.uint64)


def alignment(item: np.ndarray, passage: np.ndarray) -> float:
    """Best local alignment score over that of an exact copy of the item."""
    row = np.zeros(len(passage) + 1, np.int32)
    slope = np.arange(len(passage) + 1, dtype=np.int32) * -GAP
    best = 0
    for code in item:
        new = np.empty_like(row)
        new[0] = 0
        np.maximum(row[:-1] + np.where(passage == code, MATCH, MISS), row[1:] + GAP, out=new[1:])
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + slope) - slope  # gaps along the passage, all at once
        best = max(best, int(row.max()))
    return best / (MATCH * len(item)) if len(item) else 0.0


class Items:
    """One block of items: what finds and bounds them, as flat arrays.

    An n-gram of ``n`` words is looked for everywhere; a shorter item counts as one n-gram."""

    def __init__(self, items: list[tuple], n: int):
        self.ids = [i for i, _ in items]
        self.coded = [word_codes(text) for _, text in items]
        lengths = np.array([len(x) for x in self.coded], np.int64)
        self.sizes = sorted({min(n, len(x)) for x in self.coded if len(x)})
        own = [np.unique(grams(x, n)) for x in self.coded]
        gram = np.concatenate(own or [np.empty(0, np.uint64)])
        owner = np.repeat(np.arange(len(own)), [len(x) for x in own])
        by = np.argsort(gram, kind="stable")
        self.grams, self.first, self.held = np.unique(gram[by], return_index=True, return_counts=True)
        self.owner = owner[by]  # items of the i-th n-gram: ``held[i]`` entries from ``first[i]`` on
        self.vocabulary, number = np.unique(np.concatenate(self.coded or [np.empty(0, np.uint64)]), return_inverse=True)
        kinds, self.times = np.unique(
            np.repeat(np.arange(len(lengths)), lengths) * max(1, len(self.vocabulary)) + number, return_counts=True
        )
        self.word = kinds % max(1, len(self.vocabulary))  # distinct words of the items, one item after the other
        self.kinds = np.bincount(kinds // max(1, len(self.vocabulary)), minlength=len(lengths))
        self.start = np.cumsum(self.kinds) - self.kinds
        self.lengths = lengths
        seen = np.zeros(1 << FILTER_BITS, bool)
        seen[(self.grams >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        self.filter = np.packbits(seen)

    def sharing(self, codes: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """The items that share an n-gram with the words ``codes``."""
        found = []
        for size in self.sizes:
            h = c.window_hashes(codes, size)
            h = np.unique(h[seen[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]])
            at = np.minimum(np.searchsorted(self.grams, h), len(self.grams) - 1)
            at = at[self.grams[at] == h]
            found.append(self.owner[c.runs(self.first[at], self.held[at])])
        return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)

    def leaked(self, codes: np.ndarray, seen: np.ndarray, least: float) -> Iterator[tuple[int, float]]:
        """Item and score of every item that shares an n-gram and whose best alignment reaches ``least``.

        An alignment with M equal words, X changed and G skipped ones scores 2M - X - G, so to
        reach ``least`` it needs M >= least * length, and it spans at most 3M - 2 * least * length words
        of the text.  Only items and stretches that can have that are aligned; none else can reach it.
        """
        some = self.sharing(codes, seen)
        if not len(some):
            return
        number = np.minimum(np.searchsorted(self.vocabulary, codes), len(self.vocabulary) - 1)
        number = np.where(self.vocabulary[number] == codes, number, len(self.vocabulary))
        have = np.bincount(number, minlength=len(self.vocabulary) + 1)
        need = np.maximum(1, np.ceil(least * self.lengths - 1e-9)).astype(np.int64)
        bound = np.empty(len(some), np.int64)
        for a in range(0, len(some), 1 << 12):
            own = some[a : a + (1 << 12)]
            at = c.runs(self.start[own], self.kinds[own])
            edges = np.cumsum(self.kinds[own]) - self.kinds[own]
            bound[a : a + len(own)] = np.add.reduceat(np.minimum(have[self.word[at]], self.times[at]), edges)
        mark = np.zeros(len(self.vocabulary) + 1, bool)
        for item in some[bound >= need[some]].tolist():
            words = self.word[self.start[item] : self.start[item] + self.kinds[item]]
            mark[words] = True
            equal = np.concatenate([[0], np.cumsum(mark[number])])
            mark[words] = False
            size = int(self.lengths[item])
            span = min(len(codes), max(size, math.floor(size * (3 - 2 * least) + 1e-9)))
            at = np.flatnonzero(equal[span:] - equal[:-span] >= need[item])  # where such a stretch begins
            edge = np.flatnonzero(np.diff(at) > span) + 1
            best = 0.0
            for a, b in zip([0, *edge], [*edge, len(at)]):
                if a < b:
                    best = max(best, alignment(self.coded[item], codes[at[a] : at[b - 1] + span]))
            if best >= least:
                yield item, best


def searched(docs: DataFrame, items: list[tuple], n: int, least: float) -> DataFrame:
    """Scores of the documents with one block of items; every document is judged alone."""
    shared = c.whole(docs.sparkSession, Items(items, n))  # one block's worth

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = c.arrived(shared)
        seen = np.unpackbits(own.filter).astype(bool)
        for batch in batches:
            owners, names, scores = [], [], []
            for i, text in enumerate(batch.column(1)):
                for item, score in own.leaked(word_codes(text.as_py()), seen, least):
                    owners.append(i)
                    names.append(own.ids[item])
                    scores.append(score)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owners, pa.int64())), pa.array(names, pa.int64()), pa.array(scores, pa.float64())],
                ["doc_id", "item_id", "score"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        find, "doc_id long, item_id long, score double"
    )


def matches(docs: DataFrame, items: DataFrame, n: int = N, least: float = LEAST) -> DataFrame:
    """doc_id, item_id and score of every leaked item: it shares an n-gram of ``n`` words with the
    document, and the best alignment with a stretch of it reaches ``least`` of an exact copy's score.

    Null or wordless texts on either side match nothing; equal items are reported each; rows that
    repeat an id count as one document with its best score; a null doc_id or item_id is an id like
    any other; empty tables give an empty one; other columns are not read.  Texts of any length
    are searched whole.
    """
    spark = docs.sparkSession
    size = items.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    named = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    named = named.where("text IS NOT NULL")
    parts = []
    for block in range(blocks):
        own = [tuple(r) for r in named.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).collect()]
        own.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        if own:
            parts.append(searched(docs, own, n, least))
    if not parts:
        return spark.createDataFrame([], "doc_id long, item_id long, score double")
    found = parts[0]
    for more in parts[1:]:
        found = found.union(more)
    return found.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text holds a leaked item.

    Rows are judged by their text, not by their id: a leaked row takes no other row without an id,
    or of the same id, with it.  Texts are told apart by 64-bit hashes.  Null texts stay.
    """
    text = F.xxhash64(F.col("text").cast("string"))
    leaked = matches(docs.select(text.alias("doc_id"), "text"), items).select(F.col("doc_id").alias("_leaked")).distinct()
    own = docs.select(F.struct("*").alias("row"), text.alias("_hash"))
    return own.join(leaked, F.col("_hash") == F.col("_leaked"), "left_anti").select("row.*")


@query("op10_benchmark_decontamination")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return matches(c.table(spark, folder, "documents"), c.table(spark, folder, "benchmark"))
