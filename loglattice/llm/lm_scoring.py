"""Language-model scoring with an Elias-Fano n-gram trie.

The model is an interpolated bigram model with absolute discounting over an add-one unigram
model.  Its trie is dealt to shards by context.  A shard's second level holds, context after
context, the ids of the successors: as a monotone sequence (id plus context rank times the size of
the id range) in Elias-Fano code; the pointers to where each context begins are another; one byte
per n-gram names its quantised smoothed probability.  Levels are flat bytes, written to a file and
memory-mapped; a query is a successor search relative to its context.

Texts are first kept as blocks of token numbers.  A block sends each distinct token and bigram once
to the shard that owns it, with its training count, and gets the model's answer in the same order,
so nothing is shuffled per occurrence and no model is broadcast.  Contexts so frequent that they
would fill a shard are dealt by successor as well.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.llm import common as c
from loglattice.llm.registry import query

DISCOUNT = 0.75
LEVELS = 255  # quantised values of a shard; code 0 says "not there"
START = np.uint64(xxhash.xxh3_64_intdigest(b" "))  # no word has white space, nor is empty
END = np.uint64(xxhash.xxh3_64_intdigest(b""))
HOT_SHARE = 64  # a context with 1 / (64 shards) of all tokens is dealt by successor
BLOCK = 16 << 20  # bytes of text in a block
SHARD = 3 << 20  # bytes of the table a shard stands for
COUNT, TOTAL = 0, 1


def place_of(pieces: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Where in each piece of eight words its ``rank``-th set bit lies (the first has rank 1): the
    word by counts, the bit by halving that word."""
    counts = np.cumsum(np.bitwise_count(pieces), axis=1, dtype=np.int64)
    at = (counts < rank[:, None]).sum(axis=1)
    row = np.arange(len(pieces))
    word, left = pieces[row, at], rank - np.where(at > 0, counts[row, at - 1], 0)
    out = at * 64
    for half in (32, 16, 8, 4, 2, 1):
        low = word & np.uint64((1 << half) - 1)
        ones = np.bitwise_count(low).astype(np.int64)
        upper = left > ones
        left -= np.where(upper, ones, 0)
        word = np.where(upper, word >> np.uint64(half), low)
        out += np.where(upper, half, 0)
    return out


class EliasFano:
    """A non-decreasing sequence of integers below ``universe``: low bits packed, high bits unary.

    ``raw`` is its bytes, so that a sequence can be read where it lies in a mapped file."""

    def __init__(self, raw: np.ndarray):
        head = raw[:24].view(np.int64)
        self.n, self.low_bits, upper = int(head[0]), int(head[1]), int(head[2])
        at = 24 + -(-self.n * self.low_bits // 8) + 8
        self.low, self.upper = raw[24:at], raw[at : at + upper]
        at += upper
        self.zeros = np.frombuffer(raw[at : at + upper // 8].tobytes(), np.int64)  # zeros before each 64-byte piece

    @staticmethod
    def build(values: np.ndarray, universe: int) -> np.ndarray:
        n = len(values)
        low_bits = max(0, int(universe // max(n, 1)).bit_length() - 1)
        values = values.astype(np.uint64)
        low = np.zeros(-(-n * low_bits // 8) + 8, np.uint8)
        for a in range(0, n, 1 << 16):  # a multiple of 8 values fills whole bytes
            part = values[a : a + (1 << 16), None] >> np.arange(low_bits, dtype=np.uint64) & np.uint64(1)
            packed = np.packbits(part.astype(np.uint8).ravel(), bitorder="little")
            low[a * low_bits // 8 : a * low_bits // 8 + len(packed)] = packed
        high = (values >> np.uint64(low_bits)).astype(np.int64)
        bits = np.zeros(-(-(n + (int(high[-1]) if n else 0) + 2) // 512) * 512, np.uint8)
        bits[high + np.arange(n)] = 1
        ones = np.bitwise_count(np.packbits(bits, bitorder="little").view(np.uint64)).reshape(-1, 8).sum(axis=1, dtype=np.int64)
        zeros = np.concatenate([[0], np.cumsum(512 - ones)])[:-1]
        upper = np.packbits(bits, bitorder="little")
        head = np.array([n, low_bits, len(upper)], np.int64).view(np.uint8)
        return np.concatenate([head, low, upper, zeros.astype(np.int64).view(np.uint8)])

    def bucket_start(self, high: np.ndarray) -> np.ndarray:
        """How many values have a smaller high part: the ones before the ``high``-th zero."""
        out = np.zeros(len(high), np.int64)
        some = np.flatnonzero(high > 0)
        if 16 * len(some) > self.n:  # so many that one pass over the unary part is cheaper
            zero = np.flatnonzero(np.unpackbits(self.upper, bitorder="little") == 0)
            out[some] = zero[high[some] - 1] - (high[some] - 1)
            return out
        for a in range(0, len(some), 1 << 16):
            own = some[a : a + (1 << 16)]
            rank = high[own]  # the position of this zero, counted from 1
            piece = np.searchsorted(self.zeros, rank, side="left") - 1
            out[own] = piece * 512 + place_of(~self.piece(piece), rank - self.zeros[piece]) - (rank - 1)
        return out

    def get(self, index: np.ndarray) -> np.ndarray:
        """The values at ``index``."""
        if 16 * len(index) > self.n:
            high = np.flatnonzero(np.unpackbits(self.upper, bitorder="little"))[index] - index
            return (high << self.low_bits) | self.low_of(index).astype(np.int64)
        out = np.zeros(len(index), np.int64)
        ones = np.arange(len(self.zeros)) * 512 - self.zeros
        for a in range(0, len(index), 1 << 16):
            own = index[a : a + (1 << 16)]
            piece = np.searchsorted(ones, own + 1, side="left") - 1
            high = piece * 512 + place_of(self.piece(piece), own + 1 - ones[piece]) - own
            out[a : a + len(own)] = (high << self.low_bits) | self.low_of(own).astype(np.int64)
        return out

    def piece(self, number: np.ndarray) -> np.ndarray:
        """The 512 bits of each numbered piece of the unary part, as eight words."""
        return self.upper.reshape(-1, 64)[number].view(np.uint64)

    def low_of(self, index: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(index), np.uint64)
        bit = index * self.low_bits
        value = np.zeros(len(index), np.uint64)
        for i in range(min(8, self.low_bits // 8 + 2)):
            value |= self.low[(bit >> 3) + i].astype(np.uint64) << np.uint64(8 * i)
        return value >> (bit & 7).astype(np.uint64) & np.uint64((1 << self.low_bits) - 1)

    def find(self, targets: np.ndarray) -> np.ndarray:
        """Index of each target, or -1: the successor search within its bucket of high parts."""
        high = (targets >> np.uint64(self.low_bits)).astype(np.int64)
        low = targets & np.uint64((1 << self.low_bits) - 1)
        top = int(self.zeros[-1]) + 512
        inside = high < top
        lo, hi = np.zeros(len(high), np.int64), np.zeros(len(high), np.int64)
        both = np.concatenate([high[inside], np.minimum(high[inside] + 1, self.most())])
        lo[inside], hi[inside] = np.split(self.bucket_start(both), 2)
        hi = np.minimum(hi, self.n)
        end = hi.copy()
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            less = self.low_of(mid) < low[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
        found = np.full(len(high), -1, np.int64)
        there = np.flatnonzero(lo < end)
        good = there[self.low_of(lo[there]) == low[there]]
        found[good] = lo[good]
        return found

    def most(self) -> int:
        """The number of zeros that are written."""
        last = self.upper.reshape(-1, 64)[-1]
        return int(self.zeros[-1]) + 512 - int(np.bitwise_count(last).sum())


class Trie:
    """Contexts, successors and codes of one shard, read from a mapped file."""

    def __init__(self, raw: np.ndarray):
        sizes = raw[:48].view(np.int64)
        parts, at = [], 48
        for size in sizes:
            parts.append(raw[at : at + int(size)])
            at += int(size)
        self.contexts, self.words = parts[0].view(np.uint64), parts[1].view(np.uint64)
        self.successors = EliasFano(parts[2]) if len(parts[2]) else None
        self.codes, self.values = parts[3], parts[4].view(np.float64)
        self.pointers = EliasFano(parts[5]) if len(parts[5]) else None

    @staticmethod
    def build(context: np.ndarray, word: np.ndarray, probability: np.ndarray) -> np.ndarray:
        """From bigrams sorted by context and word, all distinct, with probabilities."""
        contexts, rank = np.unique(context, return_inverse=True)
        known, number = np.unique(word, return_inverse=True)
        codes, values = np.empty(0, np.uint8), np.zeros(LEVELS + 1)
        levels = pointers = np.empty(0, np.uint8)
        if len(context):
            edges = np.append(np.searchsorted(context, contexts), len(context))
            pointers = EliasFano.build(edges, len(context) + 1)
            levels = EliasFano.build(rank.astype(np.int64) * len(known) + number, len(contexts) * len(known))
            scale = np.log(probability)
            low, span = scale.min(), max(scale.max() - scale.min(), 1e-9)
            codes = (1 + np.minimum(LEVELS - 1, (scale - low) / span * LEVELS)).astype(np.uint8)
            sums, members = np.bincount(codes, probability, LEVELS + 1), np.bincount(codes, minlength=LEVELS + 1)
            values = np.divide(sums, members, out=np.zeros(LEVELS + 1), where=members > 0)
        parts = [x.view(np.uint8) for x in (contexts, known)] + [levels, codes, values.view(np.uint8), pointers]
        pad = [np.concatenate([p, np.zeros(-len(p) % 8, np.uint8)]) for p in parts]
        return np.concatenate([np.array([len(p) for p in pad], np.int64).view(np.uint8), *pad])

    def query(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Code of each bigram, 0 if it is not there."""
        out = np.zeros(len(context), np.uint8)
        if self.successors is None:
            return out
        rank = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
        number = np.minimum(np.searchsorted(self.words, word), self.known() - 1)
        own = np.flatnonzero((self.contexts[rank] == context) & (self.words[number] == word))
        at = self.successors.find((rank[own] * self.known() + number[own]).astype(np.uint64))
        out[own[at >= 0]] = self.codes[at[at >= 0]]
        return out

    def known(self) -> int:
        return len(self.words)

    def successors_of(self, context: np.ndarray) -> np.ndarray:
        """How many successors each context has here: from one pointer to the next."""
        out = np.zeros(len(context), np.int64)
        if self.pointers is not None:
            rank = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
            own = np.flatnonzero(self.contexts[rank] == context)
            out[own] = self.pointers.get(rank[own] + 1) - self.pointers.get(rank[own])
        return out


def mapped(raw: np.ndarray, use):
    """Write the trie to a file of the task's own, map it, use it, and leave nothing behind."""
    with tempfile.TemporaryFile() as file:
        file.write(raw.data)
        file.flush()
        return use(Trie(np.memmap(file, np.uint8, "r")))


def blocks(docs: DataFrame, training: Column) -> DataFrame:
    """Rows of packed documents: ids, whether trained on, token numbers (by falling frequency in
    the block), and the tokens' hashes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        for batch in c.sliced(batches, 2, BLOCK):
            items = [c.words(t.as_py(), lower=True) for t in batch.column(2)]
            lengths = np.array([len(x) for x in items], np.int64)
            flat = pa.array((w for x in items for w in (*x, b"")), pa.large_binary())  # the empty word is the end
            coded = flat.dictionary_encode()
            del items, flat
            index = coded.indices.to_numpy()
            known = c.word_hashes(coded.dictionary.to_pylist(), len(coded.dictionary))
            by = np.argsort(-np.bincount(index, minlength=len(known)), kind="stable")
            number = np.empty(len(known), np.uint32 if len(known) > 65535 else np.uint16)
            number[by] = np.arange(len(known))
            trained = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            load = c.squeezed([trained.astype(np.uint8), lengths, number[index], known[by]])
            yield pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + count], pa.int64()), pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([load], pa.binary())],
                ["block", "ids", "load"],
            )
            count += 1

    return docs.select(F.col("doc_id").cast("long"), training.alias("trained"), F.col("text").cast("string")).mapInArrow(
        pack, "block long, ids array<long>, load binary"
    )


class Block:
    """A block unpacked: its tokens and its bigrams, each distinct one once, dealt to shards."""

    def __init__(self, load: bytes):
        trained, self.lengths, number, self.tokens = c.unsqueezed(load)
        self.number, self.trained = number.astype(np.int64), trained.astype(bool)
        self.ends = np.cumsum(self.lengths + 1)
        self.used = np.repeat(self.trained, self.lengths + 1)  # per token: it is trained on
        self.known = np.append(self.tokens, START)

    def counts(self) -> np.ndarray:
        """Training count of each token, and of texts for the start."""
        return np.append(np.bincount(self.number[self.used], minlength=len(self.tokens)), self.trained.sum())

    def bigrams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct bigrams in order of (context, word) number, their training counts, and which
        of them each token ends."""
        before = np.concatenate([[0], self.number[:-1]]) if len(self.number) else self.number
        before[np.concatenate([[0], self.ends[:-1]])[: len(self.ends)]] = len(self.tokens)
        pair, inverse = np.unique(before * (len(self.tokens) + 1) + self.number, return_inverse=True)
        trained = np.bincount(inverse[self.used], minlength=len(pair))
        return pair // (len(self.tokens) + 1), pair % (len(self.tokens) + 1), trained, inverse

    def dealt(
        self, hot: tuple[np.ndarray, np.ndarray, np.ndarray], shards: int
    ) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Shard, index of its bigrams, the contexts asked for there, and the bigrams of each.

        A hot context lies in several pieces, chosen by the successor.  Its block asks all of
        them how many successors they have, also those it has no bigram for."""
        context, word, _, _ = self.bigrams_ = self.bigrams()
        tokens, _, pieces = hot
        parts = np.ones(len(self.known), np.int64)
        if len(tokens):
            place = np.minimum(np.searchsorted(tokens, self.known), len(tokens) - 1)
            parts = np.where(tokens[place] == self.known, pieces[place], 1)

        def home(context: np.ndarray, piece: np.ndarray) -> np.ndarray:
            shard = c.shard_of(c.mixed(self.known[context] + piece.astype(np.uint64) * c.MULTIPLIER), shards)
            return shard.astype(np.int64) * len(self.known) + context

        used = np.unique(context)
        units = np.unique(home(np.repeat(used, parts[used]), c.runs(np.zeros(len(used), np.int64), parts[used])))
        unit = np.zeros(len(self.known), np.int64)
        unit[used] = np.searchsorted(units, home(used, np.zeros(len(used), np.int64)))
        own = unit[context]
        split = np.flatnonzero(parts[context] > 1)
        piece = c.mixed(self.known[word[split]]) % parts[context[split]].astype(np.uint64)
        own[split] = np.searchsorted(units, home(context[split], piece))
        by, length = np.argsort(own, kind="stable"), np.bincount(own, minlength=len(units))
        ends = np.cumsum(length)
        for s, part in c.cut(units // len(self.known)):
            bigrams = by[ends[part.start] - length[part.start] : ends[part.stop - 1]]
            yield s, bigrams, units[part] % len(self.known), length[part]


def counted(packed: DataFrame, shards: int) -> DataFrame:
    """The unigram counts: per block and shard the corpus count of each token it asked for, and
    per shard (block null) the number of tokens and of kinds, and the counts that may be hot."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, name in enumerate(batch.column(0).to_pylist()):
                block = Block(batch.column(2)[i].as_py())
                counts = block.counts()
                by = np.argsort(shard := c.shard_of(block.known, shards), kind="stable")
                cuts = c.cut(shard[by])
                loads = [c.squeezed([block.known[by[p]], counts[by[p]].astype(np.uint32)]) for _, p in cuts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s for s, _ in cuts], pa.int32()), pa.array([name] * len(cuts), pa.int64()), pa.array(loads, pa.binary())],
                    ["shard", "block", "load"],
                )

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(x.to_pylist() for x in b.columns))]
        if not rows:
            return
        loads = [c.unsqueezed(r[2]) for r in rows]
        tokens, where = np.unique(np.concatenate([x[0] for x in loads]), return_inverse=True)
        sums = np.bincount(where, np.concatenate([x[1] for x in loads])).astype(np.int64)
        shard, block, out, at = [], [], [], 0
        for (s, name, _), (own, _) in zip(rows, loads):
            shard.append(s)
            block.append(name)
            out.append(c.squeezed([sums[where[at : at + len(own)]]]))
            at += len(own)
        words = tokens != START
        may = is_hot(sums, int(sums[words].sum()), shards)  # all shards together have more tokens, never fewer
        none = [None] * len(rows)
        columns = [
            pa.array([*shard, None], pa.int32()), pa.array([*block, None], pa.int64()),
            pa.array([*out, c.squeezed([tokens[may], sums[may]])], pa.binary()),
            pa.array([*none, sums[words].sum()], pa.int64()), pa.array([*none, (sums[words] > 0).sum()], pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["shard", "block", "load", "n_tokens", "n_kinds"])

    asked = packed.mapInArrow(ask, "shard int, block long, load binary").repartition(shards, "shard")
    return asked.mapInArrow(total, "shard int, block long, load binary, n_tokens long, n_kinds long")


def is_hot(counts: np.ndarray, n_tokens: int, shards: int) -> np.ndarray:
    """Which counts are more than 1 / (``HOT_SHARE`` * ``shards``) of all tokens."""
    return counts * HOT_SHARE * shards > max(1, n_tokens)


def frequent(unigrams: DataFrame, n_tokens: int, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, counts and numbers of pieces of the contexts that are dealt by successor.

    The shards' counts are filtered where they lie, by the total of all; what comes back are fewer
    than ``HOT_SHARE`` * ``shards`` tokens in all, and the start."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for load in batch.column(0).to_pylist():
                tokens, counts = c.unsqueezed(load)
                if (hot := is_hot(counts, n_tokens, shards)).any():
                    load = c.squeezed([tokens[hot], counts[hot]])
                    yield pa.RecordBatch.from_arrays([pa.array([load], pa.binary())], ["load"])

    found = unigrams.where("block IS NULL").select("load").mapInArrow(keep, "load binary").collect()
    loads = [c.unsqueezed(r["load"]) for r in found]
    tokens = np.concatenate([x[0] for x in loads] or [np.empty(0, np.uint64)])
    totals = np.concatenate([x[1] for x in loads] or [np.empty(0, np.int64)])
    by = np.argsort(tokens)
    pieces = np.minimum(2 * shards, totals[by] * HOT_SHARE * shards // max(1, n_tokens) + 1)
    return tokens[by], totals[by], pieces


def answered(packed: DataFrame, shards: int, hot: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """Per block and shard: for each context the successors it has there in training, and for
    each bigram its code; with the shard's values of the codes."""
    shared = packed.sparkSession.sparkContext.broadcast(hot)  # HOT_SHARE per shard on average, at most

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, name in enumerate(batch.column(0).to_pylist()):
                block, sent, loads = Block(batch.column(2)[i].as_py()), [], []
                for s, own, contexts, length in block.dealt(shared.value, shards):
                    _, word, trained, _ = block.bigrams_
                    h = block.known[contexts]
                    count = trained[own].astype(np.uint8 if trained[own].max(initial=0) < 256 else np.uint32)
                    sent.append(s)
                    loads.append(c.squeezed([h, length.astype(np.uint32), block.known[word[own]], count]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sent, pa.int32()), pa.array([name] * len(sent), pa.int64()), pa.array(loads, pa.binary())],
                    ["shard", "block", "load"],
                )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(x.to_pylist() for x in b.columns))]
        if not rows:
            return

        loads = [c.unsqueezed(r[2]) for r in rows]
        asked, rank = np.unique(np.concatenate([x[0] for x in loads]), return_inverse=True)
        words, number = np.unique(np.concatenate([x[2] for x in loads]), return_inverse=True)
        lengths = np.concatenate([x[1] for x in loads])
        pair = np.repeat(rank, lengths) * len(words) + number
        del number
        by = np.argsort(pair)
        first = np.flatnonzero(np.diff(pair[by], prepend=-1))
        count = np.concatenate([x[3].astype(np.int64) for x in loads])[by]
        count = np.add.reduceat(count, first) if len(first) else count
        times, pair = np.diff(np.append(first, len(by))), pair[by[first]]  # distinct, by context and word
        own = np.flatnonzero(count)
        context, word, count = asked[pair[own] // len(words)], words[pair[own] % len(words)], count[own]
        known, start, kinds = np.unique(context, return_index=True, return_counts=True)
        sums = np.add.reduceat(count, start) if len(start) else np.empty(0, np.int64)
        tokens, totals, _ = shared.value
        if len(known) and len(tokens):  # a context dealt by successor has its count from elsewhere
            place = np.minimum(np.searchsorted(tokens, known), len(tokens) - 1)
            sums = np.where(tokens[place] == known, totals[place], sums)
        probability = (count - DISCOUNT) / np.repeat(sums, kinds)
        raw = Trie.build(context, word, probability)

        def ask(trie: Trie) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Each distinct context and bigram is looked up once, in the order of the levels."""
            codes = np.empty(len(by), np.uint8)
            codes[by] = np.repeat(trie.query(asked[pair // len(words)], words[pair % len(words)]), times)
            return trie.successors_of(asked).astype(np.uint32)[rank], codes, np.array(trie.values)

        has, codes, values = mapped(raw, ask)
        found, at, end = [], 0, 0
        for (shard, name, _), (h, _, follows, _) in zip(rows, loads):
            found.append((shard, name, c.squeezed([has[at : at + len(h)], codes[end : end + len(follows)], values])))
            at, end = at + len(h), end + len(follows)
        types = (pa.int32(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(types)], ["shard", "block", "load"])

    kinds = "shard int, block long, load binary"
    return packed.mapInArrow(ask, kinds).repartition(shards, "shard").mapInArrow(answer, kinds)


def scored(docs: DataFrame, training: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every text.

    ``training`` says which rows are learned from (null: not).  Words are runs of bytes that are
    not white space, A-Z lower-cased; each text ends with one more token.  A null or empty text is
    that end alone.  ``base_score`` is the add-one unigram model's log10 probability, ``score``
    the bigram model's.  Repeated rows each count and are each scored; null ids are kept; with
    nothing to learn from, all tokens are unknown; an empty table gives an empty one; other
    columns are not read.  Tokens are told apart by 64-bit hashes.
    """
    shards = c.shards_for(docs, SHARD)
    packed = c.stored(blocks(docs, F.coalesce(training, F.lit(False))), "blocks")
    unigrams = c.stored(counted(packed, shards), "unigrams")
    sums = unigrams.agg(F.sum("n_tokens"), F.sum("n_kinds")).first()
    n_tokens, n_kinds = sums[0] or 0, sums[1] or 0
    hot = frequent(unigrams, n_tokens, shards)
    bigrams = answered(packed, shards, hot)

    def by_block(df: DataFrame, name: str) -> DataFrame:
        pair = F.sort_array(F.collect_list(F.struct("shard", "load")))  # one entry per shard at most
        return df.where("block IS NOT NULL").groupBy("block").agg(pair.alias(name))

    shared = packed.sparkSession.sparkContext.broadcast(hot)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(batch.column(1)[i].as_py())
                counts = np.zeros(len(block.known), np.int64)
                shard = c.shard_of(block.known, shards)
                by = np.argsort(shard, kind="stable")
                got = {r["shard"]: r["load"] for r in batch.column(2)[i].as_py()}
                for s, part in c.cut(shard[by]):
                    counts[by[part]] = c.unsqueezed(got[s])[0]
                got = {r["shard"]: r["load"] for r in batch.column(3)[i].as_py()}
                successors, seen = np.zeros(len(block.known), np.int64), None
                for s, own, contexts, _ in block.dealt(shared.value, shards):
                    context, word, _, inverse = block.bigrams_
                    seen = np.zeros(len(context)) if seen is None else seen
                    has, codes, values = c.unsqueezed(got[s])
                    successors[contexts] += has
                    seen[own] = values[codes]
                unigram = (counts[:-1] + 1.0) / (n_tokens + 1.0 * (n_kinds + 1))
                back = np.divide(DISCOUNT * successors, counts, out=np.ones(len(counts)), where=counts > 0)
                whole = np.log10(seen + back[context] * unigram[word])[inverse]
                base = np.log10(unigram)[block.number]
                edges = block.ends - block.lengths - 1
                total = [np.add.reduceat(x, edges) for x in (whole, base, (counts[:-1][block.number] > 0).astype(np.int64))]
                figures = [block.lengths + 1, total[2], np.full(len(edges), n_tokens), total[1], total[0]]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i].values, *(pa.array(x, k) for x, k in zip(figures, kinds))],
                    ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    joined = packed.join(by_block(unigrams, "unigrams"), "block").join(by_block(bigrams, "bigrams"), "block")
    kinds = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return joined.select("ids", "load", "unigrams", "bigrams").mapInArrow(score, kinds)


@query("op3_lm_scoring")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    docs = c.table(spark, folder, "documents")

    def held(name: str) -> Column:
        return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % 7 == 2, F.lit(False))

    return scored(docs, ~held("doc_id")).select(
        "doc_id", held("doc_id").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
