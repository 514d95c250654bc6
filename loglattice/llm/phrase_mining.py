"""Phrase collocations from one FM-index per shard of documents.

A shard is a slice of documents.  Its words become ids, and an FM-index over the ids (with its
mirror, so that intervals extend on both sides) enumerates the n-grams of bounded length with their
counts.  Counts are summed across shards on Spark, where the phrases are scored.

The sum goes in rounds: words, pairs, then all longer n-grams.  After a round a shard is told which
of its entries are frequent in the whole corpus, and cuts its pieces at all others: no phrase holds
a part rarer than itself, so nothing is lost.  Entries and answers travel as packed arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loglattice.llm import common as c
from loglattice.llm.registry import query
from loglattice.operators.scale import small_side

LONGEST, LEAST, BEST = 5, 100, 2000
NO_LANG = "und"
BREAK, SPACE = 10, 32
_TABLE = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")
OWN = -1  # the row of a shard's own text, beside those it sends

# packed rows: from or for a shard; the counting task it goes to or comes from
SENT = "shard long, to int, load binary"


# the index


class WordIndex:
    """FM-index of a text of word ids (from 1; 0 is a break) for patterns of up to ``depth`` words.

    Suffixes are sorted by their first ``depth`` words only.  An interval of a pattern that long
    or shorter is the same as in a full suffix array, and so are its extensions.
    """

    def __init__(self, text: np.ndarray, depth: int) -> None:
        self.text, self.depth = text, depth
        self.order = self._sorted(text)

    def _sorted(self, text: np.ndarray) -> np.ndarray:
        """Starts of the suffixes by their first ``depth`` words; ranks of doubled length."""
        rank, known = text.astype(np.int64), 1
        while known < self.depth:
            more = min(known, self.depth - known)
            if more < known:  # the last words overlap, so that no rank beyond the depth counts
                more = self.depth - known
            after = np.zeros_like(rank)
            after[: len(rank) - more] = rank[more:]
            # ranks at distance ``more`` cover words more .. more + known, at most the depth
            pairs = rank * (int(rank.max(initial=0)) + 1) + after
            known += more
            if known == self.depth:
                return np.argsort(pairs, kind="stable")
            rank = np.unique(pairs, return_inverse=True)[1]
        return np.argsort(rank, kind="stable")

    @cached_property
    def forward(self) -> tuple[np.ndarray, np.ndarray]:
        """The word before each suffix (the transform), and where that longer suffix stands."""
        return self._steps(self.text, self.order)

    @cached_property
    def mirrored(self) -> tuple[np.ndarray, np.ndarray]:
        """The same for the reversed text: its words before are words after."""
        back = np.ascontiguousarray(self.text[::-1])
        return self._steps(back, self._sorted(back))

    @staticmethod
    def _steps(text: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        before = text[order - 1]  # the text ends with a break, so the first suffix has one before it
        place = np.empty(len(text), np.int64)
        place[np.argsort(before, kind="stable")] = np.arange(len(text))
        return before, place

    def single(self) -> Grams:
        """All words, with their intervals in both indexes, which are equal."""
        words, lengths = np.unique(self.text, return_counts=True)
        low = np.cumsum(lengths) - lengths
        real = words > 0
        return Grams(words[real, None], low[real], low[real], lengths[real])

    def extended(self, grams: Grams, left: bool = False) -> Grams:
        """Every n-gram one word longer, to the right or to the left, that occurs in a piece.

        The words beside an interval are counted; the first of each gives the new interval there,
        and the number of smaller ones gives it in the other index.
        """
        before, place = self.forward if left else self.mirrored
        near, far = (grams.low, grams.back) if left else (grams.back, grams.low)
        rows = c.runs(near, grams.count)
        owner = np.repeat(np.arange(len(near)), grams.count)
        wide = int(self.text.max(initial=0)) + 1
        keys, first, count = np.unique(owner * wide + before[rows], return_index=True, return_counts=True)
        owner, word = keys // wide, keys % wide
        smaller = np.cumsum(count) - count
        smaller -= smaller[np.searchsorted(owner, owner)]
        near, far = place[rows[first]], far[owner] + smaller
        real = word > 0
        old, new = grams.words[owner], word[:, None].astype(grams.words.dtype)
        words = np.hstack([new, old] if left else [old, new])[real]
        low, back = ((near, far) if left else (far, near))
        return Grams(words, low[real], back[real], count[real])

    def places(self, grams: Grams) -> tuple[np.ndarray, np.ndarray]:
        """Every start of every n-gram: the number of the n-gram, and the place in the text."""
        return np.repeat(np.arange(len(grams.low)), grams.count), self.order[c.runs(grams.low, grams.count)]


class Grams:
    """N-grams of one length: words (a row each), interval starts in both indexes, counts."""

    def __init__(self, words: np.ndarray, low: np.ndarray, back: np.ndarray, count: np.ndarray) -> None:
        self.words, self.low, self.back, self.count = words, low, back, count


# texts of shards


def tokens(langs: list[str], texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Per word of all texts: its language (index into ``langs``' distinct values), its piece, its
    index into the last result, the distinct words."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    raw = b"\n".join(parts).lower().translate(_TABLE)
    data = np.frombuffer(raw, np.uint8)
    gap = (data == SPACE) | (data == BREAK)
    edge = np.flatnonzero(np.diff(gap, prepend=True, append=True))
    starts, lengths = edge[::2], edge[1::2] - edge[::2]
    piece = np.cumsum(data == BREAK)[starts] if len(starts) else np.empty(0, np.int64)
    ends = np.cumsum([len(p) + 1 for p in parts])
    row = np.searchsorted(ends, starts, side="right")
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    small = pa.large_binary() if offsets[-1] >= 1 << 31 else pa.binary()
    kind = np.int64 if small == pa.large_binary() else np.int32
    flat = pa.Array.from_buffers(small, len(starts), [None, pa.py_buffer(offsets.astype(kind)), pa.py_buffer(data[~gap].tobytes())])
    coded = flat.dictionary_encode()
    _, lang = np.unique(np.array(langs, object), return_inverse=True) if langs else (None, np.empty(0, np.int64))
    return lang[row] if len(row) else row, piece, coded.indices.to_numpy(), coded.dictionary


def joined(words: np.ndarray, fits: np.ndarray, shortest: int) -> np.ndarray:
    """The runs of words whose links hold (``fits[i]``: word i goes with word i + 1), a break behind
    each and one in front; runs of under ``shortest`` words are left out."""
    first = np.flatnonzero(~np.concatenate([[False], fits[:-1]])) if len(words) else np.empty(0, np.int64)
    length = np.diff(np.append(first, len(words)))
    long = length >= shortest
    first, length = first[long], length[long]
    out = np.zeros(int(length.sum()) + len(length) + 1, words.dtype)
    at = c.runs(np.cumsum(length + 1) - length, length)
    out[at] = words[c.runs(first, length)]
    return out


def _rows(out: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([o[i] for o in out], k) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])


_SENT = [("shard", pa.int64()), ("to", pa.int32()), ("load", pa.binary())]


def _planes(numbers: np.ndarray) -> np.ndarray:
    """Numbers below 2**32 as four byte planes.  Ids are given by falling frequency, so the upper
    planes are nearly empty and each compresses by its own statistics."""
    return numbers.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.ravel()


def _numbers(planes: np.ndarray) -> np.ndarray:
    """The inverse of ``_planes``."""
    return np.ascontiguousarray(planes.reshape(4, -1).T).view(np.uint32).ravel()


def _dealt(h: np.ndarray, shards: int) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """The order that puts entries of one counting task together, and its slices."""
    to = c.shard_of(h, shards)
    by = np.argsort(to, kind="stable")
    return by, c.cut(to[by])


def words_sent(docs: DataFrame, shards: int) -> DataFrame:
    """Round one: each shard's text (words numbered by falling count, with the task each is counted
    by), its distinct words with their counts, and its word count per language."""

    def of(batch: pa.RecordBatch, number: int) -> list[tuple]:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        lang, piece, index, distinct = tokens(langs, texts)
        names = sorted(set(langs))
        out = [(None, None, None, names[i], int(k)) for i, k in enumerate(np.bincount(lang, minlength=len(names)))]
        size = max(len(distinct), 1)
        pairs = pa.array(lang.astype(np.int64) * size + index).dictionary_encode()
        pair, symbol = pairs.dictionary.to_numpy(), pairs.indices.to_numpy()
        count = np.bincount(symbol, minlength=len(pair))
        often = np.argsort(-count, kind="stable")  # numbered by falling count
        number_of = np.empty(len(pair), np.int64)
        number_of[often] = np.arange(len(pair))
        pair, count = pair[often], count[often]
        h = c.word_hashes(distinct.to_pylist(), len(distinct))[pair % size]
        seed = np.array([xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in names], np.uint64)
        h = c.mixed(h ^ seed[pair // size])
        last = np.append(np.diff(piece) != 0, True) if len(piece) else np.empty(0, bool)
        out.append((number, OWN, c.squeezed([_planes(number_of[symbol]), np.packbits(last), _planes(c.shard_of(h, shards))]), None, None))
        by, slices = _dealt(h, shards)
        label = np.frombuffer("\n".join(f"{len(x)} {x}" for x in names).encode("utf-8", "surrogatepass"), np.uint8)
        for to, part in slices:
            chosen = pair[by[part]]
            text = distinct.take(pa.array(chosen % size))
            body = np.frombuffer(b"".join(text.to_pylist()), np.uint8)
            arrays = [chosen // size, count[by[part]], pc.binary_length(text).to_numpy()]
            out.append((number, to, c.squeezed([*map(_planes, arrays), body, label]), None, None))
        return out

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [*_SENT, ("lang", pa.string()), ("n", pa.int64())]
        number = TaskContext.get().partitionId() << 32
        for batch in c.sliced(batches, 1):
            yield _rows(of(batch, number), kinds)
            number += 1

    base = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return base.mapInArrow(send, f"{SENT}, lang string, n long")


def _labels(raw: bytes) -> list[str]:
    """Language names, each behind its length."""
    text, out = raw.decode("utf-8", "surrogatepass"), []
    while text:
        size, text = text.split(" ", 1)
        out.append(text[: int(size)])
        text = text[int(size) + 1 :]
    return out


def _totals(entry: np.ndarray, count: np.ndarray, kinds: int) -> np.ndarray:
    total = np.zeros(kinds, np.int64)
    np.add.at(total, entry, count)
    return total


def words_counted(sent: DataFrame, shards: int, least: int) -> DataFrame:
    """Sums per word.  Frequent ones get an id that no other has; every shard is told the ids of
    the words it sent, 0 for the rare."""

    def count(table: pa.Table) -> pa.Table:
        to = table.column("to")[0].as_py()
        loads = [c.unsqueezed(x.as_py()) for x in table.column("load")]
        names: dict[str, int] = {}
        lang, words = [], []
        for label, _, size, body, text in ([*map(_numbers, x[:3]), *x[3:]] for x in loads):
            known = np.array([names.setdefault(x, len(names)) for x in _labels(text.tobytes())], np.int64)
            lang.append(known[label])
            ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
            raw = body.tobytes()
            words.append(pa.array([raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary()))
        coded = pa.concat_arrays(words).dictionary_encode()
        pairs = pa.array(coded.indices.to_numpy().astype(np.int64) * len(names) + np.concatenate(lang)).dictionary_encode()
        entry, pair = pairs.indices.to_numpy(), pairs.dictionary.to_numpy()
        total = _totals(entry, np.concatenate([_numbers(x[1]) for x in loads]), len(pair))
        often = np.flatnonzero(total >= least)
        often = often[np.argsort(-total[often], kind="stable")]
        given = np.zeros(len(pair), np.int64)
        given[often] = (np.arange(len(often)) * shards + to) + 1
        if len(often) and given.max() >= 1 << 32:
            raise OverflowError("more than 2**32 frequent words")
        named = list(names)
        out, at = [], 0
        for number, load in zip(table.column("shard").to_pylist(), loads):
            size = len(load[0]) // 4
            out.append((number, to, c.squeezed([_planes(given[entry[at : at + size]])]), None, None, None, None))
            at += size
        for i in often.tolist():
            word = coded.dictionary[int(pair[i]) // len(names)].as_py().decode("utf-8", "surrogatepass")
            out.append((None, None, None, named[int(pair[i]) % len(names)], word, int(given[i]), int(total[i])))
        kinds = [*_SENT, ("lang", pa.string()), ("word", pa.string()), ("id", pa.int64()), ("a", pa.int64())]
        return pa.Table.from_batches([_rows(out, kinds)])

    return sent.where(F.col("to") >= 0).groupBy("to").applyInArrow(count, f"{SENT}, lang string, word string, id long, a long")


def _answers(table: pa.Table) -> list[list[np.ndarray]]:
    """What the counting tasks said, in the order in which the entries were sent."""
    rows = sorted(zip(table.column("to").to_pylist(), (x.as_py() for x in table.column("load"))))
    return [c.unsqueezed(load) for _, load in rows]


def _hash(words: np.ndarray) -> np.ndarray:
    h = np.zeros(len(words), np.uint64)
    for column in range(words.shape[1]):
        h = c.mixed(h * c.MULTIPLIER + words[:, column].astype(np.uint64))
    return h


def _index(text: np.ndarray, depth: int) -> tuple[np.ndarray, WordIndex]:
    """The words of a text, in order, and the index over their numbers."""
    names, local = np.unique(text, return_inverse=True)
    return names, WordIndex(local.astype(np.int64), depth)


def _entries(number: int, text: np.ndarray, lengths: range, shards: int) -> list[tuple]:
    """The n-grams of the given lengths in one shard, packed per counting task."""
    names, index = _index(text, lengths[-1])
    grams, loads = index.single(), {}
    for size in range(2, lengths[-1] + 1):
        grams = index.extended(grams)
        if size in lengths:
            words = names[grams.words]
            by, slices = _dealt(_hash(words), shards)
            for to, part in slices:
                columns = words[by[part]]
                columns[1:, 0] -= columns[:-1, 0].copy()  # in order, so differences are small
                loads.setdefault(to, {})[size] = [*map(_planes, columns.T), _planes(grams.count[by[part]])]
    none = lambda size: [np.empty(0, np.uint8)] * (size + 1)
    packed = lambda by_size: c.squeezed([x for size in lengths for x in by_size.get(size, none(size))])
    return [(number, to, packed(by_size)) for to, by_size in sorted(loads.items())]


def _pair_at(text: np.ndarray, shards: int) -> np.ndarray:
    """For every place of a text, where the pair that starts there stands among the pairs that
    ``_entries`` sends; -1 for none."""
    names, index = _index(text, 2)
    grams = index.extended(index.single())
    by, _ = _dealt(_hash(names[grams.words]), shards)
    sent_as = np.empty(len(by), np.int64)
    sent_as[by] = np.arange(len(by))
    out = np.full(len(text), -1, np.int64)
    which, place = index.places(grams)
    out[place] = sent_as[which]
    return out


def pairs_sent(sent: DataFrame, counted: DataFrame, shards: int) -> DataFrame:
    """Round two: pieces are cut at rare words, and the pairs in them are sent."""

    def step(texts: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for number, load in zip(texts.column("shard").to_pylist(), texts.column("load")):
            symbol, last, to = c.unsqueezed(load.as_py())
            told = np.concatenate([_numbers(x[0]) for x in _answers(answers)] or [np.empty(0, np.uint32)])
            ids = np.empty_like(told)
            ids[np.argsort(_numbers(to), kind="stable")] = told
            words = ids[_numbers(symbol)]
            linked = (words > 0) & ~np.unpackbits(last)[: len(words)].astype(bool)
            linked[:-1] &= words[1:] > 0
            text = joined(words, linked, 2)
            out.append((number, OWN, c.squeezed([_planes(text)])))
            out += _entries(number, text, range(2, 3), shards)
        return pa.Table.from_batches([_rows(out, _SENT)])

    return _paired(sent, counted, step)


def longer_sent(sent: DataFrame, counted: DataFrame, shards: int, longest: int) -> DataFrame:
    """Round three: pieces are cut between words whose pair is rare; all longer n-grams are sent."""

    def step(texts: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for number, load in zip(texts.column("shard").to_pylist(), texts.column("load")):
            text = _numbers(c.unsqueezed(load.as_py())[0])
            bits = [np.unpackbits(x[0])[: int(x[1][0])] for x in _answers(answers)]
            often = np.concatenate([*bits, [0]]).astype(bool)  # -1, no pair: the last
            text = joined(text, often[_pair_at(text, shards)], 3)
            out += _entries(number, text, range(3, longest + 1), shards)
        return pa.Table.from_batches([_rows(out, _SENT)])

    return _paired(sent, counted, step)


def _paired(sent: DataFrame, counted: DataFrame, step) -> DataFrame:
    own = sent.where(F.col("to") == OWN).select("shard", "load")
    said = counted.where(F.col("shard").isNotNull()).select("shard", "to", "load")
    return own.groupBy("shard").cogroup(said.groupBy("shard")).applyInArrow(step, SENT)


def grams_counted(sent: DataFrame, lengths: range, least: int) -> DataFrame:
    """Sums per n-gram, told apart word by word: the frequent ones as rows (words, a), and a bit
    per entry for the shard that sent it (of the first length alone, the only one asked for)."""

    def count(table: pa.Table) -> pa.Table:
        to = table.column("to")[0].as_py()
        loads = [c.unsqueezed(x.as_py()) for x in table.column("load")]
        out, base = [], 0
        for size in lengths:
            read = [[_numbers(x) for x in load[base : base + size + 1]] for load in loads]
            lengths_sent = [len(x[0]) for x in read]
            columns = [np.concatenate([np.cumsum(x[0], dtype=np.int64) for x in read])]
            columns += [np.concatenate([x[k] for x in read]).astype(np.int64) for k in range(1, size)]
            count = np.concatenate([x[size] for x in read])
            entry = columns[0]
            for column in columns[1:]:
                _, first, entry = np.unique(entry << 32 | column, return_index=True, return_inverse=True)
            total = _totals(entry, count, len(first))
            often = total >= least
            found = np.stack([column[first[often]] for column in columns], 1)
            out += [(None, None, None, w, a) for w, a in zip(found.tolist(), total[often].tolist())]
            if base == 0:
                at = 0
                for number, length in zip(table.column("shard").to_pylist(), lengths_sent):
                    here = often[entry[at : at + length]]
                    out.append((number, to, c.squeezed([np.packbits(here), np.array([length])]), None, None))
                    at += length
            base += size + 1
        return pa.Table.from_batches([_rows(out, [*_SENT, ("words", pa.list_(pa.int64())), ("a", pa.int64())])])

    return sent.where(F.col("to") >= 0).groupBy("to").applyInArrow(count, f"{SENT}, words array<long>, a long")


# phrases


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The words per language (lang, n); the frequent words (id, lang, word, a); the frequent
    n-grams of 2 to ``longest`` words (words: their ids, a)."""
    shards = c.shards_for(docs.select("lang", "text"))
    sent = c.stored(words_sent(docs, shards), "phrase-words")
    n = sent.where(F.col("n").isNotNull()).groupBy("lang").agg(F.sum("n").alias("n"))
    counted = c.stored(words_counted(sent, shards, least), "phrase-vocabulary")
    vocabulary = counted.where(F.col("id").isNotNull()).select("id", "lang", "word", "a")
    sent = c.stored(pairs_sent(sent, counted, shards), "phrase-pairs")
    counted = c.stored(grams_counted(sent, range(2, 3), least), "phrase-pair-counts")
    grams = counted.where(F.col("words").isNotNull()).select("words", "a")
    if longest > 2:
        longer = longer_sent(sent, counted, shards, longest)
        more = c.stored(grams_counted(longer, range(3, longest + 1), least), "phrase-counts")
        grams = grams.unionByName(more.where(F.col("words").isNotNull()).select("words", "a"))
    return n, vocabulary, grams


def _merged(df: DataFrame) -> DataFrame:
    """``df`` for a join by sorting.  Words and n-grams grow with the corpus, but lie in files a
    fraction of their size, from which the planner would take them to fit in a broadcast."""
    return df.hint("merge")


def candidates(grams: DataFrame) -> DataFrame:
    """``grams`` with the largest count of any extension by a word to the left and to the right;
    null where no extension is frequent."""
    k = F.size("words")
    parents = F.array(
        F.struct(F.slice("words", 2, k - 1).alias("words"), F.col("a").alias("left")  , F.lit(None).cast("long").alias("right")),
        F.struct(F.slice("words", 1, k - 1).alias("words"), F.lit(None).cast("long").alias("left"), F.col("a").alias("right")),
    )
    beyond = grams.where(k > 2).select(F.explode(parents).alias("p")).groupBy("p.words").agg(F.max("p.left").alias("left"), F.max("p.right").alias("right"))
    return grams.join(_merged(beyond), "words", "left")


def _number(column: str) -> str:
    return f"CAST({column} AS DECIMAL(17, 0))"


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, best: int = BEST) -> DataFrame:
    """Per language its ``best`` phrases: lang, rank, phrase, a, l, r, n, score, left, right.

    Words, pieces, candidates and the score are those of the module's contract: the score of a cut
    is floor(1000 * a * n / (l * r)) in exact decimals, and the lowest-scoring cut counts, ties to
    the shorter first part.  A phrase that some longer candidate holds as often as it occurs is
    dropped: then one of its extensions by one word occurs as often, as counts only fall with
    length, so the extensions decide.

    A null lang is ``und``, a null or empty text has no words, repeated rows count again, an empty
    table gives an empty one, other columns are not read.
    """
    n, vocabulary, grams = phrase_counts(docs, longest, least)
    whole = candidates(grams).where(F.greatest(F.coalesce("left", F.lit(0)), F.coalesce("right", F.lit(0))) < F.col("a"))
    whole = c.stored(whole, "phrase-candidates")
    spelled = (
        whole.select("words", F.posexplode("words").alias("pos", "id")).join(_merged(vocabulary.select("id", "lang", "word")), "id")
        .groupBy("words").agg(F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("_text"))
        .select("words", "lang", F.array_join(F.col("_text.word"), " ").alias("phrase"))
    )
    size = F.size("words")
    counts = grams.unionByName(vocabulary.select(F.array("id").alias("words"), "a"))
    cuts = whole.select("words", "a", "left", "right", F.explode(F.sequence(F.lit(1), size - 1)).alias("cut"))
    scored = (
        cuts.withColumns({"_first": F.slice("words", F.lit(1), F.col("cut")), "_rest": F.slice("words", F.col("cut") + 1, size - F.col("cut"))})
        .join(_merged(counts.select(F.col("words").alias("_first"), F.col("a").alias("l"))), "_first")
        .join(_merged(counts.select(F.col("words").alias("_rest"), F.col("a").alias("r"))), "_rest")
        .join(_merged(spelled), "words").join(small_side(n), "lang")
        .withColumn("score", F.expr(f"CAST(1000 AS DECIMAL(4, 0)) * {_number('a')} * {_number('n')} DIV ({_number('l')} * {_number('r')})"))
        .groupBy("lang", "phrase", "a", "left", "right", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("_cut"))
        .select("lang", "phrase", "a", "left", "right", "n", "_cut.score", "_cut.l", "_cut.r")
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= best)


_LONGER = " UNION ALL ".join(
    f"SELECT lang, list_slice(w, i, i + {k - 1}) AS w FROM (SELECT lang, w, unnest(range(1, len(w) - {k - 2})) AS i FROM pieces WHERE len(w) >= {k})"
    for k in range(1, LONGEST + 1)
)
SQL = rf"""
WITH pieces AS MATERIALIZED (
  SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, '{NO_LANG}') AS lang,
               unnest(string_split_regex(translate(coalesce(text, ''), '{c.A_Z}', '{c.a_z}'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents)
),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
f AS MATERIALIZED (SELECT lang, w, count(*) AS a FROM ({_LONGER}) GROUP BY lang, w HAVING count(*) >= {LEAST}),
held AS (
  SELECT DISTINCT p.lang, p.w FROM f p JOIN f q ON p.lang = q.lang AND q.a >= p.a
  JOIN (SELECT unnest(range(2, {LONGEST + 1})) AS k) s ON len(q.w) >= s.k + 1 AND len(p.w) = s.k
  WHERE list_contains(list_transform(range(1, len(q.w) - len(p.w) + 2), lambda i: list_slice(q.w, i, i + len(p.w) - 1)), p.w)
),
cuts AS (
  SELECT lang, w, a, unnest(range(1, len(w))) AS k FROM f
  WHERE len(w) >= 2 AND NOT EXISTS (SELECT 1 FROM held WHERE held.lang = f.lang AND held.w = f.w)
),
scores AS (
  SELECT cuts.lang, cuts.w, cuts.a, k, l.a AS l, r.a AS r, n, ((1000::HUGEINT * cuts.a * n) // (l.a::HUGEINT * r.a))::BIGINT AS score
  FROM cuts JOIN totals USING (lang)
  JOIN f l ON l.lang = cuts.lang AND l.w = list_slice(cuts.w, 1, k)
  JOIN f r ON r.lang = cuts.lang AND r.w = list_slice(cuts.w, k + 1, len(cuts.w))
),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(w, ' ')) AS rank,
       array_to_string(w, ' ') AS phrase, a, l, r, n, score
FROM lowest QUALIFY rank <= {BEST}
"""


@query("op12_phrase_collocation_mining", SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    found = collocations(c.table(spark, folder, "documents").select("lang", "text"))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
