"""Exact Jaccard join of word n-gram sets by PartEnum signatures.

Sets are dealt to size bands a factor of the threshold wide, so that linked sets lie in one band
or in two neighbours.  In a band, linked sets differ in at most k features.  The feature domain is
cut into n > k partitions; a set's projections on them are its signatures, and linked sets agree
in at least n - k.  Of the n one-partition subsets so enumerated, k + 1 suffice: under any fixed
order of signatures, the first k + 1 of two such sets share one (the prefix rule).  The order puts
projections first whose rarest feature is rare in the whole corpus, so that empty ones and those of
passages that many documents share are sent last, mostly never.  Any order keeps the join exact;
the frequencies that make this one are counted over all documents in a table of fixed size.

Sets that share a signature are candidates.  Each is compared with its bucket's most typical set
(the one with the commonest features, as an original has among edited copies of it); only where
that leaves the sets of one such typical set in several components are those of different ones
compared (all that met it in any bucket: more than the buckets ask for, and each pair once).  These meet
as parity sketches first: a bit per hashed feature, flipped by each, so that two sketches differ in
at most as many bits as the sets in features, and no linked pair is lost.  Equal sets are one node
throughout.  What is left is decided on the whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.llm import common as c
from loglattice.llm.registry import query

SHINGLE = 5
PERCENT = 75
SLACK = 2.0  # partitions per signature that is sent
COUNTER_BITS = 21  # the frequency table has 2**21 counters, 8 MB: what is broadcast has this size at any scale
CHUNKS = 64
SET, PAIR = 0, 1
SENT = "shard int, kind int, x long, y long, load binary"
FOUND = "kind int, x long, y long, n long, text_hash long, sketch binary"
BLOCK = 2048  # members of a bucket that meet in one task


def shingle_set(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``n`` lower-cased words; of all words if fewer."""
    items = c.words(text, lower=True)
    if not items:
        return np.empty(0, np.uint64)
    return np.unique(c.window_hashes(c.word_hashes(items, len(items)), min(n, len(items))))


def set_name(features: np.ndarray) -> int:
    """A 64-bit name of a set of features (signed, as Spark keeps it)."""
    return int(c.mixed(np.array([features.sum(dtype=np.uint64) + np.uint64(len(features))], np.uint64)).view(np.int64)[0])


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def band_of(size: int, percent: int) -> tuple[int, int, int]:
    """Number of the size band, its largest size, and the largest size of the next."""
    number, low = 0, 1
    while (high := low * 100 // percent) < size:
        number, low = number + 1, high + 1
    return number, high, (high + 1) * 100 // percent


def frequencies(docs: DataFrame, n: int) -> np.ndarray:
    """How many sets have a feature, counted by the leading bits of its hash (copies within a
    batch count once).  Tasks add up their own table, chunks of which are summed across tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << COUNTER_BITS, np.int64)
        for batch in c.sliced(batches, 0):
            names, found = set(), []
            for text in batch.column(0):
                features = shingle_set(text.as_py(), n)
                if len(features) and (name := set_name(features)) not in names:
                    names.add(name)
                    found.append((features >> np.uint64(64 - COUNTER_BITS)).astype(np.int64))
            if found:
                table += np.bincount(np.concatenate(found), minlength=len(table))
        loads = [c.squeezed([part]) for part in np.split(table, CHUNKS) if part.any()]
        chunks = [i for i, part in enumerate(np.split(table, CHUNKS)) if part.any()]
        yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int32()), pa.array(loads, pa.binary())], ["chunk", "load"])

    def add(group: pa.Table) -> pa.Table:
        total = np.sum([c.unsqueezed(v)[0] for v in group.column("load").to_pylist()], axis=0, dtype=np.int64)
        return pa.table({"chunk": group.column("chunk")[:1], "load": [c.squeezed([np.minimum(total, 2**32 - 2).astype(np.uint32)])]})

    kinds = "chunk int, load binary"
    counted = docs.select(F.col("text").cast("string")).mapInArrow(count, kinds).groupBy("chunk").applyInArrow(add, kinds)
    out = np.zeros((CHUNKS, (1 << COUNTER_BITS) // CHUNKS), np.uint32)
    for row in counted.collect():
        out[row["chunk"]] = c.unsqueezed(row["load"])[0]
    return out.ravel()


def signatures(features: np.ndarray, seen: np.ndarray, band: int, largest: int, percent: int) -> np.ndarray:
    """The k + 1 first signatures of a set among the sets of up to ``largest`` features; ``seen``
    has the frequency of each feature."""
    # both * 100 >= percent * union, for sets of a and b features, allows this many to differ
    k = 2 * largest * (100 - percent) // (100 + percent)
    parts = int(SLACK * (k + 1)) if k else 1
    owner = c.shard_of(features, parts)  # grows with the feature, so parts are slices
    edges = np.searchsorted(owner, np.arange(parts + 1))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(c.mixed(features ^ c.MULTIPLIER), dtype=np.uint64)])
    place = np.arange(parts, dtype=np.uint64) + np.uint64(band << 32)
    content = c.mixed(total[edges[1:]] - total[edges[:-1]] + c.mixed(place))
    if parts <= k + 1:
        return content
    # by the rarest feature, then by hash: the order is a function of the signature alone
    rarest = np.full(parts, 2**32 - 1, np.uint64)
    full = edges[:-1] < edges[1:]
    rarest[full] = np.minimum.reduceat(seen, edges[:-1][full])
    rank = (rarest << np.uint64(32)) | (content >> np.uint64(32))
    chosen = np.argpartition(rank, k)[: k + 1]
    if (rank == rank[chosen].max()).sum() > 1:  # a tie at the border is settled by the whole hash
        chosen = np.lexsort((content, rank))[: k + 1]
    return content[chosen]


def typicality(seen: np.ndarray) -> int:
    """Mean logarithm of the features' frequencies, as a 16-bit number."""
    return int(2000 * np.log2(1.0 + seen).mean())


def sketch(features: np.ndarray) -> bytes:
    """Parity sketch of two to four bits per feature (a power of two, 64 at least)."""
    bits = 1 << max(6, int(2 * len(features) - 1).bit_length())
    counts = np.bincount((features & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(raw: bytes, size: int) -> np.ndarray:
    """A sketch cut to ``size`` bytes: as features are placed by their last bits, halves add up."""
    return np.bitwise_xor.reduce(np.frombuffer(raw, np.uint64).reshape(-1, size // 8), axis=0)


def keyed(docs: DataFrame) -> DataFrame:
    """What is read of a row: id, text, and the hash of the text, which together name the row."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def sent(docs: DataFrame, shards: int, n: int, percent: int) -> DataFrame:
    """A row per document with the name and size of its set, and per batch and shard the packed
    signatures of the batch's distinct sets."""
    shared = docs.sparkSession.sparkContext.broadcast(frequencies(docs, n))  # of fixed size

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        for batch in c.sliced(batches, 1, 4 << 20):
            names, own, out, typical = set(), [], [], {}
            hashes = batch.column(2).to_pylist()
            for row, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                features = shingle_set(text.as_py(), n)
                name = set_name(features) if len(features) else None
                load = len(features).to_bytes(8, "little") + hashes[row].to_bytes(8, "little", signed=True)
                load += sketch(features) if len(features) else b""
                out.append(((hashes[row] + row) % shards, SET, doc, name, load))  # any shard will do
                if name is None or name in names:
                    continue
                names.add(name)
                seen = shared.value[(features >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]
                typical[name] = typicality(seen)
                band, here, there = band_of(len(features), percent)
                for number, largest in ((band, here), (band + 1, there)):
                    found = signatures(features, seen, number, largest, percent)
                    own.append((found, np.full(len(found), name, np.int64)))
            if own:
                sig, name = (np.concatenate([o[i] for o in own]) for i in (0, 1))
                by = np.argsort(shard := c.shard_of(sig, shards), kind="stable")
                sig, name = sig[by], name[by]
                for s, part in c.cut(shard[by]):
                    run = np.flatnonzero(np.concatenate([[True], np.diff(name[part]) != 0]))
                    counts = np.diff(np.append(run, part.stop - part.start)).astype(np.uint16 if part.stop - part.start < 65536 else np.int32)
                    low = sig[part].view(np.uint8).reshape(-1, 8)[:, :6].ravel()  # the rest picks the shard, nearly
                    head = name[part][run]
                    rank = np.array([typical[x] for x in head.tolist()], np.uint16)
                    out.append((s, PAIR, None, None, c.squeezed([head, rank, counts, low])))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], SENT.replace(" int", "").replace(" long", "").replace(" binary", "").split(", "))

    return keyed(docs).mapInArrow(send, SENT)


def buckets(entries: DataFrame) -> DataFrame:
    """From each shard: its documents' sets, and the pairs of each bucket's most typical set (x) with
    the bucket's others (y)."""

    def rows(x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(x), 1 << 16):
            own = slice(a, a + (1 << 16))
            columns = [np.full(len(x[own]), PAIR, np.int32), x[own], y[own], np.zeros(len(x[own]), np.int64)]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(v) for v in [*columns, columns[-1]]), pa.nulls(len(x[own]), pa.binary())],
                ["kind", "x", "y", "n", "text_hash", "sketch"],
            )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, owners, ranks = [], [], []
        for batch in batches:
            kinds, loads, sets = batch.column(1).to_pylist(), batch.column(4), []
            for i, kind in enumerate(kinds):
                if kind == SET:
                    sets.append(i)
                    continue
                name, rank, counts, low = c.unsqueezed(loads[i].as_py())
                wide = np.zeros((len(low) // 6, 8), np.uint8)
                wide[:, :6] = low.reshape(-1, 6)
                sigs.append(wide.view(np.uint64).ravel())
                owners.append(np.repeat(name, counts))
                ranks.append(np.repeat(rank, counts))
            if sets:
                own = batch.take(pa.array(sets))
                raw = own.column(4).to_pylist()
                sizes = pa.array([int.from_bytes(v[:8], "little") for v in raw], pa.int64())
                hashes = pa.array([int.from_bytes(v[8:16], "little", signed=True) for v in raw], pa.int64())
                sketches = pa.array([v[16:] for v in raw], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [own.column(1), own.column(2), own.column(3), sizes, hashes, sketches],
                    ["kind", "x", "y", "n", "text_hash", "sketch"],
                )
        if not sigs:
            return
        sig, owner, rank = np.concatenate(sigs), np.concatenate(owners), np.concatenate(ranks)
        sigs, owners, ranks = [], [], []
        by = np.argsort(sig, kind="stable")
        sig = sig[by]
        same = np.concatenate([[False], sig[1:] == sig[:-1]])
        by = by[shared := same | np.append(same[1:], False)]  # buckets of one set are done with
        sig, owner, rank = sig[shared], owner[by], rank[by]
        by = np.lexsort((owner, np.uint16(65535) - rank, sig))
        sig, owner = sig[by], owner[by]
        keep = np.concatenate([[True], (sig[1:] != sig[:-1]) | (owner[1:] != owner[:-1])])[: len(sig)]
        sig, owner = sig[keep], owner[keep]
        if not len(sig):
            return
        start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        length = np.diff(np.append(start, len(sig)))
        pivot = np.repeat(owner[start], length)
        far = owner != pivot
        pairs = np.unique(np.stack([pivot[far], owner[far]], 1), axis=0) if far.any() else np.empty((0, 2), np.int64)
        yield from rows(pairs[:, 0], pairs[:, 1])

    return entries.mapInArrow(meet, FOUND)


def checked(pairs: DataFrame, sets: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs of set names that link, decided on whole texts; one text per set is read: that of
    one row, which its id and the hash of its text name."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct()
    row = F.min(F.struct("doc_id", "text_hash")).alias("row")
    chosen = wanted.join(sets.where("name IS NOT NULL").groupBy("name").agg(row), "name")
    chosen = chosen.select("name", F.col("row.doc_id").alias("_id"), F.col("row.text_hash").alias("_hash"))
    same = (F.col("text_hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    texts = keyed(docs).join(chosen, same).groupBy("name").agg(F.first("text").alias("text"))  # a row may be repeated
    left = texts.select(F.col("name").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("name").alias("b"), F.col("text").alias("text_b"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}

        def features(name: int, text: str) -> np.ndarray:
            if name not in known:
                if len(known) > 2000:
                    known.clear()
                known[name] = shingle_set(text, n)
            return known[name]

        for batch in batches:
            good = []
            for i, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                x, y = features(a, batch.column(2)[i].as_py()), features(b, batch.column(3)[i].as_py())
                if linked(x, y, percent):
                    good.append(i)
            yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))

    met = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return met.mapInArrow(check, "a long, b long").distinct()


def near(members: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of one list, of different roots, that size and sketch let link.  A list
    longer than ``BLOCK`` is compared block by block, so no task holds more than two blocks."""
    blocks = members.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    i = F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int")
    placed = members.join(blocks, "list").join(sketches, "name").withColumn("own", i)
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))

    def compare(group: pa.Table) -> pa.Table:
        name, root, size, own = (group.column(x).to_numpy() for x in ("name", "root", "n", "own"))
        raw = group.column("sketch").to_pylist()
        width = min(map(len, raw))
        bits = np.array([folded(v, width) for v in raw])
        found = []
        for at in range(0, len(name), 64):
            part = slice(at, at + 64)
            most = (size[part, None] + size[None, :]) * (100 - percent) // (100 + percent)
            good = (root[part, None] != root[None, :]) & (name[part, None] < name[None, :])
            if group.column("i")[0] != group.column("j")[0]:
                good &= own[part, None] != own[None, :]  # pairs of one block meet elsewhere
            good &= np.abs(size[part, None] - size[None, :]) <= most
            x, y = np.nonzero(good)
            for a in range(0, len(x), 1 << 16):
                p, q = x[a : a + (1 << 16)] + at, y[a : a + (1 << 16)]
                apart = np.bitwise_count(bits[p] ^ bits[q]).sum(axis=1)
                fits = apart <= (size[p] + size[q]) * (100 - percent) // (100 + percent)
                found.append(np.stack([name[p[fits]], name[q[fits]]], 1))
        out = np.concatenate(found) if found else np.empty((0, 2), np.int64)
        return pa.table({"a": out[:, 0], "b": out[:, 1]})

    return placed.groupBy("list", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(name, root) for every end of a link.  Each round hooks every node to its smallest
    neighbour and contracts the links, until none is left."""
    edges = c.stored(links.select("a", "b").where("a <> b").distinct(), "links")
    roots = edges.select(F.explode(F.array("a", "b")).alias("name")).distinct().withColumn("root", F.col("name"))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        hooks = both.groupBy("a").agg(F.min("b").alias("to")).where("to < a")
        hooks = c.stored(hooks, "hooks")
        jump = hooks.select(F.col("a").alias("to"), F.col("to").alias("next"))
        hooks = c.stored(hooks.join(jump, "to", "left").select("a", F.coalesce("next", "to").alias("to")), "hooks")
        own = hooks.select(F.col("a").alias("root"), "to")
        roots = c.stored(roots.join(own, "root", "left").select("name", F.coalesce("to", "root").alias("root")), "roots")
        x, y = (hooks.select(F.col("a").alias(e), F.col("to").alias(f"to_{e}")) for e in ("a", "b"))
        moved = edges.join(x, "a", "left").join(y, "b", "left")
        moved = moved.select(F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b")).where("a <> b")
        edges = c.stored(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    return roots


def linked_rows(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, n_shingles, root (of its group of links; null
    without words), component_id (the smallest doc_id of the group; null if it has none)."""
    shards = c.shards_for(docs, 4 << 20)
    found = c.stored(buckets(sent(docs, shards, n, percent).repartition(shards, "shard")), "buckets")
    sets = found.where(F.col("kind") == SET).select(F.col("x").alias("doc_id"), F.col("y").alias("name"), "n", "text_hash", "sketch")
    pairs = found.where(F.col("kind") == PAIR).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    first = c.stored(checked(pairs, sets, docs, n, percent), "links")
    roots = components(first)

    met = found.where(F.col("kind") == PAIR).select(F.col("x").alias("list"), F.col("y").alias("name"))
    members = met.union(met.select("list", F.col("list").alias("name"))).distinct()
    members = members.join(roots, "name", "left").select("list", "name", F.coalesce("root", "name").alias("root"))
    members = c.stored(members, "members")
    split = members.groupBy("list", "root").count().groupBy("list").agg(F.count("*").alias("parts")).where("parts > 1")
    apart = c.stored(members.join(split.select("list"), "list", "left_semi"), "apart")
    sketches = sets.where("name IS NOT NULL").join(apart.select("name").distinct(), "name", "left_semi")
    sketches = sketches.groupBy("name").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))  # all the same
    more = near(apart, sketches, percent)
    more = more.join(pairs, ["a", "b"], "left_anti")  # those were compared in the first round
    second = c.stored(checked(c.stored(more, "more"), sets, docs, n, percent), "links")
    if not second.isEmpty():
        roots = components(first.union(second))

    placed = sets.join(roots, "name", "left").select("doc_id", "text_hash", "n", F.coalesce("root", "name").alias("root"))
    placed = c.stored(placed, "placed")
    smallest = placed.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return placed.join(smallest, "root", "left").select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"), "root",
        F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def grouped(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Two sets link when 100 * intersection >= percent * union; component_id is the smallest doc_id
    that links reach.  A text without words (or null) has no shingles, links with nothing and is
    its own component; one with fewer than ``n`` words has one shingle, all its words.  Rows that
    repeat an id are rows of the same document: its smallest component is given to all of them.
    A row without an id links like any other and gets its group's component, which is null only
    where no row of the group has an id.  An empty table gives an empty one; other columns are
    not read.
    """
    rows = c.stored(linked_rows(docs, n, percent), "linked")
    shared = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component_id").alias("_least"))
    return rows.join(shared, "doc_id", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.coalesce("_least", "component_id")).alias("component_id"),
    )


def representatives(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of every group of links: that with the smallest id (a row without an
    id comes last), then the smallest hash of its text.  Rows without words all stay."""
    rows = c.stored(linked_rows(docs, n, percent), "linked")
    first = rows.where("root IS NOT NULL").groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("row")
    )
    first = first.select(F.col("row.doc_id").alias("_id"), F.col("row.text_hash").alias("_hash"))
    text = F.col("text").cast("string")
    named = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_own"), F.xxhash64(text).alias("_text"))
    kept = named.join(first, (F.col("_text") == F.col("_hash")) & F.col("_own").eqNullSafe(F.col("_id")), "left_semi")
    kept = kept.dropDuplicates(["_own", "_text"])
    wordless = rows.where("root IS NULL").select(F.col("text_hash").alias("_hash")).distinct()  # texts of white space
    alone = named.join(wordless, F.col("_text") == F.col("_hash"), "left_semi")
    return kept.unionByName(alone).select("row.*")


@query("op5_ngram_jaccard_join")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return grouped(c.table(spark, folder, "documents"))
