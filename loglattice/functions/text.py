"""Row-local text preparation: words, windows, tokens, ids, vectors, budgets.

All but ``run_hashes`` and ``runs_among`` is built-in expressions, so a document never leaves its row or the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Whitespace as Unicode-aware splitting sees it, the search-token
# pattern, and the URL namespace of name-based UUIDs.
WS = r"[\s\x1c-\x1f]"  # under (?U)
TOKEN = r"[A-Za-z0-9_./:-]+"
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
SPAN, FOUND = 1 << 18, 1 << 16  # characters hashed at once, runs found that travel at once


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it anywhere in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"(?U)^{WS}+|{WS}+$", "")


def not_blank(text: Column) -> Column:
    """True when any character is not whitespace; stops at the first one."""
    return text.rlike(r"(?U)[^\s\x1c-\x1f]")


def split_words(text: Column) -> Column:
    """Whitespace-separated words; a blank text has none."""
    return F.filter(F.split(text, f"(?U){WS}+"), lambda w: w != "")


def word_windows(text: Column, size: int | Column, overlap: int | Column = 0) -> Column:
    """Windows of ``size`` words; the first window reaching the end is the last."""
    width = size if isinstance(size, Column) else F.lit(size)
    step = F.greatest(F.lit(1), width - overlap)

    def windows(tokens: Column) -> Column:
        total = F.size(tokens)
        extra = F.greatest(F.lit(0), F.ceil((total - width) / step)).cast("int")
        cut = F.transform(
            F.sequence(F.lit(0), extra),
            lambda i: F.array_join(F.slice(tokens, i * step + 1, width), " "),
        )
        return F.when(total > 0, cut).otherwise(F.array().cast("array<string>"))

    return let(split_words(text), windows)


def paragraphs(text: Column) -> Column:
    """Blank-line separated parts, trimmed, empties dropped; the whole text if none is left."""
    parts = F.filter(F.transform(F.split(text, rf"(?U)\n{WS}*\n"), strip), lambda p: p != "")
    return let(parts, lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(text)))


def paragraph_windows(text: Column, size: int) -> Column:
    return F.flatten(F.transform(paragraphs(text), lambda p: word_windows(p, size)))


def chunk_id(doc_id: Column, ordinal: Column) -> Column:
    return F.concat_ws("-", doc_id.cast("string"), F.lit("chunk"), ordinal.cast("string"))


def uuid5(name: Column) -> Column:
    """Name-based UUID (version 5) in the URL namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))

    def layout(h: Column) -> Column:
        nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int")
        variant = F.substring(F.lit("89ab"), F.pmod(nibble, F.lit(4)) + 1, F.lit(1))
        return F.concat(
            F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"),
            F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3),
            F.lit("-"), F.substring(h, 21, 12),
        )

    return let(digest, layout)


def tokens(text: Column) -> Column:
    """Lower-cased search tokens in text order."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower)


def token_index(token: Column) -> Column:
    """First four SHA-1 bytes as an unsigned integer."""
    return F.conv(F.substring(F.sha1(token), 1, 8), 16, 10).cast("bigint")


def hash_vector(text: Column, size: int = 768) -> Column:
    """SHA-256 bytes scaled to [0, 1] and repeated: a stand-in for an absent embedding."""
    return let(
        F.sha2(text, 256),
        lambda h: F.transform(
            F.sequence(F.lit(0), F.lit(size - 1)),
            lambda i: F.conv(F.substring(h, F.pmod(i, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast(
                "double"
            )
            / 255.0,
        ),
    )


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def token_estimate(text: Column) -> Column:
    """Four characters count as one token."""
    return F.floor(F.length(text) / 4).cast("bigint")


def _budget_chars(max_tokens: Column) -> Column:
    return (max_tokens * 4 + 3).cast("int")


def truncate_back(text: Column, max_tokens: Column) -> Column:
    """Longest prefix whose token estimate fits."""
    return F.when(max_tokens <= 0, "").otherwise(F.left(text, _budget_chars(max_tokens)))


def truncate_front(text: Column, max_tokens: Column) -> Column:
    """Longest suffix whose token estimate fits."""
    return F.when(max_tokens <= 0, "").otherwise(F.right(text, _budget_chars(max_tokens)))


def sentences(text: Column) -> Column:
    """Runs ending in sentence punctuation or the end of a line, trimmed."""
    runs = F.regexp_extract_all(text, F.lit(r"[^.!?\n]+[.!?]*"), F.lit(0))
    return F.filter(F.transform(runs, strip), lambda s: s != "")


def strip_fences(text: Column) -> Column:
    """Remove a Markdown code fence around stored output."""
    opened = F.regexp_replace(strip(text), r"\A```(json)?", "")
    return strip(F.regexp_replace(opened, r"```\z", ""))


def glob_to_regex(pattern: Column) -> Column:
    """Anchored regex for a shell pattern with ``*``, ``?``, ``[..]`` and ``[!..]``."""
    escaped = F.regexp_replace(pattern, r"([.+^$(){}|\\])", r"\\$1")
    escaped = F.regexp_replace(escaped, r"\[(?![^\]]*\])", r"\\[")  # an unclosed bracket is literal
    body = F.replace(F.replace(escaped, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit("."))
    return F.concat(F.lit("^(?s:"), F.replace(body, F.lit("[!"), F.lit("[^")), F.lit(")$"))


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _hashes(points: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` code points."""
    points, count = points.astype(np.uint64), len(points) - size + 1
    h = np.zeros(count, np.uint64)
    for i in range(size):
        h = (h ^ points[i : count + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def run_hashes(text: Column, size: Column) -> Column:
    """Distinct hashes of the runs of ``size`` characters, without order; none of a shorter text.

    Eight bytes a character, for a batch of rows at once: for short texts.  Runs are hashed from code
    points in Arrow batches: a built-in ``substr`` per run would walk the text from its start each time.
    """

    @F.pandas_udf("array<bigint>")
    def hashed(texts: pd.Series, sizes: pd.Series) -> pd.Series:
        out = []
        for value, n in zip(texts, sizes):
            points = _code_points(value or "")
            out.append(np.unique(_hashes(points, n)) if 1 <= n <= len(points) else [])
        return pd.Series(out)

    return hashed(text, size)


def runs_among(rows: DataFrame, key: str, text: str, wanted: Mapping[int, np.ndarray | int]) -> DataFrame:
    """``(key, size, hash)`` of the runs of each text whose ``run_hashes`` are ``wanted``: by size, the
    sorted hashes, or the largest of too many to travel.

    A task holds the hashes of one span of a text at a time, whatever the texts' number and length.
    A hash may come again from another span.
    """

    def of(points: np.ndarray, size: int, hashes: np.ndarray | int) -> Iterator[np.ndarray]:
        most = hashes if isinstance(hashes, int) else hashes[-1]
        for start in range(0, len(points) - size + 1, SPAN):
            h = _hashes(points[start : start + SPAN + size - 1], size)
            h = h[h <= most]
            if not isinstance(hashes, int):
                h = h[hashes[np.searchsorted(hashes, h)] == h]
            if len(h):
                yield np.unique(h)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            row, sizes, found, held = [], [], [], 0

            def packed() -> pa.RecordBatch:
                lengths = [len(h) for h in found]
                columns = [ids.take(pa.array(np.repeat(row, lengths))), pa.array(np.repeat(sizes, lengths), pa.int32()), pa.array(np.concatenate(found))]
                return pa.RecordBatch.from_arrays(columns, names=[key, "size", "hash"])

            for i in range(batch.num_rows):
                points = _code_points(texts[i].as_py() or "")
                for size, hashes in wanted.items():
                    for h in of(points, size, hashes):
                        row.append(i)
                        sizes.append(size)
                        found.append(h)
                        held += len(h)
                        if held >= FOUND:
                            yield packed()
                            row, sizes, found, held = [], [], [], 0
            if held:
                yield packed()

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, text).mapInArrow(find, f"{key} {kind}, size int, hash long")
