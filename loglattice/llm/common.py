"""Helpers the operators share: shared tables, words and window hashes, packed arrays."""

from __future__ import annotations

import math
import pickle
import sys
import types
import uuid
from collections.abc import Callable, Iterable
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.session import shared_dir

A_Z, a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)  # odd, so that powers never vanish mod 2**64


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(column, A_Z, a_z)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later jobs do not repeat its work,
    and a lost executor costs a read, not a recomputation.

    Tables lie under ``<shared folder>/llm-<application id>/``, so one application's files can
    be removed together.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole(spark: SparkSession, value: object) -> Broadcast:
    """Broadcast an object with the code of its class, so that workers need no copy of this package;
    ``arrived`` gives it back in a task."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def arrived(shared: Broadcast):
    return pickle.loads(shared.value)


def kept(key: str, make: Callable[[], Any]) -> Any:
    """``make()``, called once per worker process.  What it gives lies in a module of its own: a
    cache around a function would travel by name and ask workers for this package."""
    store = sys.modules.setdefault("kept_by_worker", types.ModuleType("kept_by_worker")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def shards_for(df: DataFrame, bytes_each: int = 8 << 20) -> int:
    """Partitions for an exchange that grows with ``df``: by the planner's size of its input,
    and at least what the cluster sets for shuffles."""
    spark = df.sparkSession
    floor = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return floor if size > 1 << 60 else max(floor, math.ceil(size / bytes_each))


def words(text: str | None, lower: bool = False) -> list[bytes]:
    """The runs of bytes between the white space bytes 09-0D and 20."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()  # bytes: both touch ASCII alone


def word_hashes(items: Iterable[bytes], count: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, items), np.uint64, count)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finishing step of splitmix64, a fixed formula)."""
    h = h.copy()
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive entries of ``h``."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out *= MULTIPLIER
        out += h[i : len(h) - n + 1 + i]
    return mixed(out)


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """A shard in [0, shards) by the high half of each hash."""
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... of every run, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - first, lengths)


def gaps(sorted_positions: np.ndarray) -> bytes:
    """Increasing positions as one byte per gap; 255 stands for 255 more to come."""
    step = np.diff(sorted_positions, prepend=0)
    full = step // 255
    out = np.full(len(step) + int(full.sum()), 255, np.uint8)
    out[np.cumsum(full + 1) - 1] = step % 255
    return out.tobytes()


def positions(coded: bytes) -> np.ndarray:
    """The inverse of ``gaps``."""
    step = np.frombuffer(coded, np.uint8)
    return np.cumsum(step, dtype=np.int64)[step != 255]


def squeezed(arrays: list[np.ndarray]) -> bytes:
    """Arrays as one zstd frame behind their lengths and kinds."""
    head = ";".join(f"{a.dtype.str}:{a.size}" for a in arrays).encode()
    body = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    packed = pa.compress(body, codec="zstd", asbytes=True) if body else b""
    return len(head).to_bytes(4, "little") + len(body).to_bytes(8, "little") + head + packed


def unsqueezed(raw: bytes) -> list[np.ndarray]:
    """The inverse of ``squeezed``."""
    n, size = int.from_bytes(raw[:4], "little"), int.from_bytes(raw[4:12], "little")
    kinds = [x.split(":") for x in raw[12 : 12 + n].decode().split(";")]
    body = pa.decompress(raw[12 + n :], size, codec="zstd", asbytes=True) if size else b""
    out, at = [], 0
    for kind, count in kinds:
        out.append(np.frombuffer(body, np.dtype(kind), int(count), at))
        at += out[-1].nbytes
    return out


def cut(order_by: np.ndarray) -> list[tuple[int, slice]]:
    """Slices of an array sorted by shard, for the shards that occur."""
    first = np.flatnonzero(np.diff(order_by, prepend=-1))
    return [(int(order_by[a]), slice(a, b)) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(order_by)])]


def sliced(batches: Iterable[pa.RecordBatch], text: int, limit: int = 8 << 20) -> Iterable[pa.RecordBatch]:
    """The batches in parts whose texts (column ``text``) take about ``limit`` bytes at most, so
    that the arrays made from a part fit in a worker's memory; a longer text is a part alone."""
    for batch in batches:
        sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(text)], np.int64)
        part = (np.cumsum(sizes) - sizes // 2) // limit
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if a < b:
                yield batch.slice(a, b - a)
