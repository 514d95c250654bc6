"""Embedding whitening by spectral divide and conquer.

Vectors become whole numbers, each distinct vector counts once, and the covariance of the distinct
ones is summed where they lie.  The covariance (dimension by dimension, whatever the row count) is
split on the driver: the polar factor of a shifted matrix, found by dynamically weighted Halley
steps (QDWH), gives the projector on the eigenvectors above the shift; both invariant subspaces
are split again until single components are left.  The leading components are broadcast and every
row is projected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loglattice.llm import common as c
from loglattice.llm.registry import query

SCALE = 256
COMPONENTS = 4
MOST_DIMENSIONS = 4096  # a covariance of this size has 128 MB
HALF = 20  # bits
EPS = np.finfo(np.float64).eps


# spectral divide and conquer


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal factor of the polar decomposition of a symmetric matrix, by QDWH steps in
    their QR form; for a symmetric matrix it is the matrix sign.

    The weights follow the published recurrence for a lower bound of the smallest singular value,
    and a step cubes the distance from one: a handful of steps reaches rounding.
    """
    size = len(a)
    norm = np.linalg.norm(a, 2)
    if norm == 0:
        return np.eye(size)
    x = a / norm
    low = max(np.linalg.norm(np.linalg.inv(x), 1) ** -1 / np.sqrt(size) if np.linalg.cond(x) < 1 / EPS else EPS, EPS)
    for _ in range(60):
        low = min(low, 1.0)
        square = low * low
        d = (4 * (1 - square) / (square * square)) ** (1 / 3)
        w1 = np.sqrt(1 + d) + 0.5 * np.sqrt(max(8 - 4 * d + 8 * (2 - square) / (square * np.sqrt(1 + d)), 0))
        w2 = (w1 - 1) ** 2 / 4
        w3 = w1 + w2 - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(w3) * x, np.eye(size)]))
        new = (w2 / w3) * x + (w1 - w2 / w3) / np.sqrt(w3) * (q[:size] @ q[size:].T)
        new = (new + new.T) / 2
        moved, x = np.linalg.norm(new - x), new
        low = min(1.0, low * (w1 + w2 * square) / (1 + w3 * square))
        if moved <= 4 * EPS ** (1 / 3) * 1e-3 and 1 - low < 10 * EPS:
            break
    return x


def _bases(projector: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of the range of a projector and of its complement: the columns with the
    largest remaining length are taken first, then a step of subspace iteration cleans them."""
    rest, picked = projector.copy(), []
    for _ in range(rank):
        lengths = np.einsum("ij,ij->j", rest, rest)
        column = int(np.argmax(lengths))
        unit = rest[:, column] / np.sqrt(lengths[column])
        picked.append(column)
        rest = rest - np.outer(unit, unit @ rest)
    q, _ = np.linalg.qr(projector[:, picked], mode="complete")
    q, _ = np.linalg.qr(np.hstack([projector @ q[:, :rank], q[:, rank:] - projector @ q[:, rank:]]))
    return q[:, :rank], q[:, rank:]


def _jacobi(a: np.ndarray) -> np.ndarray:
    """The rotation that makes a symmetric 2 x 2 matrix diagonal."""
    angle = 0.5 * np.arctan2(2 * a[0, 1], a[0, 0] - a[1, 1])
    return np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])


def spectral_split(a: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) of a symmetric matrix, in no order.

    A block that is a multiple of the identity up to rounding is left as it is: every basis of it
    is one of eigenvectors.  The shift lies in the widest gap of the sorted diagonal near its
    middle; if all eigenvalues fall on one side of it, the mean is tried, which always parts
    unequal eigenvalues.
    """
    size = len(a)
    if size == 1:
        return np.eye(1)
    a = (a + a.T) / 2
    mean = np.trace(a) / size
    centred = a - mean * np.eye(size)
    scale = np.abs(a).max()
    if np.abs(centred).max() <= 4 * EPS * scale * size:
        return np.eye(size)
    if size == 2:
        return _jacobi(a)
    diagonal = np.sort(np.diag(a))
    for shift in (np.median(diagonal), mean):
        sign = polar_factor(a - shift * np.eye(size))
        projector = (sign + np.eye(size)) / 2
        rank = int(round(float(np.trace(projector))))
        if 0 < rank < size and np.abs(projector @ projector - projector).max() < 1e-6:
            upper, lower = _bases(projector, rank)
            return np.hstack([v @ spectral_split(v.T @ a @ v) for v in (upper, lower)])
    # an eigenvalue lies on both shifts: part it from the rest beside the mean
    spread = np.abs(centred).max()
    for step in (0.37, -0.37, 0.11, -0.11, 0.03, -0.03, 0.007, -0.007, 1e-3, -1e-3):
        sign = polar_factor(centred - step * spread * np.eye(size))
        projector = (sign + np.eye(size)) / 2
        rank = int(round(float(np.trace(projector))))
        if 0 < rank < size:
            upper, lower = _bases(projector, rank)
            return np.hstack([v @ spectral_split(v.T @ a @ v) for v in (upper, lower)])
    return np.eye(size)


def principal(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and their unit eigenvectors as columns.

    What the splits leave off the diagonal (rounding) is split once more, in the basis found, so
    the vectors are eigenvectors to double precision.
    """
    if not len(covariance):
        return np.empty(0), np.empty((0, 0))
    vectors = spectral_split(covariance)
    vectors = vectors @ spectral_split(vectors.T @ covariance @ vectors)
    vectors, _ = np.linalg.qr(vectors)
    values = np.einsum("ij,ij->j", vectors, covariance @ vectors)
    order = np.argsort(-values, kind="stable")
    return np.maximum(values[order], 0.0), vectors[:, order]


# rows


def whole(vector: Column) -> Column:
    """Every entry as the long floor(256 * entry); null for a vector that is null or holds an
    entry that is null, not finite, or too large for a long."""
    most = float(1 << 62) / SCALE
    x = F.transform(vector, lambda e: e.cast("double"))
    fine = F.forall(x, lambda e: F.coalesce((e > -most) & (e < most), F.lit(False)))
    return F.when(fine, F.transform(x, lambda e: F.floor(e * SCALE)))


def _matrix(batch: pa.RecordBatch, column: int, size: int) -> np.ndarray:
    flat = batch.column(column).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, size)


def _summed(fit: DataFrame, per_batch, rows: int, columns: int, kind: str) -> np.ndarray:
    """The sum over all batches of a (rows, columns) array, row by row: every task sends each row
    of its array once, tasks are added by row on Spark, and ``rows`` rows reach the driver."""
    number = pa.int64() if kind == "long" else pa.float64()
    schema = pa.schema([("i", pa.int32()), ("v", pa.list_(number))])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                total = per_batch(batch) if total is None else total + per_batch(batch)
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(rows), pa.int32()), pa.array(list(total), pa.list_(number))], schema=schema)

    def added(table: pa.Table) -> pa.Table:
        total = np.zeros(columns, np.int64 if kind == "long" else np.float64)
        for v in sorted(table.column("v").to_pylist()):  # in an order that does not depend on arrival
            total += np.array(v, total.dtype)
        return pa.table({"i": table.column("i").slice(0, 1), "v": pa.array([total], pa.list_(number))}, schema=schema)

    out = np.zeros((rows, columns), np.int64 if kind == "long" else np.float64)
    parts = fit.mapInArrow(partial, f"i int, v array<{kind}>")
    for i, v in parts.groupBy("i").applyInArrow(added, f"i int, v array<{kind}>").collect():
        out[i] = v
    return out


def kept_rows(rows: DataFrame, vector: str = "embedding") -> tuple[DataFrame, int]:
    """The rows with a usable vector, with it as whole numbers (``x``), and its length.

    Vectors of another length than the commonest one (ties: the longer) are dropped as well, as
    they share no covariance.
    """
    usable = rows.drop("x").withColumn("x", whole(F.col(vector))).where(F.col("x").isNotNull())
    lengths = usable.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    size = lengths[0]["size"] if lengths else 0
    if size > MOST_DIMENSIONS:
        raise ValueError(f"{size} dimensions; a covariance of at most {MOST_DIMENSIONS} goes through the driver")
    return usable.where(F.size("x") == size), size


class Whitening:
    """Count, sums, leading eigenvalues and eigenvectors of the distinct vectors, and the largest
    error of the covariance of what they whiten."""

    def __init__(self, fit: DataFrame, size: int, most: int = COMPONENTS) -> None:
        def count_and_sum(batch: pa.RecordBatch) -> np.ndarray:
            x = _matrix(batch, 0, size)  # in two halves, so that no sum passes 64 bits
            return np.vstack([(x >> HALF).sum(0), (x & ((1 << HALF) - 1)).sum(0), np.full(size, len(x))])

        size_or_one = max(size, 1)
        if size:
            sums = _summed(fit, count_and_sum, 3, size, "long")
            self.n, self.sums = int(sums[2, 0]), [(int(h) << HALF) + int(low) for h, low in zip(sums[0], sums[1])]
        else:
            self.n, self.sums = fit.count(), []
        # exact, then one rounding
        mean = self.mean = np.array([s / self.n for s in self.sums] if self.n else np.zeros(size))

        def products(batch: pa.RecordBatch) -> np.ndarray:
            d = _matrix(batch, 0, size) - mean
            return d.T @ d

        covariance = _summed(fit, products, size, size, "double") / self.n if size and self.n else np.zeros((size, size))
        self.trace = float(np.trace(covariance))
        values, vectors = principal((covariance + covariance.T) / 2)
        self.values, self.vectors = values[:most], vectors[:, :most]
        self.alive = self.values > 8 * EPS * size_or_one * (values[0] if size else 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.weights = weights = np.where(self.alive, self.vectors / np.sqrt(self.values), 0.0)
        self.error = None
        if self.alive.any():
            live = weights[:, self.alive]
            k = live.shape[1]

            def moments(batch: pa.RecordBatch) -> np.ndarray:
                w = (_matrix(batch, 0, size) - mean) @ live
                return np.vstack([w.sum(0), w.T @ w])

            got = _summed(fit, moments, k + 1, k, "double") / self.n
            self.error = float(np.abs(got[1:] - np.outer(got[0], got[0]) - np.eye(k)).max())


def whitened(rows: DataFrame, vector: str = "embedding", most: int = COMPONENTS, store=c.stored) -> DataFrame:
    """Every row with a usable vector, once per component (the ``most`` leading ones, or as many as
    there are dimensions), in place of the vector the columns ``component``, ``n``, ``deviation``, ``whitened``,
    ``explained``, ``identity_error``; own columns of these names are replaced.

    Rows whose vector is null, holds an entry that is null, not finite or over 2**62 / 256, or is
    of another length than the commonest, are dropped.  Repeated rows stay, each distinct vector
    counts once in the fit.  A component without variance has ``whitened`` null; without any
    variance (at most one distinct vector) ``explained`` and ``identity_error`` are null too.
    ``deviation`` is null where it does not fit a long.  An empty table, or one of empty vectors,
    gives no rows.  Of equal eigenvalues any basis may come.

    Distinct vectors are found by a map-side aggregate, so a hot vector is one row per task.  What
    the driver gets and broadcasts is bounded by the dimension.
    """
    new = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    kept, size = kept_rows(rows, vector)
    fit = store(kept.select("x").distinct(), "whitening-fit")
    model = Whitening(fit, size, most)
    base = kept.drop(*new, vector)
    carried = [x for x in base.columns if x != "x"]
    count = len(model.values)
    out_schema = base.select(*carried).schema
    kinds = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    mean, weights, alive, n, sums = model.mean, model.weights, model.alive, model.n, model.sums
    explained = [float(v) / model.trace if model.trace > 0 else None for v in model.values]
    error = model.error
    limit = (1 << 63) - 1

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not count:
                continue
            x = _matrix(batch, batch.num_columns - 1, size)
            most_apart = int(np.abs(x).max()) * n + max(map(abs, sums))
            if most_apart * most_apart * size <= limit:
                apart = ((n * x - np.array(sums)) ** 2).sum(1).tolist()
            else:  # exact in whole numbers of any size
                exact = ((x.astype(object) * n - np.array(sums, object)) ** 2).sum(1)
                apart = [v if v <= limit else None for v in exact]
            w = (x - mean) @ weights
            for k in range(count):
                here = pa.array(w[:, k]) if alive[k] else pa.nulls(len(x), pa.float64())
                added = [
                    pa.array(np.full(len(x), k + 1, np.int32)), pa.array(np.full(len(x), n, np.int64)),
                    pa.array(apart, pa.int64()), here, pa.array([explained[k]] * len(x), pa.float64()),
                    pa.array([error] * len(x), pa.float64()),
                ]
                yield pa.record_batch([*batch.columns[:-1], *added], names=[*carried, *new])

    schema = StructType([*out_schema.fields, *StructType.fromDDL(kinds).fields])
    return base.select(*carried, "x").mapInArrow(project, schema)


@query("op13_embedding_whitening")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    rows = c.table(spark, folder, "embeddings").select("vec_id", "embedding")
    return whitened(rows)
