"""PCA whitening of embeddings, with a covariance that is merged pairwise from partitions.

Method: entries become whole numbers, so equal vectors are equal exactly and the fit goes over each distinct vector once.
Each partition computes its count, mean and centred scatter in one pass; Chan's formula merges two such summaries, in a
tree over the partitions (treeReduce), so that no sum of squares is ever uncentred. The driver gets one d x d matrix and
takes its eigenvectors. A second pass over the distinct vectors whitens them and merges the same summaries: their
covariance must be the identity, and the largest difference from it is part of the result.

Column sums are whole numbers and are kept exactly next to the floating mean, so n * x - S is exact.

Defined results: rows whose vector is null, or holds a null or non-finite entry, are dropped; so are vectors of another
length than most (of equally common lengths the longer), as no covariance holds both. Repeated vectors count once in the
fit and each gets its rows. A null id is carried through; further columns are left alone. Components without variance
(constant dimensions, fewer distinct vectors than dimensions) have no direction and are left out, so one distinct vector
alone, vectors without entries and an empty table give no rows. An entry beyond 2^53 / scale, or a deviation beyond a
long, fails the job.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Whole numbers are floor(SCALE * entry) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Eigenvalues below this share of the largest, times the dimensions, are rounding.
TINY = 1e-12
#: Rows that are centred at once inside a task.
ROWS = 4096


@dataclass(frozen=True)
class Moments:
    """Count, exact column sums, mean and centred scatter of some rows."""

    n: int
    sums: list[int]
    mean: np.ndarray
    scatter: np.ndarray

    def merge(self, other: Moments) -> Moments:
        """Chan's pairwise formula: the scatter of both is theirs and that of the two means."""
        if not self.n or not other.n:
            return self if self.n else other
        n = self.n + other.n
        gap = other.mean - self.mean
        mean = self.mean + gap * (other.n / n)
        scatter = self.scatter + other.scatter + np.outer(gap, gap) * (self.n * other.n / n)
        return Moments(n, [a + b for a, b in zip(self.sums, other.sums, strict=True)], mean, scatter)

    @classmethod
    def of(cls, rows: np.ndarray) -> Moments:
        """Of rows of whole or real numbers; whole ones are summed as such."""
        n, d = rows.shape
        if not n:
            return cls(0, [0] * d, np.zeros(d), np.zeros((d, d)))
        if rows.dtype.kind == "i":
            wide = rows.astype(object) if int(np.abs(rows).max(initial=0)) * n >= 1 << 62 else rows
            sums = [int(s) for s in wide.sum(axis=0)]
            first = rows[0]
            near = (rows - first).astype(np.float64)  # whole differences are exact
            mean = first + near.mean(axis=0)
            near -= near.mean(axis=0)
        else:
            sums, mean = [0] * d, rows.mean(axis=0)
            near = rows - mean
        return cls(n, sums, mean.astype(np.float64), near.T @ near)


def whole_vectors(rows: DataFrame, vector: str, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """The rows with x, their vector as whole numbers packed in a binary of longs, null where it can't be used."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) > 2.0**53 / scale))
    finite = ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    large = F.when(finite & bad, F.raise_error(F.lit("an entry is too large to be a whole number")))
    usable = rows.where(v.isNotNull() & F.coalesce(finite, F.lit(False))).withColumn("entries", F.coalesce(large, v))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entries = batch.column(batch.num_columns - 1)
            flat = entries.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            whole = np.floor(scale * flat).astype("<i8") + shift
            to = np.concatenate(([0], np.cumsum(entries.value_lengths().to_numpy(zero_copy_only=False)))) * 8
            data = pa.py_buffer(whole.tobytes())
            packed = pa.Array.from_buffers(pa.large_binary(), len(entries), [None, pa.py_buffer(to.astype("<i8").tobytes()), data])
            columns = [*batch.columns[:-1], packed.cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "x"])

    kept = [c for c in usable.columns if c != "entries"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in usable.select(*kept).schema.fields)
    return usable.select(*kept, "entries").mapInArrow(pack, f"{schema}, x binary")


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Packed vectors of d whole numbers as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, d)


def merged_moments(vectors: DataFrame, d: int, project: np.ndarray | None = None, centre: tuple | None = None) -> Moments:
    """The moments of the packed vectors x, or of (n * x - S) / n times `project` with centre = (n, S)."""

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = d if project is None else project.shape[1]
        whole = Moments.of(np.zeros((0, k)))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = _matrix(batch.column(0).slice(at, ROWS), d)
                whole = whole.merge(Moments.of(rows if project is None else deviations(rows, *centre) @ project))
        out = [[whole.n], [[str(s) for s in whole.sums]], [whole.mean.tobytes()], [whole.scatter.tobytes()]]
        types = [pa.int64(), pa.list_(pa.string()), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["n", "s", "m", "c"])

    k = d if project is None else project.shape[1]
    parts = vectors.select("x").mapInArrow(summarize, "n long, s array<string>, m binary, c binary")
    read = lambda r: Moments(r.n, [int(s) for s in r.s], np.frombuffer(r.m), np.frombuffer(r.c).reshape(k, k))
    none = Moments.of(np.zeros((0, k)))
    pairs = parts.rdd.map(read)
    return pairs.treeReduce(Moments.merge, depth=3) if pairs.getNumPartitions() else none


def deviations(rows: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n of rows of whole numbers, from exact n * x - S."""
    return exact_deviations(rows, n, sums).astype(np.float64) / n


def exact_deviations(rows: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S as whole numbers: longs where they fit, else Python's."""
    most = int(np.abs(rows).max()) if rows.size else 0
    if n * most + max(map(abs, sums), default=0) < 1 << 62:
        return rows * np.int64(n) - np.array(sums, np.int64)
    return rows.astype(object) * n - np.array(sums, object)


def squared_length(rows: np.ndarray) -> list[int]:
    """The sum of squares of each row of whole numbers, exact; beyond a long it fails."""
    most = int(np.abs(rows).max()) if rows.size else 0
    if most * most * max(1, rows.shape[1]) < 1 << 62:
        return (rows.astype(np.int64) ** 2).sum(axis=1).tolist()
    found = [sum(int(v) * int(v) for v in row) for row in rows]
    if any(v >= 1 << 63 for v in found):
        raise OverflowError("a deviation is beyond a long")
    return found


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: count and sums of the fit, directions (columns), eigenvalues, shares of the trace, the check."""

    n: int
    sums: list[int]
    directions: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float

    def apply(self, rows: np.ndarray) -> np.ndarray:
        return deviations(rows, self.n, self.sums) @ (self.directions / np.sqrt(self.values))


def fit_whitening(vectors: DataFrame, d: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of distinct packed vectors; None where nothing varies."""
    whole = merged_moments(vectors, d)
    if not whole.n:
        return None
    values, directions = np.linalg.eigh(whole.scatter / whole.n)
    order = np.argsort(values)[::-1]
    values, directions = values[order], directions[:, order]
    kept = np.flatnonzero(values > max(TINY * len(values) * values[0], 0.0))[:components]
    if not len(kept):
        return None
    explained = values / values.sum()
    values, directions = values[kept], directions[:, kept]
    check = merged_moments(vectors, d, directions / np.sqrt(values), (whole.n, whole.sums))
    error = float(np.abs(check.scatter / check.n - np.eye(len(kept))).max())
    return Whitening(whole.n, whole.sums, directions, values, explained[kept], error)


def whiten_embeddings(
    rows: DataFrame,
    vector: str = "embedding",
    vec_id: str = "vec_id",
    components: int = COMPONENTS,
    scale: int = SCALE,
    shift: int = SHIFT,
) -> DataFrame:
    """A row of each usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = rows.sparkSession
    scratch = Scratch(spark)
    own = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    packed = whole_vectors(own, "vector", scale, shift).select("vec_id", "x")
    sizes = packed.groupBy(F.octet_length("x").alias("size")).agg(F.count("*").alias("rows"))
    # as many rows as there are lengths of vectors; the two first places are enough
    common = sizes.orderBy(F.desc("rows"), F.desc("size")).limit(1).collect()
    d = common[0]["size"] // 8 if common else 0
    if not d:
        return spark.createDataFrame([], schema)
    packed = packed.where(F.octet_length("x") == 8 * d)
    distinct = scratch.keep(packed.select("x").distinct(), "distinct-vectors")
    fitted = fit_whitening(distinct, d, components)
    scratch.clear()
    if fitted is None:
        return spark.createDataFrame([], schema)

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(fitted.values)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                x = _matrix(some.column(1), d)
                far = squared_length(exact_deviations(x, fitted.n, fitted.sums))
                ids = some.column(0).take(pa.array(np.repeat(np.arange(len(x)), k)))
                numbers = {
                    "component": pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                    "n": pa.array(np.full(len(x) * k, fitted.n), pa.int64()),
                    "deviation": pa.array(np.repeat(np.array(far, np.int64), k)),
                    "whitened": pa.array(fitted.apply(x).ravel()),
                    "explained": pa.array(np.tile(fitted.explained, len(x))),
                    "identity_error": pa.array(np.full(len(x) * k, fitted.identity_error)),
                }
                yield pa.RecordBatch.from_arrays([ids, *numbers.values()], names=["vec_id", *numbers])

    return packed.mapInArrow(whiten, schema)
