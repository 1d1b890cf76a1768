"""Embedding whitening by Chan's merging of moments.

Each partition folds its batches into (n, sums, centred scatter): a batch is centred on its own mean before anything is
multiplied, and two such parts are merged by Chan's formula M = Ma + Mb + d d' na nb / (na + nb), with d the difference of the
means. treeReduce merges the partitions' parts on the executors; the driver gets one part for each vector length, whose
covariance it decomposes. A second pass whitens all rows and folds them the same way, to measure how far the covariance of the
result is from the identity; a third writes them.

Sums are Python integers, so that means and deviations are exact at any count; scatters are doubles.

Defined cases: vectors that are null, empty, or hold null or non-finite components (before or after scaling) take no part;
rows without an id and repeated rows do, each as a row of its own; vectors of each length are a fit list of their own;
directions whose variance is under 1e-12 of the largest (all of them, if all vectors are equal) have no unit length and are
left out, so such rows have no result there; an empty table gives an empty result; other columns of the table are not looked at.
What the driver holds is of the size of the square of a vector's length, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._stage import Scratch
from ._vectors import as_matrix, quantised

#: Of a vector length: count, exact sums, centred scatter.
Part = tuple[int, list[int], np.ndarray]


def sums_of(x: np.ndarray) -> list[int]:
    """Exact sums of the columns of integers that are held as doubles."""
    if np.abs(x).max(initial=0) * len(x) < 2.0**53:
        return [int(s) for s in x.sum(0)]
    return [sum(map(int, column)) for column in x.T]


def part_of(x: np.ndarray, whole: bool) -> Part:
    """Moments of the rows of x, centred on their own mean; `whole` if x are integers, whose sums are exact then."""
    sums = sums_of(x) if whole else x.sum(0).tolist()
    centred = x - np.array([s / len(x) for s in sums])
    return len(x), sums, centred.T @ centred


def merged(a: Part, b: Part) -> Part:
    """Chan's pairwise formula. The difference of the means is exact up to one rounding."""
    n = a[0] + b[0]
    d = np.array([(t * a[0] - s * b[0]) / (a[0] * b[0]) for s, t in zip(a[1], b[1])])
    return n, [s + t for s, t in zip(a[1], b[1])], a[2] + b[2] + np.outer(d, d) * (a[0] / n * b[0])


def merge_all(a: dict[int, Part], b: dict[int, Part]) -> dict[int, Part]:
    return {dim: merged(a[dim], b[dim]) if dim in a and dim in b else a.get(dim) or b[dim] for dim in {*a, *b}}


def moments(rows: DataFrame, matrices, whole: bool = True) -> dict[int, Part]:
    """Moments of all rows, by vector length; `matrices` makes (length, matrix) pairs of a batch."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        total: dict[int, Part] = {}
        for b in batches:
            for dim, x in matrices(b):
                total = merge_all(total, {dim: part_of(x, whole)})
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], ["part"])

    def read(row) -> dict[int, Part]:
        import pickle

        return pickle.loads(bytes(row.part))

    parts = rows.mapInArrow(fold, "part binary").rdd.map(read)
    n = parts.getNumPartitions()
    return parts.treeReduce(merge_all, depth=max(2, n.bit_length() // 5)) if n else {}


def squared(d: np.ndarray) -> list[int]:
    """Exact sums of squares of the rows of integers |d| < 2**62: products of 31-bit halves, summed in halves again."""
    high, low = d >> 31, d & 0x7FFFFFFF
    total = 0
    for shift, x in ((62, high * high), (32, high * low), (0, low * low)):
        total = total + ((x >> 31).sum(1).astype(object) << (shift + 31)) + ((x & 0x7FFFFFFF).sum(1).astype(object) << shift)
    return list(total)


@dataclass
class Space:
    """What is known of the vectors of one length. axes: a unit eigenvector a row; values: their eigenvalues, falling."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    trace: float

    def differences(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact: 64-bit integers where they are wide enough, else Python's."""
        if self.n * np.abs(x).max(initial=0) + max(map(abs, self.sums)) < 2.0**61:
            return self.n * x.astype(np.int64) - np.array(self.sums, np.int64)
        return self.n * np.array([[int(v) for v in row] for row in x], object).reshape(x.shape) - np.array(self.sums, object)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (self.differences(x) / self.n).astype(float) @ (self.axes / np.sqrt(self.values)[:, None]).T

    def deviations(self, x: np.ndarray) -> list[int]:
        d = self.differences(x)
        return squared(d) if d.dtype != object else list((d * d).sum(1))


def _space(part: Part, components: int) -> Space:
    n, sums, scatter = part
    values, vectors = np.linalg.eigh((scatter + scatter.T) / (2 * n))
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > max(0.0, 1e-12 * values.max(initial=0.0))]
    return Space(n, sums, vectors[:, order].T.copy(), values[order], float(np.trace(scatter) / n))


@dataclass
class Whitening:
    """A fitted whitening: its spaces by vector length."""

    spaces: dict[int, Space]

    def identity_error(self, rows: DataFrame) -> dict[int, float]:
        """Largest absolute entry of the whitened rows' covariance minus the identity, by a pass over all rows."""
        spaces = self.spaces

        def matrices(b):
            for dim, _, x in _matrices(b):
                if len(spaces[dim].values):
                    yield dim, spaces[dim].whitened(x)

        parts = moments(rows, matrices, whole=False)
        return {dim: float(np.abs(m / n - np.eye(len(m))).max()) for dim, (n, _, m) in parts.items()}

    def transform(self, rows: DataFrame) -> DataFrame:
        """vec_id, dim, n, deviation (decimal; null beyond 38 digits), whitened (array) of quantised rows."""
        spaces = self.spaces

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from decimal import Decimal

            for b in batches:
                for dim, at, x in _matrices(b):
                    s = spaces[dim]
                    exact = [Decimal(d) if d < 10**38 else None for d in s.deviations(x)]
                    w = s.whitened(x)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
                    yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(at)), pa.array(np.full(len(x), dim, np.int32)), pa.array(np.full(len(x), s.n)), pa.array(exact, pa.decimal128(38, 0)), lists], ["vec_id", "dim", "n", "deviation", "whitened"])

        return rows.mapInArrow(run, "vec_id long, dim int, n long, deviation decimal(38,0), whitened array<double>")


def _matrices(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Vector length, places in the batch and matrix, of each length in the batch."""
    dims, vs = b.column("dim").to_numpy(), b.column("v").to_pylist()
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        yield int(dim), at, as_matrix([vs[k] for k in at], int(dim))


def fit(rows: DataFrame, components: int = 8) -> Whitening:
    """The whitening of quantised rows (`_vectors.quantised`): the first `components` axes of each vector length."""
    parts = moments(rows, lambda b: ((dim, x) for dim, _, x in _matrices(b)))
    return Whitening({dim: _space(p, components) for dim, p in parts.items()})


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = 8, scale: int = 1024) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error for each row and component."""
    rows = Scratch(vectors.sparkSession, "whitening").keep(quantised(vectors, id_col, vector, scale, without_id=True), "rows")
    model = fit(rows, components)
    errors = model.identity_error(rows)
    facts = [(dim, k + 1, float(e / s.trace), errors[dim]) for dim, s in model.spaces.items() for k, e in enumerate(s.values)]
    known = vectors.sparkSession.createDataFrame(facts, "dim int, component int, explained double, identity_error double")
    each = model.transform(rows).select("vec_id", "dim", "n", "deviation", F.posexplode("whitened").alias("at", "whitened")).withColumn("component", F.col("at") + 1)
    return each.join(F.broadcast(known), ["dim", "component"]).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    """deviation is null where it does not fit a long; deviation_exact holds it there. The contract adds 100,000 to each
    component; centring takes it away again, exactly, as sums are exact: no column depends on it, so it is not added."""
    got = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return got.select("vec_id", "component", "n", F.expr("try_cast(deviation as bigint)").alias("deviation"), "whitened", "explained", "identity_error", F.col("deviation").alias("deviation_exact"))
