"""Quantised vectors as packed doubles, and their exact integer inner products; shared by the operators on embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Scores outside this range are reported as its ends and ordered by their doubles.
MOST = 2**63 - 1


def quantised(vectors: DataFrame, id_col: str, vector: str, scale: int, keep: tuple[str, ...] = (), without_id: bool = False) -> DataFrame:
    """vec_id, dim, v (components floor(scale * x) as packed doubles, which hold any such integer) and the columns `keep` of
    the rows that take part: those with an id (or all, if `without_id`) whose vector is not null or empty and has neither
    null components nor any that is not finite, before or after scaling."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column(1)
            n = np.asarray(rows.value_lengths().fill_null(0))
            x = np.asarray(rows.flatten().to_numpy(zero_copy_only=False), float)
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(scale * x)
            ok = n > 0
            ok[np.repeat(np.arange(len(n)), n)[~np.isfinite(x)]] = False
            ends, at = np.cumsum(n), np.flatnonzero(ok)
            packed = pa.array([x[ends[k] - n[k] : ends[k]].astype("<f8").tobytes() for k in at], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(n[at].astype(np.int32)), packed, *[c.take(pa.array(at)) for c in b.columns[2:]]], ["vec_id", "dim", "v", *keep])

    types = dict(vectors.dtypes)
    schema = ", ".join(["vec_id long", "dim int", "v binary", *[f"`{c}` {types[c]}" for c in keep]])
    some = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v"), *[F.col(f"`{c}`") for c in keep]).where("v is not null")
    return (some if without_id else some.where("vec_id is not null")).mapInArrow(run, schema)


def one_of_each(rows: DataFrame, *more: str) -> DataFrame:
    """One row of each vec_id: the least of its (more, dim, v), so that repeated ids give the same result in every run."""
    least = F.min(F.struct(*more, "dim", "v")).alias("row")
    return rows.groupBy("vec_id").agg(least).select("vec_id", "row.dim", "row.v", *[f"row.{c}" for c in more])


def as_matrix(values, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), "<f8").reshape(-1, dim)


def norms(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((x * x).sum(1))


def products(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Exact inner products of all rows of a and b as 64-bit integers, and, where some lie outside of them, a second key.

    By floating point where no partial sum can pass 2**53 (Cauchy-Schwarz bounds each), by 64-bit integers up to 2**62, and
    by Python's for the pairs beyond. The second key is 0 but for saturated scores, whose nearest double it is."""
    if not (len(a) and len(b)):
        return np.zeros((len(a), len(b)), np.int64), None
    na, nb = norms(a), norms(b)
    most = na.max() * nb.max()
    if most < 2.0**52:
        return (a @ b.T).astype(np.int64), None
    if most < 2.0**62:
        return a.astype(np.int64) @ b.astype(np.int64).T, None
    whole = [np.where((n < 2.0**62)[:, None], x, 0).astype(np.int64) for n, x in ((na, a), (nb, b))]
    score = whole[0] @ whole[1].T
    key = np.zeros(score.shape)
    with np.errstate(invalid="ignore", over="ignore"):
        large = np.argwhere(~(np.outer(na, nb) < 2.0**62))
    for i, j in large:
        exact = sum(int(x) * int(y) for x, y in zip(a[i], b[j]))
        score[i, j] = max(-MOST, min(MOST, exact))
        if abs(exact) > MOST:
            try:
                key[i, j] = float(exact)
            except OverflowError:
                key[i, j] = np.inf if exact > 0 else -np.inf
    return score, key
