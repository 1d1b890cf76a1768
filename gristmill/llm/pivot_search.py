"""Exact top-k by inner product over a pivot-distance index.

Each vector is keyed by its nearest pivot and its distance r to it; the distances of a pivot are cut into annuli, whose
bounds and largest norm are kept. For a query at distance d from the pivot, the triangle inequality gives
|q - v| >= max(0, d - r_high, r_low - d) for all of an annulus, so q.v <= (|q|^2 + |v|^2 - that^2) / 2; and also
q.v <= q.p + |q| r_high. A query first searches its own annulus, which gives a k-th score to beat; then its other annuli
are taken in the order of their bounds up to the first that cannot reach that score. So the result is exact.

Of vectors that are equal in all components only the k + 1 with the smallest ids can be among anyone's k best; the rest
are not indexed, which bounds the annulus of a vector that is very common.

Defined cases: vectors that are null, empty or hold a null or a component that is not finite take no part, neither do
rows with a null id; only vectors of one length are compared; ties go to the smaller id; fewer than k candidates give
fewer rows; repeated rows of one id count once, with the least of their vectors. Scores are 64-bit integers, and the ends of
their range where the product lies outside of it; such scores are ordered by their doubles. Vectors whose norm passes 2**100 are
met by all queries, as no bound is kept of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._stage import Scratch
from ._vectors import as_matrix, norms, one_of_each, products, quantised

#: The cell of vectors of which no bound is kept, and the norm from which on they are in it.
_WILD, _HUGE = -1, 2.0**100
_INDEX = "vec_id long, dim int, v binary, cell long, r double, norm2 double"


def fit_pivots(rows: DataFrame, pivots: int, annuli: int, sample: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each length that the sample holds: pivots, by a few rounds of k-means, and each pivot's annulus boundaries.

    Fitted on the `sample` rows that a hash of the id puts first; every row is indexed, whatever the sample."""
    drawn: dict[int, list[bytes]] = {}
    for r in rows.select("dim", "v", F.xxhash64("vec_id").alias("h")).orderBy("h").limit(sample).collect():
        drawn.setdefault(r.dim, []).append(bytes(r.v))
    model = {}
    for dim, vs in drawn.items():
        x = as_matrix(vs, dim)
        x = np.unique(x[norms(x) < _HUGE], axis=0)
        if not len(x):
            continue
        c = x[np.linspace(0, len(x) - 1, min(pivots, len(x))).astype(int)]
        for _ in range(6):
            near = _distance(x, c).argmin(1)
            c = np.stack([x[near == k].mean(0) if (near == k).any() else c[k] for k in range(len(c))])
        d = _distance(x, c)
        near, r = d.argmin(1), d.min(1)
        q = np.arange(1, annuli) / annuli
        model[dim] = (c, np.stack([np.quantile(r[near == k], q) if (near == k).any() else np.zeros(annuli - 1) for k in range(len(c))]))
    return model


def _distance(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """By differences, not by the products' expansion, which cancels where components differ much in size."""
    return np.stack([norms(x - one) for one in c], axis=1) if len(c) else np.zeros((len(x), 0))


def _keyed(rows: DataFrame, model: dict, annuli: int) -> DataFrame:
    """cell: pivot * annuli + annulus; vectors of a length that the sample has not seen are all in cell 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            cell, r, norm2 = np.zeros(len(dims), np.int64), np.zeros(len(dims)), np.zeros(len(dims))
            vs = b.column("v").to_pylist()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = as_matrix([vs[k] for k in at], dim)
                tame = norms(x) < _HUGE
                cell[at[~tame]], norm2[at[~tame]] = _WILD, np.inf
                at, x = at[tame], x[tame]
                norm2[at] = (x * x).sum(1)
                if int(dim) in model and len(at):
                    c, cuts = model[int(dim)]
                    d = _distance(x, c)
                    near = d.argmin(1)
                    r[at] = d[np.arange(len(at)), near]
                    cell[at] = near * annuli + (cuts[near] <= r[at][:, None]).sum(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(r), pa.array(norm2)], ["vec_id", "dim", "v", "cell", "r", "norm2"])

    return rows.mapInArrow(run, _INDEX)


def _best(q: np.ndarray, q_ids: np.ndarray, v: np.ndarray, v_ids: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k best of v for each q, of those at or over `least`; an id is no candidate of its own. Query, id, score, second key."""
    s, key = products(q, v)
    ok = v_ids[None] != q_ids[:, None]
    if least is not None:
        ok &= s >= least[:, None]
    if len(v) > 4 * k:  # only what reaches the k-th score, ties with it included
        low = np.where(ok, s, np.iinfo(np.int64).min)
        ok &= s >= np.partition(low, len(v) - k, axis=1)[:, len(v) - k][:, None]
    a, b = np.nonzero(ok)
    score, key = s[a, b], np.zeros(len(a)) if key is None else key[a, b]
    order = np.lexsort((v_ids[b], -key, -score, a))
    a, b, score, key = a[order], b[order], score[order], key[order]
    first = np.searchsorted(a, a)
    top = np.arange(len(a)) - first < k
    return q_ids[a[top]], v_ids[b[top]], score[top], key[top]


def search(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector: str = "embedding", scale: int = 1024, pivots: int = 16, annuli: int = 8, sample: int = 4096, block_rows: int = 1024, query_rows: int = 8192) -> DataFrame:
    """query_id, rank, vec_id and score of the k best for each row of `vectors` where `is_query` (of id_col) holds.

    The bounds of all cells (pivots * annuli for each vector length) are collected; vectors and queries are not. Cells
    are cut into blocks of about block_rows, queries into groups of about query_rows; a task meets one of each."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "pivot-search")
    rows = scratch.keep(one_of_each(quantised(vectors, id_col, vector, scale)), "rows")
    model = fit_pivots(rows, pivots, annuli, sample)

    salted = Window.partitionBy("v", "dim", "salt").orderBy("vec_id")
    whole = Window.partitionBy("v", "dim").orderBy("vec_id")
    few = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(256))).withColumn("n", F.row_number().over(salted)).where(F.col("n") <= k + 1)
    few = few.withColumn("n", F.row_number().over(whole)).where(F.col("n") <= k + 1).select("vec_id", "dim", "v")
    index = scratch.keep(_keyed(few, model, annuli), "index")
    bounds: dict[int, list] = {}
    for r in index.groupBy("dim", "cell").agg(F.min("r").alias("low"), F.max("r").alias("high"), F.max("norm2").alias("norm2"), F.count(F.lit(1)).alias("n")).collect():
        bounds.setdefault(r.dim, []).append((r.cell, r.low, r.high, r.norm2, max(1, math.ceil(r.n / block_rows))))
    blocks = spark.createDataFrame([(d, c, n) for d, x in bounds.items() for c, _, _, _, n in x], "dim int, cell long, blocks int")
    block = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.col("blocks").cast("long"))
    index = index.join(blocks, ["dim", "cell"]).withColumn("block", block).select("dim", "cell", "block", "vec_id", "v")

    queries = scratch.keep(_keyed(rows.where(is_query(F.col("vec_id"))), model, annuli), "queries")
    groups = max(1, math.ceil(queries.count() / query_rows))
    queries = queries.withColumn("group", F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(groups)))

    # Each query's own annulus first.
    home = queries.join(blocks, ["dim", "cell"], "left").withColumn("block", F.coalesce(block, F.lit(0)))

    def first(key, left: pa.Table, right: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        ids = left["vec_id"].to_numpy()
        least = np.full(len(ids), np.iinfo(np.int64).min)
        if len(ids) and right.num_rows:
            q, _, s, _ = _best(as_matrix(left["v"].to_pylist(), dim), ids, as_matrix(right["v"].to_pylist(), dim), right["vec_id"].to_numpy(), k)
            at = np.searchsorted(np.sort(ids), q)
            count = np.bincount(at, minlength=len(ids))
            low = np.full(len(ids), np.iinfo(np.int64).max)
            np.minimum.at(low, at, s)
            least[np.argsort(ids)] = np.where(count >= k, low, np.iinfo(np.int64).min)
        return pa.table([left["vec_id"], left["dim"], left["v"], left["group"], pa.array(least)], ["vec_id", "dim", "v", "group", "least"])

    started = home.select("dim", "cell", "block", "vec_id", "v", "group").groupBy("dim", "cell", "block").cogroup(index.groupBy("dim", "cell", "block")).applyInArrow(first, "vec_id long, dim int, v binary, group long, least long")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, vs, least = b.column("dim").to_numpy(), b.column("v").to_pylist(), b.column("least").to_numpy().astype(float)
            out: list = []
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                q = as_matrix([vs[i] for i in at], dim)
                wild = norms(q) >= _HUGE
                q = np.where(wild[:, None], 0, q)
                norm = (q * q).sum(1)
                c = model.get(int(dim), (np.zeros((1, dim)), None))[0]
                d, dot = _distance(q, c), q @ c.T
                for cell, low, high, most, n in bounds.get(int(dim), []):
                    p = cell // annuli
                    gap = np.maximum(0, np.maximum(d[:, p] - high, low - d[:, p]))
                    bound = np.minimum((norm + most - gap**2) / 2, dot[:, p] + np.sqrt(norm) * high) if int(dim) in model and cell != _WILD else np.full(len(at), np.inf)
                    hit = at[wild | (bound * (1 + 1e-9) + 1e-3 + 1e-9 * (norm + most) >= least[at])]
                    out += [(int(dim), cell, j, hit) for j in range(n) if len(hit)]
            for dim, cell, j, hit in out:
                part = b.take(pa.array(hit))
                m = len(hit)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, dim, np.int32)), pa.array(np.full(m, cell, np.int64)), pa.array(np.full(m, j, np.int64)), part.column("group"), part.column("vec_id"), part.column("v"), part.column("least")], ["dim", "cell", "block", "group", "vec_id", "v", "least"])

    asked = started.mapInArrow(expand, "dim int, cell long, block long, group long, vec_id long, v binary, least long")

    def meet(key, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score", "key"]
        if not (left.num_rows and right.num_rows):
            return pa.table([*[pa.array([], pa.int64())] * 3, pa.array([], pa.float64())], names)
        dim = key[0].as_py()
        v, v_ids, q_all, ids, least = as_matrix(right["v"].to_pylist(), dim), right["vec_id"].to_numpy(), as_matrix(left["v"].to_pylist(), dim), left["vec_id"].to_numpy(), left["least"].to_numpy()
        parts = [_best(q_all[a : a + 1024], ids[a : a + 1024], v, v_ids, k, least[a : a + 1024]) for a in range(0, len(ids), 1024)]
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*parts)], names)

    keys = ["dim", "cell", "block", "group"]
    asked = scratch.keep(asked, "asked")
    wanted = asked.select(*keys[:3], F.col("group").alias("to")).distinct()
    sides = index.join(wanted, keys[:3])  # a block goes only to the groups that ask for it
    found = asked.groupBy(*keys).cogroup(sides.groupBy(*keys[:3], "to")).applyInArrow(meet, "query_id long, vec_id long, score long, key double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("key"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_pivot_search(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 100 == 0)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score
      FROM v q JOIN v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id AND len(q.e) = len(v.e))
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
