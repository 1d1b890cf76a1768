"""Hard-negative mining by a norm-bucketed search.

Candidates are sorted by falling norm and cut into buckets of `bucket_rows`; a lane is a run of `lane_buckets` buckets. By
Cauchy and Schwarz no score of anchor a in a bucket passes |a| times the bucket's largest norm, so a bucket is left out once
that is under the least score that can still count: for positives the k-th best so far, for the negatives of a window the
larger of the window's lower limit and the k-th best so far. The first lane is searched for all anchors and gives k-th
scores to begin with; an anchor is then sent to the lanes that it may need, a prefix of the order by norm, and within a lane
the scores rise on from bucket to bucket. So the result is exact, and whole lanes are met by whole groups of anchors, in blocks.

Of rows with the same label and vector only the first by id, as many as can be among anyone's best, are candidates.

Defined cases: rows with a null id or label, or a vector that is null, empty or holds null or non-finite components, take no
part; of repeated ids the row with the least label and vector counts; vectors of different lengths never meet; ties
go to the smaller id; an anchor without positives has no rows, a positive of negative score has an empty window; fewer
candidates give fewer rows; other columns of the table are not looked at. Scores are 64-bit integers, ends of their range where
the product lies outside of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.ordering import numbered

from ._stage import Scratch
from ._vectors import as_matrix, norms, one_of_each, products, quantised

_LOWEST = -(2**63)
_ASKED = "anchor_id long, label long, dim int, v binary, windows array<struct<window:int,low:bigint,high:bigint>>, group long, lane long"
_FOUND = "anchor_id long, label long, window int, other_id long, score long, key double"


def _first_copies(rows: DataFrame, most: int) -> DataFrame:
    """Of each label and vector the `most` rows of smallest id; by salted parts first, as one vector may be most of all rows."""
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(256))
    for keys in (["label", "dim", "v", salt], ["label", "dim", "v"]):
        rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id"))).where(F.col("place") <= most).drop("place")
    return rows


def _with_norms(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, vs, n = b.column("dim").to_numpy(), b.column("v").to_pylist(), np.zeros(b.num_rows)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                n[at] = norms(as_matrix([vs[k] for k in at], int(dim)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n)], [*b.schema.names, "norm"])

    return rows.mapInArrow(run, "vec_id long, dim int, v binary, label long, norm double")


class _Best:
    """The k best (score, key, id) of one window so far."""

    def __init__(self, k: int, low: int, high: int):
        self.k, self.low, self.high = k, low, high
        self.score, self.key, self.ids = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """The least score that can still count; equal ones can, by their ids."""
        return max(self.low, int(self.score[-1])) if len(self.score) == self.k else self.low

    def add(self, score: np.ndarray, key: np.ndarray | None, ids: np.ndarray) -> None:
        ok = np.flatnonzero((score >= self.least) & (score <= self.high))
        if len(ok) > 4 * self.k:  # only what reaches the k-th of these, ties with it included
            ok = ok[score[ok] >= np.partition(score[ok], len(ok) - self.k)[len(ok) - self.k]]
        if len(ok):
            s, i = np.concatenate([self.score, score[ok]]), np.concatenate([self.ids, ids[ok]])
            f = np.concatenate([self.key, np.zeros(len(ok)) if key is None else key[ok]])
            order = np.lexsort((i, -f, -s))[: self.k]
            self.score, self.key, self.ids = s[order], f[order], i[order]


def _search_lane(asked: pa.Table, lane: pa.Table, dim: int, k: int, same: bool, block: int = 256) -> pa.Table:
    """The best of one lane for each window of the anchors."""
    order = np.lexsort((lane["vec_id"].to_numpy(), lane["bucket"].to_numpy()))
    lane = lane.take(pa.array(order))
    v, ids, labels = as_matrix(lane["v"].to_pylist(), dim), lane["vec_id"].to_numpy(), lane["label"].to_numpy()
    size = norms(v)
    cuts = [0, *(np.flatnonzero(np.diff(lane["bucket"].to_numpy())) + 1), len(ids)]
    a_ids, a_labels, a = asked["anchor_id"].to_numpy(), asked["label"].to_numpy(), as_matrix(asked["v"].to_pylist(), dim)
    reach = norms(a)
    best = [[(w["window"], _Best(k, w["low"], w["high"])) for w in windows] for windows in asked["windows"].to_pylist()]
    for lo in range(0, len(a_ids), block):
        rows = np.arange(lo, min(lo + block, len(a_ids)))
        for begin, end in zip(cuts, cuts[1:]):
            bound = reach[rows] * size[begin:end].max() * (1 + 1e-9) + 1
            rows = rows[~(bound < [min(float(b.least) for _, b in best[i]) for i in rows])]  # the buckets' norms fall, so what is out stays out
            if not len(rows):
                break
            score, key = products(a[rows], v[begin:end])
            for n, i in enumerate(rows):
                fit = np.flatnonzero((labels[begin:end] == a_labels[i]) == same)
                fit = fit[ids[begin:end][fit] != a_ids[i]]
                for _, b in best[i]:
                    b.add(score[n, fit], None if key is None else key[n, fit], ids[begin:end][fit])
    found = [(a_ids[i], a_labels[i], w, b) for i in range(len(a_ids)) for w, b in best[i] if len(b.ids)]
    column = lambda x: pa.array(np.concatenate(x)) if found else pa.array([], pa.int64())
    spread = lambda at, kind: column([np.full(len(f[3].ids), f[at], kind) for f in found]).cast(pa.int64() if kind is np.int64 else pa.int32())
    return pa.table([spread(0, np.int64), spread(1, np.int64), spread(2, np.int32), column([f[3].ids for f in found]), column([f[3].score for f in found]), column([f[3].key for f in found]).cast(pa.float64())], ["anchor_id", "label", "window", "other_id", "score", "key"])


class NormIndex:
    """Candidates by falling norm, in buckets and lanes, for each vector length.

    One number a lane (its largest norm) and vector length is collected: 8 bytes for lane_buckets * bucket_rows rows."""

    def __init__(self, rows: DataFrame, scratch: Scratch, bucket_rows: int, lane_buckets: int):
        ranked = numbered(rows, ["dim", F.desc("norm"), "vec_id"], "at")
        first = ranked.groupBy("dim").agg(F.min("at").alias("first"))
        place = (F.col("at") - F.col("first")).cast("long")
        cut = ranked.join(F.broadcast(first) if first.count() < 10_000 else first, "dim").withColumn("bucket", F.floor(place / bucket_rows)).withColumn("lane", F.floor(place / (bucket_rows * lane_buckets)))
        self.rows = scratch.keep(cut.select("dim", "lane", "bucket", "vec_id", "label", "v", "norm"), "index")
        self.scratch = scratch
        self.largest: dict[int, np.ndarray] = {}
        for r in self.rows.groupBy("dim", "lane").agg(F.max("norm").alias("norm")).orderBy("dim", "lane").collect():
            self.largest[r.dim] = np.append(self.largest.get(r.dim, np.zeros(0)), r.norm)

    def _meet(self, asked: DataFrame, k: int, same: bool) -> DataFrame:
        """asked: `_ASKED`. Each lane goes only to the groups of anchors that ask for it."""

        def tile(key, left: pa.Table, right: pa.Table) -> pa.Table:
            return _search_lane(left, right, key[0].as_py(), k, same)

        keys = ["dim", "lane", "group"]
        asked = self.scratch.keep(asked, "asked")
        wanted = asked.select("dim", "lane", F.col("group").alias("to")).distinct()
        sent = self.rows.join(wanted, ["dim", "lane"]).select("dim", "lane", "to", "bucket", "vec_id", "label", "v")
        return asked.groupBy(*keys).cogroup(sent.groupBy("dim", "lane", "to")).applyInArrow(tile, _FOUND)

    def search(self, anchors: DataFrame, windows: DataFrame, k: int, same: bool, anchor_rows: int) -> DataFrame:
        """The k best, of the anchor's label if `same` and else of the others, for each row of `windows` (anchor_id,
        window, low, high) of the anchors (anchor_id, label, dim, v). Columns of `_FOUND`, and rank."""
        group = F.pmod(F.xxhash64("anchor_id"), F.lit(max(1, -(-anchors.count() // anchor_rows))))

        def asking(windows: DataFrame) -> DataFrame:
            lists = windows.groupBy("anchor_id").agg(F.collect_list(F.struct("window", "low", "high")).alias("windows"))
            return anchors.join(lists, "anchor_id").select("anchor_id", "label", "dim", "v", "windows", group.alias("group"))

        began = self.scratch.keep(self._meet(asking(windows).withColumn("lane", F.lit(0).cast("long")), k, same), "first-lane")
        least = began.groupBy("anchor_id", "window").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
        low = F.when(F.col("n") >= k, F.greatest("low", "least")).otherwise(F.col("low"))
        known = asking(windows.join(least, ["anchor_id", "window"], "left").withColumn("low", low))
        largest = self.largest

        def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Each anchor once for each further lane that one of its windows may need."""
            for b in batches:
                dims, vs = b.column("dim").to_numpy(), b.column("v").to_pylist()
                low = [min(float(w["low"]) for w in x) for x in b.column("windows").to_pylist()]
                for i in range(b.num_rows):
                    dim = int(dims[i])
                    bound = norms(as_matrix([vs[i]], dim))[0] * largest[dim][1:] * (1 + 1e-9) + 1
                    lanes = np.flatnonzero(~(bound < low[i])) + 1
                    part = b.take(pa.array(np.full(len(lanes), i)))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lanes)], [*b.schema.names, "lane"])

        found = began.union(self._meet(known.mapInArrow(reach, _ASKED), k, same))
        order = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), F.desc("key"), "other_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor, id_col: str = "vec_id", vector: str = "embedding", label: Column | str = "label", scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, bucket_rows: int = 512, lane_buckets: int = 32, anchor_rows: int = 8192) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score: for each anchor (where `is_anchor` of the id holds) and
    each of its `positives` best rows of the same label, the `negatives` best rows of other labels whose score is from
    `low` to `high` percent of the positive's. Memory of a task: a lane and a group of anchors with their windows."""
    scratch = Scratch(vectors.sparkSession, "hard-negatives")
    name = "label" if isinstance(label, str) else "label_of_row"
    given = vectors.withColumn(name, (F.col(f"`{label}`") if isinstance(label, str) else label).cast("long")).where(F.col(name).isNotNull())
    rows = quantised(given, id_col, vector, scale, keep=(name,)).withColumnRenamed(name, "label")
    rows = scratch.keep(_with_norms(one_of_each(rows, "label").select("vec_id", "dim", "v", "label")), "rows")
    index = NormIndex(_first_copies(rows, max(positives, negatives) + 1), scratch, bucket_rows, lane_buckets)
    anchors = rows.where(is_anchor(F.col("vec_id"))).select(F.col("vec_id").alias("anchor_id"), "label", "dim", "v")

    whole = anchors.select("anchor_id", F.lit(0).alias("window"), F.lit(_LOWEST).alias("low"), F.lit(2**63 - 1).alias("high"))
    best = index.search(anchors, whole, positives, True, anchor_rows)
    best = scratch.keep(best.select("anchor_id", F.col("rank").alias("window"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # ceil and floor of the windows' ends, in decimals as 90 times a score may pass 64 bits
    end = lambda percent, f: f(F.col("positive_score").cast("decimal(19,0)") * percent / 100).cast("long")
    windows = best.select("anchor_id", "window", end(low, F.ceil).alias("low"), end(high, F.floor).alias("high")).where("low <= high")
    found = index.search(anchors, windows, negatives, False, anchor_rows)
    return found.join(best, ["anchor_id", "window"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 100 == 0, label=moved)


ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
           FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, list_inner_product(a.e, v.e)::BIGINT AS score
      FROM v a JOIN v ON a.vec_id % 100 = 0 AND v.vec_id <> a.vec_id AND len(a.e) = len(v.e)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score
      FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE same) WHERE n <= 5),
w AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM w WHERE rank <= 10
"""
