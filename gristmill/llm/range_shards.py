"""Shards of near equal bytes from sampled splitters.

Keys (text hash, id) are sampled with a chance in proportion to the record's size; the sample's quantiles are the
boundaries of many narrow ranges; a range that turns out overfull is divided again by a sample of its own. Exact bytes
and counts of the ranges then place each record on one line of bytes in key order, which is cut into equal pieces. Equal
texts lie side by side, yet a group of copies larger than a shard is divided by id.

Defined cases: a null text is of size 1 like an empty one; a null id orders before all others; rows equal in id and text
take neighbouring slots in any order; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._stage import Scratch, fresh, partitions

_LEAST = -(2**63)


def range_of(bounds: list[tuple[int, int]], h: np.ndarray, i: np.ndarray) -> np.ndarray:
    """For each key (h, i), how many of the sorted bounds are at or below it."""
    if not bounds:
        return np.zeros(len(h), np.int64)
    bh, bi = (np.array(x, np.int64) for x in zip(*bounds))
    lo, hi = np.searchsorted(bh, h, "left"), np.searchsorted(bh, h, "right")
    for a in np.unique(lo[lo < hi]):  # keys that share their hash with a boundary
        tied = (lo == a) & (hi > lo)
        b = hi[tied][0]
        hi[tied] = a + np.searchsorted(bi[a:b], i[tied], "right")
    return hi.astype(np.int64)


def _ranged(keys: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """Adds `range`. The boundaries go with the code: their number is bounded by the parameters of `assign`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = range_of(bounds, b.column("h").to_numpy(zero_copy_only=False), b.column("i").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(r)], [*b.schema.names, "range"])

    return keys.mapInArrow(run, "i long, size long, crc long, h long, null_id boolean, range long")


def _sample(keys: DataFrame, chance, seed: int) -> list[tuple[int, int, float]]:
    u = F.pmod(F.xxhash64("h", "i", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    return [(r.h, r.i, r.w) for r in keys.where(u < chance).select("h", "i", F.greatest(F.lit(1.0), chance).alias("w")).collect()]


def _cuts(sample: list[tuple[int, int, float]], pieces: int) -> list[tuple[int, int]]:
    """Quantile boundaries of a sample whose rows weigh w each."""
    sample.sort()
    weights = np.cumsum([w for *_, w in sample])
    if not len(weights):
        return []
    at = np.searchsorted(weights, weights[-1] * np.arange(1, pieces) / pieces)
    return sorted({sample[k][:2] for k in at})


def _placed(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text: str = "text", ranges_per_shard: int = 64, samples_per_range: int = 8, overfull: float = 2.0, rounds: int = 4) -> DataFrame:
    """Key (i, null_id, h), size, crc, shard and slot of each record.

    The driver holds at most about 2 * shards * ranges_per_shard * samples_per_range sampled keys at once.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "range-shards")
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    key = F.col(f"`{id_col}`").cast("long")
    keys = scratch.keep(docs.select(F.coalesce(key, F.lit(_LEAST)).alias("i"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body.cast("binary")).alias("crc"), F.xxhash64(body).alias("h"), key.isNull().alias("null_id")), "keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    ranges = shards * ranges_per_shard
    bounds = _cuts(_sample(keys, F.col("size") * (ranges * samples_per_range / total), 1), ranges) if total else []
    for n in range(rounds):
        ranged = _ranged(keys, bounds)
        sums = {r.range: (r.bytes, r.rows, r.most) for r in ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.max("size").alias("most")).collect()}
        heavy = {k: b for k, (b, rows, most) in sums.items() if rows > 1 and b > max(overfull * total / ranges, 2 * most)}
        if not heavy or n == rounds - 1:
            break
        pieces = {k: math.ceil(b * ranges / total) for k, b in heavy.items()}
        table = spark.createDataFrame([(k, samples_per_range * pieces[k] / b) for k, b in heavy.items()], "range long, per_byte double")
        drawn = _sample(ranged.join(table, "range"), F.col("size") * F.col("per_byte"), n + 2)
        held: dict[int, list] = {}
        for s in drawn:
            held.setdefault(int(range_of(bounds, np.array([s[0]]), np.array([s[1]]))[0]), []).append(s)
        bounds = sorted({*bounds, *(c for k, s in held.items() for c in _cuts(s, pieces[k]))})

    before, rows_before, table = 0, 0, []
    for k in sorted(sums):
        table.append((k, before, rows_before))
        before, rows_before = before + sums[k][0], rows_before + sums[k][1]
    starts = spark.createDataFrame(table, "range long, bytes_before long, rows_before long")
    w = Window.partitionBy("range").orderBy("h", "i")
    line = ranged.withColumns({"upto": F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)), "n": F.row_number().over(w)}).join(starts, "range")
    start = F.col("bytes_before") + F.col("upto") - F.col("size")
    shard = F.least(F.lit(shards - 1), F.floor(start * shards / F.lit(max(total, 1)))).cast("int")
    placed = scratch.keep(line.select("i", "null_id", "h", "size", "crc", shard.alias("shard"), (F.col("rows_before") + F.col("n") - 1).alias("row")), "placed")
    firsts = scratch.keep(placed.groupBy("shard").agg(F.min("row").alias("first_row")), "firsts")
    return placed.join(firsts, "shard").select("i", "null_id", "h", "size", "crc", "shard", (F.col("row") - F.col("first_row")).alias("slot"))


def assign(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Id, size, crc, shard and slot of each record; options are those of `_placed`."""
    return _placed(docs, shards, id_col, text, **options).select(F.when(~F.col("null_id"), F.col("i")).alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 16, id_col: str = "doc_id", text: str = "text", **options) -> None:
    """Writes each shard's records under path/<shard>=N, in the order of their slots; the columns shard and slot are
    renamed if they clash. Rows of equal id and text are numbered on both sides, so each takes a slot of its own."""
    names = {c: fresh(docs.columns, c) for c in ("shard", "slot", "key_i", "key_null", "key_h", "key_n")}
    key = [names[c] for c in ("key_i", "key_null", "key_h")]
    alike = Window.partitionBy(*key).orderBy(key[0])
    ident, body = F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.withColumns({key[0]: F.coalesce(ident, F.lit(_LEAST)), key[1]: ident.isNull(), key[2]: F.xxhash64(body)})
    placed = _placed(docs, shards, id_col, text, **options).select(F.col("i").alias(key[0]), F.col("null_id").alias(key[1]), F.col("h").alias(key[2]), F.col("shard").alias(names["shard"]), F.col("slot").alias(names["slot"]))
    key_n = [*key, names["key_n"]]
    full = rows.withColumn(key_n[-1], F.row_number().over(alike)).join(placed.withColumn(key_n[-1], F.row_number().over(alike)), key_n).drop(*key_n)
    order = [names["shard"], names["slot"]]
    full.repartitionByRange(max(shards * 4, partitions(docs)), *order).sortWithinPartitions(*order).write.partitionBy(names["shard"]).parquet(path)


def op5_range_shards(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return assign(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
