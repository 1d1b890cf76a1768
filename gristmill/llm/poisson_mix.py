"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

Each source has a mean repetition rate: its target share of the output over its share of the input. A uniform number from
a seeded hash of the document's id is put through the inverse Poisson distribution of that rate; the document appears
that many times; and all copies are put in the order of a second seeded hash. A rate over MOST is split into equal parts of
at most MOST, each with a draw of its own: their sum has the distribution of the whole rate, each inverted table stays
short, and the work grows with the copies alone.

Defined cases: a null source is a source of its own; rows of equal id draw alike, a null id draws like any other value;
an empty table gives no rows; a source of weight 0 disappears; null texts are copied as they are; the added columns are
renamed if they clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._stage import Scratch, fresh, partitions

_NONE = "\0none"
#: The largest rate of one draw; its distribution has about 190 steps.
MOST = 64


def _uniform(*parts: Column) -> Column:
    """48 bits of an MD5 as a number in [0, 1)."""
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)


def rates(docs: DataFrame, source: str, weights: dict | None, alpha: float, size: float) -> DataFrame:
    """(key, documents, rate, draws, cdf) of each source; cdf is that of rate / draws. Without weights, targets are the shares to the power alpha."""
    key = F.coalesce(F.col(f"`{source}`").cast("string"), F.lit(_NONE)).alias("key")
    counts = docs.select(key).groupBy("key").agg(F.count(F.lit(1)).alias("documents"))
    if weights is None:
        target = F.pow(F.col("documents").cast("double"), F.lit(alpha))
    else:
        named = F.create_map(*[x for k, w in weights.items() for x in (F.lit(_NONE if k is None else k), F.lit(float(w)))])
        target = F.coalesce(named[F.col("key")], F.lit(0.0))
    counts = counts.withColumn("target", target)
    total = counts.agg(F.sum("documents").alias("all_documents"), F.sum(F.round("target", 9)).alias("all_targets"))  # one row
    rate = F.col("target") / F.col("all_targets") * F.col("all_documents") * size / F.col("documents")
    rated = counts.join(total, how="cross").select("key", "documents", rate.alias("rate"))
    rated = rated.where("rate > 0").withColumn("draws", F.ceil(F.col("rate") / MOST).cast("int")).withColumn("part", F.col("rate") / F.col("draws"))
    part = F.col("part")
    last = F.ceil(part + 12 * F.sqrt(part) + 30).cast("int")
    start = F.struct(F.exp(-part).alias("p"), F.exp(-part).alias("upto"), F.array(F.exp(-part)).alias("cdf"))

    def step(acc, k):
        p = acc["p"] * part / k
        return F.struct(p.alias("p"), (acc["upto"] + p).alias("upto"), F.array_append(acc["cdf"], acc["upto"] + p).alias("cdf"))

    def scaled(acc):  # the last step is one
        return F.transform(acc["cdf"], lambda c: c / acc["upto"])

    return rated.select("key", "documents", "rate", "draws", F.aggregate(F.sequence(F.lit(1), last), start, step, scaled).alias("cdf"))


def mix(docs: DataFrame, id_col: str = "doc_id", source: str = "source", weights: dict | None = None, alpha: float = 0.5, size: float = 1.0, seed: int = 17, marks: bool = True) -> DataFrame:
    """Copies of docs in a global random order and, if marks, copy (from 1) and shuffle_key.

    The rates are written first, so that the planner knows their size: few sources are broadcast, many are joined with
    the sides' hot keys split. Documents leave their partition once, for the global order."""
    scratch = Scratch(docs.sparkSession, "poisson-mix")
    key, cdf, draws, us, n = (fresh(docs.columns, c) for c in ("mix_key", "mix_cdf", "mix_draws", "mix_uniform", "mix_copies"))
    known = scratch.keep(rates(docs, source, weights, alpha, size), "rates").select(F.col("key").alias(key), F.col("draws").alias(draws), F.col("cdf").alias(cdf))
    copy, order = fresh(docs.columns, "copy"), fresh(docs.columns, "shuffle_key")
    ident = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(_NONE))
    joined = docs.join(known, F.coalesce(F.col(f"`{source}`").cast("string"), F.lit(_NONE)) == F.col(key))
    first, name = F.array(_uniform(F.lit(f"{seed}"), ident)), F.concat_ws(":", F.lit(f"{seed}"), ident)
    more = F.transform(F.sequence(F.lit(1), F.col(draws) - 1), lambda k: _uniform(name, k.cast("string")))
    drawn = joined.withColumn(us, F.when(F.col(draws) > 1, F.concat(first, more)).otherwise(first))
    many = F.aggregate(us, F.lit(0), lambda total, u: total + F.size(F.filter(cdf, lambda c: c <= u)))
    copies = drawn.withColumn(n, many).where(F.col(n) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n))))
    keyed = copies.withColumn(order, F.md5(F.concat_ws(":", F.lit(f"{seed} order"), ident, F.col(copy).cast("string")).cast("binary")))
    # The key is uniform, so its first digits place a row; a sampling sort would draw twice.
    parts = partitions(docs)
    place = F.floor(F.conv(F.substring(order, 1, 8), 16, 10).cast("double") * parts / float(1 << 32)).cast("int")
    out = keyed.select(*[F.col(f"`{c}`") for c in docs.columns], copy, order).repartitionById(parts, place).sortWithinPartitions(order)
    return out if marks else out.drop(copy, order)


def op6_poisson_mix(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_CTES = r"""
mc AS (SELECT coalesce(source, chr(0) || 'none') AS key, count(*) AS documents FROM {docs} GROUP BY 1),
ma AS (SELECT sum(documents) AS n, sum(round(pow(documents, 0.5), 9)) AS t FROM mc),
mr AS (SELECT key, pow(documents, 0.5) / t * n / documents AS rate FROM mc, ma),
md AS (SELECT key, ceil(rate / 64)::INT AS draws, rate / ceil(rate / 64) AS part FROM mr WHERE rate > 0),
mk AS (SELECT key, draws, part, unnest(generate_series(0, ceil(part + 12 * sqrt(part) + 30)::INT)) AS k FROM md),
mp AS (SELECT key, draws, k, exp(-part + k * ln(part) - lgamma(k + 1)) AS p FROM mk),
mf AS (SELECT key, draws, list(c ORDER BY k) AS cdf FROM (SELECT key, draws, k, sum(p) OVER (PARTITION BY key ORDER BY k) AS c FROM mp) GROUP BY 1, 2),
mu AS (SELECT d.*, list_transform(generate_series(0, draws - 1), lambda k: ('0x' || md5('17:' || doc_id || CASE WHEN k > 0 THEN ':' || k ELSE '' END)[:12])::BIGINT / 281474976710656.0) AS us, cdf
  FROM {docs} d JOIN mf ON mf.key = coalesce(source, chr(0) || 'none')),
mx AS (SELECT * EXCLUDE (us, cdf), unnest(generate_series(1, list_sum(list_transform(us, lambda u: len(list_filter(cdf, lambda c: c <= u))))::BIGINT))::INT AS copy FROM mu)
"""
ORACLE = "WITH " + ORACLE_CTES.format(docs="documents") + "SELECT *, md5('17 order:' || doc_id || ':' || copy) AS shuffle_key FROM mx"
