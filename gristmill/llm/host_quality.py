"""Quality rules judged by host.

Each document is measured once; failures of the rules are summed by host; each host's failure rate is shrunk towards
the mean of all hosts with a beta prior that is fitted to the hosts themselves (method of moments); a host whose shrunk
rate is over `max_host_rate` is rejected, and its verdict is joined back to its documents.

Defined cases: a null or blank text has no words and fails; a null host has no verdict, so only the document's own rules
count; no host has a verdict in an empty table; equal rows are judged alike; a column of the input that is called like
one of the results is kept under its own name, and the results are in one struct column, renamed if it clashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._stage import Scratch, fresh
from ._text import RAW, SPACE, flat, mix, per_row, prefix_hash, slices, span_hash, spans, windows

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True


def measure(texts: pa.Array, window: int = 8) -> np.ndarray:
    """MEASURES of each text, as rows of one array."""
    data, offsets = flat(texts)
    n = len(offsets) - 1
    out = np.zeros((n, 5), np.int64)
    if not len(data):
        return out
    starts, ends, rows = spans(data, offsets)
    out[:, 0] = np.bincount(rows, minlength=n)
    out[:, 1] = per_row(~SPACE[data] & ((data & 0xC0) != 0x80), offsets)
    out[:, 2] = per_row(_SYMBOL[data], offsets)
    prefix = prefix_hash(data, RAW)
    words = span_hash(prefix, starts, ends)

    a, b, r = spans(data, offsets, _NEWLINE)
    k = np.searchsorted(starts, a)
    full = (k < len(starts)) & (starts[np.minimum(k, len(starts) - 1)] < b) if len(starts) else np.zeros(len(a), bool)
    a, b, r = a[full], b[full], r[full]
    key = np.sort(mix(span_hash(prefix, a, b) + mix(r.astype(np.uint64) + np.uint64(1))))
    distinct = np.bincount(r, minlength=n)  # lines with a word; the distinct ones are taken off below
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    if not first.all():
        pairs = np.unique(np.stack([r.astype(np.uint64), span_hash(prefix, a, b)]), axis=1)
        out[:, 3] = distinct - np.bincount(pairs[0].astype(np.int64), minlength=n)

    seen, at = windows(words, rows, window)
    if len(at):
        key = mix(seen + mix(rows[at].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key, kind="stable")
        same = np.zeros(len(key), bool)
        eq = key[order][1:] == key[order][:-1]
        same[1:] |= eq
        same[:-1] |= eq
        hit = at[order[same]]
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + window, -1)
        out[:, 4] = np.bincount(rows[np.cumsum(edge[:-1]) > 0], minlength=n)
    return out


def failed(m: dict, min_words: int, max_repeat_percent: int):
    """The document's own rules, over anything that compares like numbers."""
    return (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > max_repeat_percent * m["n_words"])


def measured(docs: DataFrame, text: str, keep: list[str], result: str = "measures") -> DataFrame:
    """The columns `keep` and one struct of MEASURES for each document; whole texts, one pass, no shuffle."""
    source = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text])])
    schema = T.StructType([*source.select(*[F.col(f"`{c}`") for c in keep]).schema.fields, T.StructField(result, T.StructType([T.StructField(c, T.LongType(), False) for c in MEASURES]), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                m = measure(part.column(text))
                struct = pa.StructArray.from_arrays([pa.array(m[:, i]) for i in range(5)], list(MEASURES))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), struct], [*keep, result])

    return source.mapInArrow(run, schema)


def host_verdicts(judged: DataFrame, host: str, bad: str, max_host_rate: float = 0.5) -> DataFrame:
    """One row a host: documents, failures, shrunk_rate and rejected.

    The prior's mean and strength come from the hosts' rates: strength = mean * (1 - mean) / variance - 1, at least 1;
    hosts that do not differ at all give the largest strength, 1e6.
    """
    hosts = judged.where(F.col(host).isNotNull()).groupBy(host).agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col(bad).cast("long")).alias("failures"))
    rate = F.col("failures") / F.col("documents")
    prior = hosts.agg(F.avg(rate).alias("mean"), F.var_pop(rate).alias("variance"))
    strength = F.when(F.col("variance") <= F.col("mean") * (1 - F.col("mean")) / 1e6, F.lit(1e6)).otherwise(F.greatest(F.lit(1.0), F.col("mean") * (1 - F.col("mean")) / F.col("variance") - 1))
    prior = prior.select("mean", strength.alias("strength"))
    shrunk = (F.col("failures") + F.col("mean") * F.col("strength")) / (F.col("documents") + F.col("strength"))
    # One row against the hosts: the aggregate above has no keys.
    return hosts.join(prior, how="cross").select(host, "documents", "failures", shrunk.alias("shrunk_rate"), (shrunk > max_host_rate).alias("rejected"))


def judge(docs: DataFrame, text: str = "text", host: str = "source", keep: list[str] | None = None, min_words: int = 20, max_repeat_percent: int = 30, max_host_rate: float = 0.5, result: str = "quality") -> DataFrame:
    """The columns `keep` (all, if None) and a struct: MEASURES, base_failed, host_rate, host_rejected, kept.

    The rates need one pass over the texts of which only counts by host leave the executors; the verdicts are written, so
    that their size is known to the planner when it joins them. If only narrow columns are kept, the measures are written
    too and texts are read once; else they are measured again on the second pass, which is cheaper than to move texts.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "host-quality")
    keep = docs.columns if keep is None else keep
    result = fresh(docs.columns, result)
    narrow = text not in keep
    h = fresh([*docs.columns, result], "host_key")
    source = docs.withColumn(h, F.col(f"`{host}`").cast("string"))
    table = measured(source, text, [*keep, h], result)
    if narrow:
        table = scratch.keep(table, "measures")
        rows = table.select(h, result)
    else:
        rows = measured(source, text, [h], result)
    bad = failed({c: F.col(f"{result}.{c}") for c in MEASURES}, min_words, max_repeat_percent)
    verdicts = scratch.keep(host_verdicts(rows.select(h, bad.alias("bad")), h, "bad", max_host_rate), "verdicts")
    of, rate, no = (fresh([*docs.columns, result, h], c) for c in ("judged_host", "judged_rate", "judged_no"))
    v = verdicts.select(F.col(h).alias(of), F.col("shrunk_rate").alias(rate), F.col("rejected").alias(no))
    rejected = F.coalesce(no, F.lit(False))
    fields = [*(F.col(f"{result}.{c}").alias(c) for c in MEASURES), bad.alias("base_failed"), F.col(rate).alias("host_rate"), rejected.alias("host_rejected"), (~bad & ~rejected).alias("kept")]
    return table.join(v, F.col(h) == F.col(of), "left").select(*[F.col(f"`{c}`") for c in keep], F.struct(*fields).alias(result))


def op3_host_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    q = judge(docs, keep=["doc_id"])
    names = (*MEASURES, "base_failed", "kept")
    return q.select("doc_id", *[F.col(f"quality.{c}").alias(c) for c in names], F.round("quality.host_rate", 9).alias("host_rate"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, t FROM d),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS g
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
twice AS (SELECT doc_id, g FROM win GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS k FROM win JOIN twice USING (doc_id, g)) GROUP BY 1),
ln AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
m AS (SELECT d.doc_id, d.source, len(w.words)::BIGINT AS n_words, length(array_to_string(w.words, ''))::BIGINT AS word_chars,
             (length(d.t) - length(regexp_replace(d.t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
      FROM d JOIN w USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS f FROM b WHERE source IS NOT NULL GROUP BY 1),
p AS (SELECT avg(f / n) AS mu, var_pop(f / n) AS v FROM h),
s AS (SELECT mu, CASE WHEN v <= mu * (1 - mu) / 1e6 THEN 1e6 ELSE greatest(1.0, mu * (1 - mu) / v - 1) END AS k FROM p),
r AS (SELECT source, (f + mu * k) / (n + k) AS rate FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(rate > 0.5, false) AS kept, round(rate, 9) AS host_rate
FROM b LEFT JOIN r USING (source)
"""
