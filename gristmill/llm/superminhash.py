"""Near-duplicate classes by SuperMinHash.

Each element of a document's shingle set draws one permutation of the registers; its rank in register p(j) is j plus a
random fraction, and each register keeps the least rank. As ranks of round j are at or over j, a document stops after the
first round that leaves all its registers under the next round's ranks: a few rounds for most documents. Documents with
equal sets are one class from the start. Bands of registers give buckets of class representatives; links inside the
buckets are confirmed on the full shingle sets, and union-find by min-label passes with pointer jumping groups them.

Pairs inside a bucket are not all compared. Each member is first compared with the centre of its buckets that the most
others meet, its reference, then with the likeliest centre of another label; members that bear one label need no further
pair, as nothing more can be learned from it. Of the pairs of different labels that two bands support, a common reference
rules most out: without a shared element outside of it, two sets cannot be closer than the farther is to the reference.
All the others are confirmed. So no link is lost that two bands support: with 32 bands of 4, a pair at 80 % shares fewer
than two with a chance of about 1e-6.

Defined cases: null texts and texts without words have an empty set and are linked with nothing; fewer words than a
shingle has give the whole sequence as one shingle; rows with a null id are alone (component null, kept); rows equal in
id belong together; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._stage import Scratch
from ._text import flat, mix, slices, windows, word_hashes

_LOW32 = np.uint64(0xFFFFFFFF)
_FULL = np.uint64(2**63)
_BIT_WORDS = 8
_BITS = [f"w{k}" for k in range(_BIT_WORDS)]


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, sorted by row and hash, and each row's offset."""
    data, offsets = flat(texts)
    n = len(offsets) - 1
    words, rows = word_hashes(data, offsets)
    counts = np.bincount(rows, minlength=n) if len(rows) else np.zeros(n, np.int64)
    h, at = windows(words, rows, size)
    r = rows[at]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        first = np.searchsorted(rows, short)
        acc = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = counts[short] > k
            acc[has] = mix(acc[has] + words[first[has] + k])
        h, r = np.concatenate([h, mix(acc + counts[short].astype(np.uint64))]), np.concatenate([r, short])
    order = np.argsort(h)
    order = order[np.argsort(r[order].astype(np.uint16 if n < 65536 else np.int64), kind="stable")]
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, r = h[new], r[new]
    return h, np.searchsorted(r, np.arange(n + 1))


def signatures(h: np.ndarray, offsets: np.ndarray, registers: int) -> np.ndarray:
    """Registers of each row's set of hashes, as round * 2**32 + fraction."""
    n, m = len(offsets) - 1, registers
    out = np.full((n, m), _FULL)
    flat_out = out.reshape(-1)

    def draw(x: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
        rnd = mix(x + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2**64))
        return (((rnd >> np.uint64(32)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int64) + j, rnd & _LOW32

    def put(row: np.ndarray, register: np.ndarray, j: int, fraction: np.ndarray) -> None:
        np.minimum.at(flat_out, row * m + register, np.uint64(j << 32) + fraction)

    rows = np.repeat(np.arange(n), np.diff(offsets))
    first, fraction = draw(h, 0)
    put(rows, first, 0, fraction)
    live = (out.max(1) >= np.uint64(1 << 32))[rows] if m > 1 else np.zeros(len(rows), bool)
    h, rows, first = h[live], rows[live], first[live]
    if not len(h):
        return out
    second, fraction = draw(h, 1)
    put(rows, np.where(second == first, 0, second), 1, fraction)
    live = (out.max(1) >= np.uint64(2 << 32))[rows]
    h, rows = h[live], rows[live]
    for a in _runs(rows, 60_000):  # few elements are left; those of one row stay together unless the row is longer
        _rest(h[a], rows[a], out, draw, put, m)
    return out


def _runs(rows: np.ndarray, most: int) -> Iterator[slice]:
    a = 0
    while a < len(rows):
        b = min(a + most, len(rows))
        if b < len(rows):
            edge = int(np.searchsorted(rows, rows[b]))
            b = edge if edge > a else int(np.searchsorted(rows, rows[a], "right"))
        yield slice(a, b)
        a = b


def _rest(h, rows, out, draw, put, m) -> None:
    """Rounds 2 and up, with each element's permutation written out."""
    p = np.tile(np.arange(m, dtype=np.uint16), (len(h), 1))
    for j in range(m):
        k, fraction = draw(h, j)
        e = np.arange(len(h))
        chosen = p[e, k]
        p[e, k], p[:, j] = p[:, j].copy(), chosen
        if j >= 2:
            put(rows, chosen.astype(np.int64), j, fraction)
            live = (out[rows].max(1) if len(h) < 2000 else out.max(1)[rows]) >= np.uint64((j + 1) << 32)
            if not live.all():
                h, rows, p = h[live], rows[live], p[live]
            if not len(h):
                return


def band_keys(registers: np.ndarray, bands: int) -> np.ndarray:
    n, m = registers.shape
    parts = registers.reshape(n, bands, m // bands)
    acc = np.broadcast_to(np.arange(bands, dtype=np.uint64), (n, bands)).copy()
    for k in range(m // bands):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return acc


def _signed(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for whole in slices(batch, "text"):
                for a in range(0, whole.num_rows, 4096):
                    part = whole.slice(a, 4096)
                    h, offsets = shingle_sets(part.column("text"), size)
                    n = np.diff(offsets)
                    keys = band_keys(signatures(h, offsets, bands * rows), bands)[n > 0].astype(np.int64) if len(h) else np.zeros(0, np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum((n > 0) * bands)]), pa.int32()), pa.array(keys.reshape(-1)))
                    total = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(s)), dtype=np.uint64)]) for s in (1, 2)]
                    prints = [(t[offsets[1:]] - t[offsets[:-1]]).astype(np.int64) for t in total]
                    yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n.astype(np.int64)), *map(pa.array, prints), lists], ["id", "n", "f1", "f2", "bands"])

    return docs.mapInArrow(run, "id long, n long, f1 long, f2 long, bands array<long>")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                h, offsets = shingle_sets(part.column("text"), size)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("id"), lists], ["id", "elements"])

    return docs.mapInArrow(run, "id long, elements array<long>")


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """For pairs (a, b), on the full sets: common, linked (100 * intersection >= percent * union), and a's elements
    outside b, with a bit map of them."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("elements").alias("of_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("elements").alias("of_b")), "b")
    common = F.size(F.array_intersect("of_a", "of_b"))
    both = both.select("a", "b", common.cast("long").alias("common"), (F.size("of_a") + F.size("of_b")).alias("sizes"), F.array_except("of_a", "of_b").alias("outside"))

    def word(k: int):
        def put(acc, x):
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))
            return F.when(F.shiftrightunsigned(x, 6).bitwiseAND(F.lit(_BIT_WORDS - 1)) == k, acc.bitwiseOR(bit)).otherwise(acc)

        return F.aggregate("outside", F.lit(0).cast("long"), put).alias(_BITS[k])

    return both.select("a", "b", "common", (100 * F.col("common") >= percent * (F.col("sizes") - F.col("common"))).alias("linked"), "outside", *map(word, range(_BIT_WORDS)))


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(id, label) of all ids in edges (a, b): the least id that can be reached. One written table a pass."""
    both = scratch.keep(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = scratch.keep(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "id"), "labels")
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("label").alias("near"))
        low = labels.join(near, labels.id == near.a, "left").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        roots = labels.select(F.col("id").alias("root"), F.col("label").alias("above"))
        new = scratch.keep(low.join(roots, F.col("label") == F.col("root"), "left").select("id", "old", F.least("label", "above").alias("label")), "labels")
        changed = new.where("old <> label").limit(1).count()
        labels = new.select("id", "label")
        if not changed:
            return labels


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80, bands: int = 32, band_rows: int = 4) -> DataFrame:
    """id_col, n_shingles, component_id and kept of each document."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "superminhash")
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    signed = scratch.keep(_signed(source, shingle, bands, band_rows), "signed")
    print_of = ["n", "f1", "f2"]
    same = scratch.keep(signed.where("n > 0 and id is not null").groupBy(*print_of).agg(F.min("id").alias("rep")), "same")

    reps = scratch.keep(signed.join(same, print_of).where("id = rep").select("id", "n", "bands").dropDuplicates(["id"]), "reps")
    posts = reps.select("id", "n", F.explode("bands").alias("band"))
    shared = posts.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    posts = scratch.keep(posts.join(shared, "band"), "posts")
    of_doc = scratch.keep(posts.groupBy("id").agg(F.count(F.lit(1)).alias("bands"), F.sum("members").alias("fame")).where("bands > 1"), "of_doc")
    sets = scratch.keep(_sets(source.join(of_doc.select("id"), "id", "left_semi"), shingle).dropDuplicates(["id"]), "sets")

    # Each document against the best known member of its buckets, which stays its reference.
    famed = scratch.keep(posts.select("id", "n", "band").join(of_doc.select("id", "fame"), "id"), "famed")
    centres = famed.groupBy("band").agg(F.max(F.struct("fame", F.negate("id").alias("o"))).alias("c")).select("band", F.negate("c.o").alias("other"), F.col("c.fame").alias("other_fame"))
    tried = famed.join(centres, "band").groupBy("id", "other").agg(F.count(F.lit(1)).alias("bands"), F.first("other_fame").alias("fame")).where("bands > 1")
    tried = tried.groupBy("id").agg(F.max(F.struct("fame", "bands", F.negate("other").alias("o"))).alias("m")).select(F.col("id").alias("a"), F.negate("m.o").alias("b"))
    first = scratch.keep(_compared(tried, sets, percent), "referred")
    edges = scratch.keep(first.where("linked and a <> b").select("a", "b"), "links")
    labels = components(scratch, edges)

    def marked(columns: list[str]) -> DataFrame:
        """Posts with their labels, of the buckets in which more than one label is left."""
        known = famed.join(labels.select(F.col("id").alias("_id"), F.col("label").alias("_label")), F.col("id") == F.col("_id"), "left").select("id", "n", "band", "fame", F.coalesce("_label", "id").alias("label"))
        open_ = known.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("band")
        return known.join(open_, "band").select(*columns)

    # Those of other labels than their likeliest centre, against it.
    posts = scratch.keep(marked(["id", "n", "band", "fame", "label"]), "marked")
    centres = posts.groupBy("band").agg(F.max(F.struct("fame", F.negate("id").alias("o"), "n", "label")).alias("c"))
    centres = centres.select("band", F.negate("c.o").alias("other"), F.col("c.n").alias("other_n"), F.col("c.label").alias("other_label"))
    alike = (100 * F.least("n", "other_n") >= percent * F.greatest("n", "other_n")) & (F.col("label") != F.col("other_label"))
    pairs = posts.join(centres, "band").where(alike).groupBy("id", "other").agg(F.count(F.lit(1)).alias("bands")).where("bands > 1")
    pairs = pairs.join(first.select(F.col("a").alias("id"), F.col("b").alias("other")), ["id", "other"], "left_anti")
    pairs = pairs.groupBy("id").agg(F.max(F.struct("bands", F.negate("other").alias("o"))).alias("m")).select(F.col("id").alias("a"), F.negate("m.o").alias("b"))
    second = scratch.keep(_compared(pairs, sets, percent).select("a", "b", "linked"), "seconds")
    edges = scratch.keep(edges.union(second.where("linked").select("a", "b")), "links")
    labels = components(scratch, edges)

    # All pairs of different labels that their common reference does not rule out: what two sets share lies in the
    # reference, at most the lesser of their shares in it, or is shared outside of it. One without a reference, as no
    # centre meets it in two buckets, rules nothing out.
    refer = first.select(F.col("a").alias("id"), F.col("b").alias("ref"), "common", "outside", *_BITS)
    posts = scratch.keep(marked(["id", "n", "band", "label"]).join(refer, "id", "left"), "marked")
    other = posts.select("band", *[F.col(c).alias(f"other_{c}") for c in ("id", "n", "label", "ref", "common", "outside", *_BITS)])
    hits = sum((F.bit_count(F.col(w).bitwiseAND(F.col(f"other_{w}"))) for w in _BITS[1:]), F.bit_count(F.col(_BITS[0]).bitwiseAND(F.col(f"other_{_BITS[0]}"))))

    def lost(prefix: str):
        """Elements outside that share their bit with another."""
        return F.size(f"{prefix}outside") - sum((F.bit_count(f"{prefix}{w}") for w in _BITS[1:]), F.bit_count(f"{prefix}{_BITS[0]}"))

    def reach(beyond):
        most = F.least("common", "other_common") + beyond
        return 100 * most >= percent * (F.col("n") + F.col("other_n") - most)

    open_ = F.coalesce(F.col("ref") != F.col("other_ref"), F.lit(True)) | (reach(hits + F.least(lost(""), lost("other_"))) & reach(F.size(F.array_intersect("outside", "other_outside"))))
    pairs = posts.join(other, "band").where(alike & (F.col("id") < F.col("other_id")) & open_)
    pairs = pairs.groupBy(F.col("id").alias("a"), F.col("other_id").alias("b")).agg(F.count(F.lit(1)).alias("bands")).where("bands > 1").select("a", "b")
    third = _compared(pairs, sets, percent).where("linked").select("a", "b")
    labels = components(scratch, scratch.keep(edges.union(third), "links"))

    named = signed.select("id", *print_of).join(same, print_of, "left")
    named = named.join(labels.select(F.col("id").alias("_id"), "label"), F.col("rep") == F.col("_id"), "left")
    label = F.when(F.col("id").isNotNull(), F.coalesce("label", "rep", "id"))
    return named.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), label.alias("component_id"), F.coalesce(F.col("id") == label, F.lit(True)).alias("kept"))


def op9_superminhash(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
             ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
ee AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS x, doc_id AS label FROM w UNION SELECT ee.y, r.label FROM r JOIN ee ON ee.x = r.x),
l AS (SELECT x, min(label) AS label FROM r GROUP BY 1)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, label AS component_id, doc_id = label AS kept
FROM w JOIN l ON l.x = doc_id LEFT JOIN n USING (doc_id)
"""
