"""Line deduplication by an exact set-similarity join, in DataFrame operations only.

A line is the set of its words. Of lines that are equal but for case, the first in order of document id and line number
stands for all. Words are ordered by rarity (the corpus frequency of their hash bucket, in a table of fixed size).
The prefix filter is one on neighbours: let a be the words that only the first of two lines has, b those of the other, c those
of both. At 75 % Jaccard or more c is at least 3 (a + b), so that two common words follow each other in both lines: each pair of
common neighbours that is parted takes one of the a + b words. The first such pair begins after at most a + b common words and a
own ones, that is at place 2 a + b or before, and a line's size bounds that. So lines that match share a gram, two words next to
each other, within such a prefix (below 75 % grams are single words and the prefix is the usual one). Lines that share a gram
pass a length filter and a filter on 128-bit parity maps (their Hamming distance never exceeds the sets' difference) before
Jaccard is verified on the full sets. A line that matches an earlier line is removed, whether that one stays or not.

As one match is enough, each line is first compared with the earliest line of each of its grams; only those without a
match are compared with all other earlier lines, and that by semi-joins, which end at a line's first match: one by the filters
and, for the lines that this leaves, one by Jaccard on the sets. So no step makes a row for each pair of a gram's lines.

The words of a line stay in one array, which is sorted as numbers; grams are rows, exchanged once, and those of one line alone
end there.

Defined cases: null and empty texts have no lines to judge; lines of under `min_words` words are kept as they are; rows
with a null id come first; equal rows of one id are one document; different texts of one id (or of none) are documents of
their own, in the order of their hashes; other columns stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._stage import Scratch, fresh

_SPACE = r"[\x20\x09-\x0D]+"
_OTHER_SPACE = r"[\x09\x0B-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"
_BUCKETS = 1 << 16
_HASH_BITS = 58
_PARTS = 2  # grams are exchanged in parts, so that the shuffle files of one are gone before the next
_NEAR = 300_000  # rows of a few numbers that may be broadcast
_DOC = ("id", "v")


def _judged(line: Column, min_words: int) -> Column:
    return line.rlike(_SPACE.join([_WORD] * min_words))


def _rarity(source: DataFrame) -> Column:
    """An array of each bucket's rank, of 65,536 entries at any size: the logarithm of its words' count in the corpus, and
    0 up to four times the median, which rare words alone fill."""
    words = source.select(F.explode(F.split(F.lower(_spaced(F.replace("body", F.lit("\n"), F.lit(" ")))), " ")).alias("w"))
    counts = words.select(F.pmod(F.xxhash64("w"), F.lit(_BUCKETS)).cast("int").alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("c"))
    found = [0] * _BUCKETS
    for b, c in counts.collect():
        found[b] = c
    usual = 4 * sorted(found)[_BUCKETS // 2]
    ranks = ",".join(str(0 if c <= usual else min(31, c.bit_length())) for c in found)
    return F.split(F.lit(ranks), ",").cast("array<int>")  # folded into one constant; a list would be a call for each entry


def _spaced(text: Column) -> Column:
    """A text without line breaks, with a space for each other white space: splitting at one character takes no pattern."""
    return F.when(text.rlike(_OTHER_SPACE), F.regexp_replace(text, _OTHER_SPACE, " ")).otherwise(text)


def _words(line: Column) -> Column:
    """The distinct words of a line; an empty text among them where there is more space than one between words."""
    return F.array_distinct(F.split(F.lower(_spaced(line)), " "))


def _hash(word: Column) -> Column:
    return F.xxhash64(word).bitwiseAND(F.lit((1 << _HASH_BITS) - 1))


def _ordered(line: Column, ranks: Column) -> Column:
    """A line's distinct words as numbers, in order of rarity: a word's bucket's rank, then its hash. Each word is hashed once
    and told from the others by its hash."""
    hashes = F.array_distinct(F.transform(F.split(F.lower(_spaced(line)), " "), _hash))
    rank = lambda h: F.get(ranks, h.bitwiseAND(F.lit(_BUCKETS - 1)).cast("int")).cast("long")
    return F.sort_array(F.transform(F.array_remove(hashes, _hash(F.lit(""))), lambda h: F.shiftleft(rank(h), _HASH_BITS).bitwiseOR(h)))


def _documents(docs: DataFrame, id_col: str, text: str, scratch: Scratch) -> DataFrame:
    """(id, v, body) of each row; v tells the texts of one id apart, and is 0 where an id has one."""
    ident = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(2**63)))
    source = docs.select(ident.alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("body"))
    texts = source.select("id", F.xxhash64("body").alias("h")).groupBy("id", "h").agg(F.count(F.lit(1)).alias("rows"))
    odd = scratch.keep(texts.groupBy("id").agg(F.count(F.lit(1)).alias("texts"), F.max("rows").alias("rows")).where("texts > 1 or rows > 1"), "odd")
    several = odd.where("texts > 1").select("id", F.lit(True).alias("many"))
    if several.isEmpty():
        source = source.select("id", F.lit(0).cast("long").alias("v"), "body")
    else:
        marked = source.join(_near_at_hand(several), "id", "left")
        source = marked.select("id", F.when(F.col("many"), F.xxhash64("body")).otherwise(0).alias("v"), "body")
    return source if odd.where("rows > 1").isEmpty() else source.dropDuplicates([*_DOC])


def _lines(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, v, lid, t) of the wanted lines (id, v, line, lid); the rows of a document stay in one partition. Texts are exchanged
    only where too many lines are wanted for a broadcast."""
    lists = wanted.groupBy(*_DOC).agg(F.collect_list(F.struct("line", "lid")).alias("wanted"))  # at most a text's own lines
    joined = source.join(F.broadcast(lists), [*_DOC]) if wanted.count() <= _NEAR else source.hint("merge").join(lists, [*_DOC])
    joined = joined.select(*_DOC, F.split("body", "\n").alias("all"), "wanted")
    return joined.select(*_DOC, "all", F.explode("wanted").alias("w")).select(*_DOC, F.col("w.lid").alias("lid"), F.get("all", F.col("w.line")).alias("t"))


def _may_match(percent: int, mine, other) -> Column:
    """Filters on n and the parity maps of both lines: length, and parity, as two maps differ in no more bits than the sets in words."""
    n, m = mine("n"), other("n")
    need = F.ceil((n + m) * percent / (100.0 + percent) - 1e-9)
    alike = 100 * F.least(n, m) >= percent * F.greatest(n, m)
    apart = F.bit_count(mine("s1").bitwiseXOR(other("s1"))) + F.bit_count(mine("s2").bitwiseXOR(other("s2")))
    return alike & (apart <= n + m - 2 * need)


def _of(side: str):
    """A column of one side of a join by its name."""
    return lambda c: F.col(f"{side}{c}")


def _near_at_hand(kept: DataFrame, most: int = _NEAR) -> DataFrame:
    """A written table of a few numbers a row: to be broadcast if it has at most `most` rows, else joined as it is."""
    return F.broadcast(kept) if kept.count() <= most else kept


def _matches(percent: int, k: Column, other: Column) -> Column:
    common = F.size(F.array_intersect(k, other))
    return 100 * common >= percent * (F.size(k) + F.size(other) - common)


def _sets(lids: DataFrame, source: DataFrame, firsts: DataFrame, scratch: Scratch) -> DataFrame:
    """(lid, k) with the distinct words of the lines."""
    wanted = scratch.keep(lids.distinct().join(firsts, "lid"), "wanted")
    sets = scratch.keep(_lines(source, wanted).select("lid", F.array_remove(_words(F.col("t")), "").alias("k")), "sets")
    scratch.drop(wanted)
    return sets


def _verified(pairs: DataFrame, source: DataFrame, firsts: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(lid) of the first lines of pairs (lid, other) whose Jaccard reaches the threshold."""
    sets = _sets(pairs.select("lid").union(pairs.select("other")), source, firsts, scratch)
    both = pairs.join(sets, "lid").join(sets.select(F.col("lid").alias("other"), F.col("k").alias("other_k")), "other")
    found = scratch.keep(both.where(_matches(percent, F.col("k"), F.col("other_k"))).select("lid").distinct(), "gone")
    scratch.drop(sets)
    return found


def _late(posts: DataFrame, source: DataFrame, firsts: DataFrame, gone: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(lid) of the lines with an earlier match in a gram, of those that `gone` has not and that have more earlier lines than the
    earliest. Semi-joins give a row for a line and gram at most, however many earlier lines there are."""
    a, b = _of("a."), _of("b.")
    earlier = (a("token") == b("token")) & (b("lid") < a("lid")) & _may_match(percent, a, b)
    rows = posts.select("token", "lid", "n", "s1", "s2")
    open_ = posts.where("more").select(rows.columns).join(_near_at_hand(gone), "lid", "left_anti")
    hits = scratch.keep(open_.alias("a").join(rows.alias("b"), earlier, "left_semi"), "hits")
    met = scratch.keep(rows.join(_near_at_hand(hits.select("token").distinct()), "token", "left_semi"), "met")
    sets = _sets(hits.select("lid").union(met.select("lid")), source, firsts, scratch)
    same = earlier & _matches(percent, a("k"), b("k"))
    with_sets = lambda x: x.join(sets, "lid")
    found = scratch.keep(with_sets(hits).alias("a").join(with_sets(met).alias("b"), same, "left_semi").select("lid").distinct(), "gone")
    for t in (hits, met, sets):
        scratch.drop(t)
    return found


def _grams(held: DataFrame, ranks: Column, percent: int) -> DataFrame:
    """(token, lid, n, s1, s2) of the grams in each line's prefix; s1 and s2 are the parity map of its n words."""
    keys = held.select("lid", _ordered(F.col("t"), ranks).alias("k"))
    bit = lambda x, k: F.call_function("shiftleft", x, k.bitwiseAND(F.lit(63)).cast("int"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    every = F.aggregate("k", zero, lambda s, k: s.bitwiseXOR(bit(one, k)))
    upper = F.aggregate("k", zero, lambda s, k: s.bitwiseXOR(bit(F.shiftright(k, 6).bitwiseAND(one), k)))
    lines = keys.select("lid", "k", F.size("k").alias("n"), every.alias("s"), upper.alias("s2"))
    lines = lines.select("lid", "k", "n", F.col("s").bitwiseXOR(F.col("s2")).alias("s1"), "s2")
    line = ["lid", "n", "s1", "s2"]
    n = F.col("n").cast("long")
    if percent < 75:
        at = F.slice("k", F.lit(1), (n - F.floor((n * percent + 99) / 100) + 1).cast("int"))
        return lines.select(*line, F.explode(at).alias("a")).select(F.xxhash64("a").alias("token"), *line)
    own = F.floor(n * (100 - percent) / 100)
    places = 2 * own + F.floor((n * (100 - percent) - 100 * own) / percent) + 1
    most = F.greatest(F.lit(1), F.least(places, n - 1)).cast("int")  # a single word has no neighbour; null stands for it
    pairs = F.inline(F.arrays_zip(F.slice("k", F.lit(1), most).alias("a"), F.slice("k", F.lit(2), most).alias("b")))
    return lines.select(*line, pairs).toDF(*line, "a", "b").select(F.xxhash64("a", "b").alias("token"), *line)


def _shared(grams: DataFrame, percent: int) -> DataFrame:
    """(token, lid, n, s1, s2, more, other) of the grams whose line is not their earliest: `other` is that one where the filters
    let the pair through, and `more` tells that there are further earlier lines."""
    line = Window.partitionBy("token").orderBy("lid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = grams.select("*", F.row_number().over(line).alias("at"), *[F.first(c).over(line).alias(f"c_{c}") for c in ("lid", "n", "s1", "s2")])
    near = (F.col("lid") != F.col("c_lid")) & _may_match(percent, _of(""), _of("c_"))
    return ranked.where("at > 1").select("token", "lid", "n", "s1", "s2", (F.col("at") > 2).alias("more"), F.when(near, F.col("c_lid")).alias("other"))


def _postings(held: DataFrame, ranks: Column, percent: int, scratch: Scratch | None = None, written: list | None = None) -> DataFrame:
    """What _shared has of the grams of lines (lid, t). With `scratch` the grams are written and then exchanged in parts, by
    other bits than those that spread a part over partitions; `written` gets the parts' tables."""
    if scratch is None:
        return _shared(_grams(held, ranks, percent), percent)
    grams = scratch.keep(_grams(held, ranks, percent), "posts")
    for k in range(_PARTS):
        written.append(scratch.keep(_shared(grams.where(F.pmod(F.xxhash64("token"), F.lit(_PARTS)) == k), percent), "flagged"))
    scratch.drop(grams)
    return reduce(DataFrame.union, written)


def kept_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = 80, min_words: int = 1) -> tuple[DataFrame, DataFrame]:
    """(id, v, body) of the documents and (id, v, good) with the judged lines that stay, for each document that has any."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "line-dedup")
    source = _documents(docs, id_col, text, scratch)
    ranks = _rarity(source)
    lines = source.select(*_DOC, F.posexplode(F.split("body", "\n")).alias("line", "t")).where(_judged(F.col("t"), min_words))
    low = F.lower("t")
    firsts = lines.select(*_DOC, "line", F.xxhash64(low).alias("h1"), F.xxhash64(F.lit(1), low).alias("h2")).groupBy("h1", "h2").agg(F.min(F.struct(*_DOC, "line")).alias("f"))
    # One number a line, ascending in the order of lines; written, so that it stays the same.
    unnumbered = scratch.keep(firsts.select("f.*"), "lines")
    firsts = scratch.keep(unnumbered.orderBy(*_DOC, "line").withColumn("lid", F.monotonically_increasing_id()), "firsts")
    scratch.drop(unnumbered)

    tables: list[DataFrame] = []
    posts = _postings(_lines(source, firsts), ranks, percent, scratch, tables)

    # Against the earliest line that has the gram, where the filters let the pair through.
    pairs = scratch.keep(posts.where("other is not null").select("lid", "other").distinct(), "pairs")
    gone = _verified(pairs, source, firsts, percent, scratch)
    scratch.drop(pairs)

    # The lines that this left, against all other earlier lines of each of their grams.
    gone = gone.union(_late(posts, source, firsts, gone, percent, scratch))
    for part in tables:
        scratch.drop(part)
    good = firsts.join(gone, "lid", "left_anti").groupBy(*_DOC).agg(F.collect_list("line").alias("good"))
    return source, scratch.keep(good, "good")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = 80, min_words: int = 1, counts: bool = True) -> DataFrame:
    """docs with later matches taken out of the text and, if counts, n_lines and n_removed."""
    _, good = kept_lines(docs, id_col, text, percent, min_words)
    key, v, lines, g, g2 = (fresh(docs.columns, c) for c in ("line_key", "line_text", "all_lines", "good_lines", "other_good_lines"))
    names = [fresh(docs.columns, c) for c in ("n_lines", "n_removed")]
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    several = good.where("v <> 0").select("id").distinct()  # the ids whose texts are told apart
    found = good.select(F.col("id").alias(key), F.col("v").alias(v), F.col("good").alias(g))
    # One plan at all sizes, as the lists of a large table are never few enough for a broadcast; texts are split after it.
    left = docs.withColumn(key, F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(2**63)))).hint("merge")
    if several.isEmpty():
        joined = left.join(found.drop(v), key, "left")
    else:
        told = left.withColumn(v, F.xxhash64(body)).join(found.where(F.col(v) != 0).withColumnRenamed(g, g2), [key, v], "left")
        joined = told.join(found.where(F.col(v) == 0).drop(v), key, "left").withColumn(g, F.coalesce(F.col(g2), F.col(g)))
    joined = joined.withColumn(lines, F.split(body, "\n"))
    free = F.filter(F.transform(lines, lambda t, i: F.when(~_judged(t, min_words), i)), lambda i: i.isNotNull())
    stay = F.array_sort(F.array_union(F.coalesce(g, F.array().cast("array<int>")), free))
    put = joined.withColumn(g, stay)
    result = F.array_join(F.transform(g, lambda i: F.get(lines, i)), "\n")
    extra = [F.size(lines).cast("long").alias(names[0]), (F.size(lines) - F.size(g)).cast("long").alias(names[1])] if counts else []
    return put.select(*[(F.when(F.col(f"`{c}`").isNotNull(), result).alias(c) if c == text else F.col(f"`{c}`")) for c in docs.columns], *extra)


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    done = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


#: Lines, the first of equal ones, words in rarity order, the prefix join and Jaccard, as SQL.
ORACLE_CTES = r"""
sl AS (SELECT doc_id, (unnest(generate_series(1, len(ls))) - 1)::INT AS line, unnest(ls) AS t FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM {docs})),
jl AS (SELECT doc_id, line, t, regexp_extract_all(lower(t), '[^\x20\x09-\x0D]+') AS w FROM sl),
fl AS (SELECT arg_min(doc_id, (doc_id, line)) AS doc_id, arg_min(line, (doc_id, line)) AS line, arg_min(w, (doc_id, line)) AS w FROM jl WHERE len(w) >= 1 GROUP BY lower(t)),
tk AS (SELECT DISTINCT doc_id, line, unnest(w) AS k FROM fl),
fq AS (SELECT k, count(*) AS c FROM tk GROUP BY 1),
rk AS (SELECT doc_id, line, k, row_number() OVER (PARTITION BY doc_id, line ORDER BY c, k) AS pos, count(*) OVER (PARTITION BY doc_id, line) AS n FROM tk JOIN fq USING (k)),
px AS (SELECT * FROM rk WHERE pos <= n - (n * 80 + 99) // 100 + 1),
cp AS (SELECT DISTINCT a.doc_id, a.line, b.doc_id AS od, b.line AS ol, a.n, b.n AS m FROM px a JOIN px b
       ON a.k = b.k AND (b.doc_id, b.line) < (a.doc_id, a.line) AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
ws AS (SELECT doc_id, line, list(k) AS ks FROM tk GROUP BY ALL),
vf AS (SELECT DISTINCT cp.doc_id, cp.line FROM cp JOIN ws x ON x.doc_id = cp.doc_id AND x.line = cp.line JOIN ws y ON y.doc_id = od AND y.line = ol
       WHERE 100 * len(list_intersect(x.ks, y.ks)) >= 80 * (n + m - len(list_intersect(x.ks, y.ks)))),
gd AS (SELECT doc_id, line FROM fl EXCEPT SELECT doc_id, line FROM vf),
ol AS (SELECT jl.doc_id, jl.line, jl.t, (len(w) < 1 OR gd.line IS NOT NULL) AS stays FROM jl LEFT JOIN gd ON gd.doc_id = jl.doc_id AND gd.line = jl.line),
dl AS (SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (NOT stays))::BIGINT AS n_removed, coalesce(string_agg(t, chr(10) ORDER BY line) FILTER (stays), '') AS text FROM ol GROUP BY 1)
"""
ORACLE = "WITH " + ORACLE_CTES.format(docs="documents") + "SELECT doc_id, n_lines, n_removed, md5(text) AS text_md5 FROM dl"
