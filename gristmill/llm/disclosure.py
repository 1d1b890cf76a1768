"""Information-theoretic sanitisation of personal data, in DataFrame operations only.

Patterns find the protected entities: e-mail, IP, card and phone spans. Corpus co-occurrence then says how strongly the
terms around an entity reveal it. Over word occurrences, with N of all words, c(t) of the term, c(e) in the entity's
surroundings and c(e,t) of the term there, pointwise mutual information in proportion to what knowing the entity itself
would tell is

    disclosure(e, t) = (1 - log(c(t) / c(e,t)) / log(N / c(e))) * n / (n + prior),

where 1 - log(c(t) / c(e,t)) / log(N / c(e)) = log(N c(e,t) / (c(e) c(t))) / log(N / c(e)), and n is the number of distinct
texts that hold both. The factor is the evidence: what stands beside an entity in a single text counts half at most, however
rare it is, and copies of a text count once. As most entities are in few texts, the group of an entity (`_group`: the domain
of an address, a network, an area, an issuer) is an entity of its own.

A term whose disclosure reaches `generalise_at` is generalised where it stands near that entity (within `reach`
characters): a number to its first digit and size, other terms to their class, [CODE], [NAME] or [TERM]. At `remove_at` it is
removed. Terms farther off are never judged. Counts cover all documents.

Defined cases: null and empty texts have no spans; equal rows get equal spans; a term that overlaps a base span is left to
it; texts without an entity are never changed; other columns stay as they are, results are renamed if they clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._stage import Scratch, fresh

KINDS = ("email", "ip", "card", "phone", "term")
#: The base patterns, with possessive repeats and look-behind so that a long run is read once; they match the same spans.
#: A card is a whole run of digits; only runs of 14 to 19 can pass.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?<![0-9][0-9])(?<![0-9][ -][0-9])(?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_WORD = r"[\p{L}\p{N}]+"
_SPAN = "array<struct<start:int,rank:int,end:int,match:string>>"


def _luhn(match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)

    def add(total, i):
        d = F.substring(digits, n - i, F.lit(1)).cast("int") * (1 + i % 2)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _digits(match: Column) -> Column:
    return F.length(F.regexp_replace(match, "[^0-9]", ""))


_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_PASSES = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
    "card": _luhn,
    "phone": lambda m: _digits(m).between(10, 15),
}
#: A cheap test that a text must pass to hold the kind at all.
_MAY = {"email": lambda t: t.contains("@"), "phone": lambda t: t.contains("+")}


def _located(text: Column, pattern: str, rank: int, base: Column | int = 0) -> Column:
    """Spans of the pattern's matches: the pieces between matches and the matches add up to each match's place."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
    start = F.struct((F.lit(0) + base).cast("int").alias("at"), F.array().cast(_SPAN).alias("spans"))

    def step(acc, x):
        a = acc["at"] + F.length(x["piece"])
        b = a + F.coalesce(F.length(x["match"]), F.lit(0))
        one = F.struct(a.alias("start"), F.lit(rank).alias("rank"), b.alias("end"), x["match"].alias("match"))
        return F.struct(b.alias("at"), F.when(x["match"].isNull(), acc["spans"]).otherwise(F.array_append(acc["spans"], one)).alias("spans"))

    return F.aggregate(pairs, start, step, lambda acc: acc["spans"])


def base_spans(text: Column) -> Column:
    """All base spans of a text by start, then kind."""

    def of(rank: int, kind: str) -> Column:
        may = _MAY[kind](text) & text.rlike(PATTERNS[kind]) if kind in _MAY else text.rlike(PATTERNS[kind])
        return F.filter(F.when(may, _located(text, PATTERNS[kind], rank)).otherwise(F.array().cast(_SPAN)), lambda s: _PASSES[kind](s["match"]))

    return F.array_sort(F.concat(*[of(rank, kind) for rank, kind in enumerate(KINDS[:4])]))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["rank"]], s["start"], s["end"])), ",")


def _group(kind: Column, match: Column) -> Column:
    """The wider entity that a match belongs to: an address' domain, a network of 256 hosts, six digits of a card or phone."""
    digits = F.substring(F.regexp_replace(match, "[^0-9]", ""), 1, 6)
    wide = F.when(kind == "email", F.substring_index(match, "@", -1)).when(kind == "ip", F.substring_index(match, ".", 3)).otherwise(digits)
    return F.concat_ws(":", F.lit("group"), kind, wide)


def _surroundings(hits: DataFrame, reach: int) -> DataFrame:
    """(id, h, entity, term, start, end) of the whole words within `reach` characters of each base span, for the entity and
    for its group."""
    kinds = F.array(*map(F.lit, KINDS))
    each = hits.select("id", "h", "body", "spans", F.explode("spans").alias("s"))
    s, n, kind, match = F.col("s.start"), F.length("body"), kinds[F.col("s.rank")], F.lower("s.match")
    cut = F.greatest(s - reach, F.lit(0))
    left, right = F.substring("body", cut + 1, s - cut), F.substring("body", F.col("s.end") + 1, F.lit(reach))
    left = F.when(cut > 0, F.regexp_replace(left, rf"^{_WORD}", "")).otherwise(left)
    right = F.when(F.col("s.end") + reach < n, F.regexp_replace(right, rf"{_WORD}$", "")).otherwise(right)
    each = each.select("id", "h", "spans", F.array(F.concat_ws(":", kind, match), _group(kind, match)).alias("entities"), s.alias("s"), F.col("s.end").alias("e"), left.alias("left"), right.alias("right"))
    words = F.concat(_located(F.col("left"), _WORD, 4, F.col("s") - F.length("left")), _located(F.col("right"), _WORD, 4, F.col("e")))
    terms = each.select("id", "h", "entities", "spans", F.explode(words).alias("t"))
    free = ~F.exists("spans", lambda b: (b["start"] < F.col("t.end")) & (b["end"] > F.col("t.start")))
    return terms.where(free).select("id", "h", F.explode("entities").alias("entity"), F.lower("t.match").alias("term"), F.col("t.start").alias("start"), F.col("t.end").alias("end"))


def find(docs: DataFrame, id_col: str = "doc_id", text: str = "text", generalise_at: float = 0.7, remove_at: float = 0.95, prior: float = 1.0, reach: int = 100, keep_text: bool = False) -> DataFrame:
    """id, h (the text's hash), base (spans), terms (start, end, disclosure), for each row of docs.

    Text leaves its scan only where it holds an entity; the corpus' words are counted by 64-bit hash before they move."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "disclosure")
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    source = docs.select(F.col(f"`{id_col}`").alias("id"), body.alias("body"))
    based = scratch.keep(source.select("id", F.xxhash64("body").alias("h"), base_spans(F.col("body")).alias("spans"), "body").withColumn("body", F.when(F.size("spans") > 0, F.col("body"))), "base")
    near = scratch.keep(_surroundings(based.where("body is not null"), reach), "near")

    together = near.groupBy("entity", "term", "h").agg(F.count(F.lit(1)).alias("c")).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("texts"), F.sum("c").alias("both"))
    together = scratch.keep(together.where(F.col("texts") / (F.col("texts") + prior) >= generalise_at), "together")  # the share is 1 at most
    of_entity = near.groupBy("entity").agg(F.count(F.lit(1)).alias("of_entity"))
    words = source.select(F.explode(F.split(F.lower("body"), r"[^\p{L}\p{N}]+")).alias("w")).where("w <> ''")
    counts = words.select(F.xxhash64("w").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("of_term"))
    asked = scratch.keep(together.select(F.xxhash64("term").alias("word")).distinct(), "asked")
    total = counts.agg(F.sum("of_term").alias("total"))
    counted = scratch.keep(counts.join(asked, "word", "left_semi").withColumn("kind", F.lit(0)).unionByName(total.select(F.lit(0).cast("long").alias("word"), F.col("total").alias("of_term"), F.lit(1).alias("kind"))), "counts")
    n = counted.where("kind = 1").agg(F.max("of_term")).first()[0] or 1
    share = 1 - F.log(F.greatest(F.col("of_term") / F.col("both"), F.lit(1.0))) / F.log(F.greatest(F.lit(float(n)) / F.col("of_entity"), F.lit(2.0)))
    revealing = together.withColumn("word", F.xxhash64("term")).join(counted.where("kind = 0").select("word", "of_term"), "word").join(of_entity, "entity").select("entity", "term", (share * F.col("texts") / (F.col("texts") + prior)).alias("disclosure")).where(F.col("disclosure") >= generalise_at)
    revealing = scratch.keep(revealing, "revealing")

    marks = near.join(revealing, ["entity", "term"]).groupBy("id", "h", "start", "end").agg(F.max("disclosure").alias("disclosure"))
    marks = marks.groupBy("id", "h").agg(F.array_sort(F.collect_list(F.struct("start", "end", "disclosure"))).alias("terms"))  # at most a text's own words
    m = marks.select(F.col("id").alias("of_id"), F.col("h").alias("of_h"), "terms")
    out = based.join(m, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("h") == F.col("of_h")), "left")
    terms = F.coalesce("terms", F.array().cast("array<struct<start:int,end:int,disclosure:double>>"))
    return out.select("id", "h", F.col("spans").alias("base"), F.transform(terms, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["disclosure"].alias("disclosure"), (t["disclosure"] >= remove_at).alias("removed"))).alias("terms"))


def all_spans(base: Column, terms: Column) -> Column:
    extra = F.transform(terms, lambda t: F.struct(t["start"].alias("start"), F.lit(4).alias("rank"), t["end"].alias("end"), F.lit("").alias("match")))
    return F.array_sort(F.concat(base, extra.cast(_SPAN)))


def _wider(term: Column) -> Column:
    """What a term is generalised to."""
    number = F.rpad(F.substring(term, 1, 1), F.length(term), F.lit("0"))
    return F.when(term.rlike("^[0-9]+$"), number).when(term.rlike(r"\p{N}"), "[CODE]").when(term.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[TERM]")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text: str = "text", result: str = "sanitised", **options) -> DataFrame:
    """docs with the sanitised text: entities become [KIND], generalised terms their class, removed terms nothing."""
    result = fresh(docs.columns, result)
    own, ident, h, base, terms = (fresh([*docs.columns, result], c) for c in ("own_text", "found_id", "found_text", "found_base", "found_terms"))
    found = find(docs, id_col, text, **options).select(F.col("id").alias(ident), F.col("h").alias(h), F.col("base").alias(base), F.col("terms").alias(terms)).dropDuplicates([ident, h])
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    marks = F.array_sort(F.concat(F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(F.array(*map(F.lit, KINDS))[s["rank"]]), F.lit("]")).alias("by"))), F.transform(terms, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.when(t["removed"], "").otherwise(_wider(F.substring(F.col(own), t["start"] + 1, t["end"] - t["start"]))).alias("by")))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))

    def step(acc, m):
        gap = F.substring(F.col(own), acc["at"] + 1, F.greatest(m["start"] - acc["at"], F.lit(0)))
        return F.when(m["end"] <= acc["at"], acc).otherwise(F.struct(m["end"].alias("at"), F.concat(acc["done"], gap, m["by"]).alias("done")))

    joined = docs.withColumn(own, body).join(found, F.col(f"`{id_col}`").eqNullSafe(F.col(ident)) & (F.xxhash64(own) == F.col(h)))
    clean = F.aggregate(marks, start, step, lambda acc: F.concat(acc["done"], F.substring(F.col(own), acc["at"] + 1, F.length(own))))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], clean.alias(result))


def op7_disclosure(spark, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def count(rank: int) -> Column:
        return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long").alias(f"n_{KINDS[rank]}")

    many = (F.size("base") + F.size("terms")).cast("long").alias("n_spans")
    return found.select(F.col("id").alias("doc_id"), *map(count, range(4)), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(all_spans(F.col("base"), F.col("terms"))).alias("spans"), many)
