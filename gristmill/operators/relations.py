"""Coverage, comparison, set and history operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import versions as V


# Coverage of documented symbols.
def with_parents(elements: DataFrame) -> DataFrame:
    """Elements (ord, name, href, parent_href) with the name of the element that encloses them; of elements of one href
    the last counts."""
    parents = elements.groupBy("href").agg(F.max_by("name", "ord").alias("parent")).select(F.col("href").alias("parent_href"), "parent")
    return elements.join(parents, "parent_href", "left")


def undocumented(elements: DataFrame, documented: DataFrame, key: str = "name", parent: str | None = None) -> DataFrame:
    """Elements without documentation; where `parent` is given, only those whose parent has some."""
    missing = elements.join(documented.select(key).distinct(), key, "left_anti")
    if parent is None:
        return missing
    return missing.join(documented.select(F.col(key).alias(parent)).distinct(), parent, "left_semi")


def coverage(elements: DataFrame, documented: DataFrame, group: str, key: str, ord_col: str, sample: int = 5) -> DataFrame:
    """total, documented, the first `sample` missing keys in order, ratio (nothing to document: 1) and points."""
    known = elements.join(documented.select(key).distinct().withColumn("has", F.lit(True)), key, "left")
    agg = known.groupBy(group).agg(F.countDistinct(F.when(F.col("has"), F.col(key))).alias("documented"), F.count(F.when(F.col("has").isNull(), 1)).alias("missing_n"))
    order = Window.partitionBy(group).orderBy(ord_col)
    first = known.where("has is null").withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample)
    first = first.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", key))), lambda x: x[key]).alias("missing"))  # at most `sample`
    total = F.col("documented") + F.col("missing_n")
    ratio = F.when(total == 0, 1.0).otherwise(F.col("documented") / total)
    out = agg.join(first, group, "left")
    return out.select(group, total.alias("total"), "documented", F.coalesce("missing", F.array().cast("array<bigint>") if dict(elements.dtypes)[key] == "bigint" else F.array().cast("array<string>")).alias("missing"), ratio.alias("ratio"), F.when(ratio >= 0.2, 10).otherwise(0).alias("points"))


# Comparison of two runs.
def deltas(before: DataFrame, after: DataFrame, key: str, score: str) -> DataFrame:
    """Change of score of the keys that both runs have; a missing score is 0."""
    b = before.select(key, F.coalesce(score, F.lit(0)).alias("before"))
    return b.join(after.select(key, F.coalesce(score, F.lit(0)).alias("after")), key).select(key, (F.col("after") - F.col("before")).alias("delta"))


def buckets(changes: DataFrame, key: str) -> DataFrame:
    """One row: how many did not change, rose and fell."""
    return changes.agg(F.count_if(F.col("delta") == 0).alias("unchanged"), F.count_if(F.col("delta") > 0).alias("increased"), F.count_if(F.col("delta") < 0).alias("decreased"))


def marked_diff(a: Column, b: Column) -> Column:
    """Ids only in a with a minus, then those only in b with a plus; repeats stay."""
    gone = F.filter(a, lambda x: ~F.array_contains(b, x))
    new = F.filter(b, lambda x: ~F.array_contains(a, x))
    return F.concat(F.transform(gone, lambda x: F.concat(F.lit("-"), x)), F.transform(new, lambda x: F.concat(F.lit("+"), x)))


def frequent_changes(changed: DataFrame, key: str, change: str, members: int = 5) -> DataFrame:
    """Each change, how often, and the first members by key. The members are ranked before they are gathered."""
    order = Window.partitionBy(change).orderBy(key)
    first = changed.withColumn("n", F.row_number().over(order)).where(F.col("n") <= members)
    lists = first.groupBy(change).agg(F.array_sort(F.collect_list(key)).alias("members"))
    return changed.groupBy(change).agg(F.count(F.lit(1)).alias("n")).join(lists, change)


# Outdated dependencies.
#: From worst to best.
OUTDATED, RECENT, PREVIEW = 0, 1, 2


def outdated(dependencies: DataFrame, listing: DataFrame, as_of: Column, grace_days: int = 30) -> DataFrame:
    """The worst finding of each dependency (package, constraint, upgradable) against the listed versions (package,
    version, published, needs_new_sdk), with the version first found so.

    Pre-releases, versions up to the upgradable one and allowed versions are no findings."""
    d = dependencies.withColumns({"b": V.bounds(F.col("constraint")), "upto": V.key(F.col("upgradable"))})
    l = listing.withColumn("k", V.key(F.col("version"))).where(~V.is_prerelease(F.col("version")))
    hit = d.join(l, "package").where((F.col("upto").isNull() | (F.col("k") > F.col("upto"))) & ~V.allows(F.col("b"), F.col("k")))
    fresh = V.age_days(F.col("published"), as_of) < grace_days
    status = F.when(fresh, RECENT).when(F.col("needs_new_sdk"), PREVIEW).otherwise(OUTDATED)
    return hit.withColumn("status", status).groupBy("package").agg(F.min("status").alias("status"), F.min_by("version", F.struct("status", "k")).alias("version"))


def split_direct(rows: DataFrame, direct: DataFrame, key: str = "package") -> tuple[DataFrame, DataFrame]:
    return rows.join(direct, key, "left_semi"), rows.join(direct, key, "left_anti")


def worst(rows: DataFrame, key: str, status: str, ord_col: str) -> DataFrame:
    """The row of the lowest status of each key; the first of equals."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(status, ord_col)).alias("r")).select(key, "r.*")


# Lists with limits.
def first_issues(paragraphs: DataFrame, key: str, ord_col: str, is_issue: Column, most: int) -> DataFrame:
    """Paragraphs in order until `most` issues have been passed; other kinds do not count."""
    order = Window.partitionBy(key).orderBy(ord_col).rowsBetween(Window.unboundedPreceding, 0)
    return paragraphs.withColumn("seen", F.count_if(is_issue).over(order)).where(F.col("seen") <= most).drop("seen")


def capped_successes(shots: DataFrame, key: str, ord_col: str, ok: Column, most: int = 10) -> DataFrame:
    """accepted: the first `most` successes; later ones fail."""
    order = Window.partitionBy(key).orderBy(ord_col).rowsBetween(Window.unboundedPreceding, 0)
    return shots.withColumn("accepted", ok & (F.count_if(ok).over(order) <= most))


def first_existing(files: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """The candidate (key, path, rank) of least rank that is there."""
    return candidates.join(files, [key, "path"], "left_semi").groupBy(key).agg(F.min_by("path", "rank").alias("path"))


def symbol_changes(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))
