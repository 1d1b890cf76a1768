"""Rules over packages: licences, links, repositories, files and the tags that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quality as Q
from ..functions import urls as U


def licence_tags(hits: DataFrame, key: str, ident: str, approved: DataFrame) -> DataFrame:
    """tags of each key: distinct lower-cased ids, and `open` if all are approved; no id: unknown. approved: (id)."""
    found = hits.where(F.col(ident).isNotNull()).select(key, F.lower(ident).alias("id")).distinct()
    known = approved.select(F.lower("id").alias("id")).distinct().withColumn("ok", F.lit(True))
    by = found.join(known, "id", "left").groupBy(key).agg(F.array_sort(F.collect_set(F.concat(F.lit("license:"), "id"))).alias("ids"), F.every(F.coalesce("ok", F.lit(False))).alias("all_ok"))
    tags = F.when(F.col("ids").isNull(), F.array(F.lit("license:unknown"))).when(F.col("all_ok"), F.array_append("ids", F.lit("license:open"))).otherwise(F.col("ids"))
    return hits.select(key).distinct().join(by, key, "left").select(key, tags.alias("tags"))


def only_named(manifests: DataFrame, wanted: DataFrame, key: str = "repo", name: str = "name") -> DataFrame:
    """(key, name, path, verdict): the one manifest of that name; none and several fail."""
    hit = wanted.join(manifests, [key, name], "left").groupBy(key, name).agg(F.count("path").alias("n"), F.min("path").alias("path"))
    return hit.select(key, name, F.when(F.col("n") == 1, F.col("path")).alias("path"), F.when(F.col("n") == 1, "found").when(F.col("n") == 0, "missing").otherwise("ambiguous").alias("verdict"))


def missing_executables(declared: DataFrame, files: DataFrame, key: str = "package") -> DataFrame:
    """Declared executables (key, name, file) without a file bin/<file>.dart; an empty file name means the executable's own."""
    path = F.concat(F.lit("bin/"), F.when(F.coalesce(F.trim("file"), F.lit("")) == "", F.col("name")).otherwise(F.trim("file")), F.lit(".dart"))
    return declared.withColumn("path", path).join(files.select(key, "path"), [key, "path"], "left_anti").select(key, "name", "path")


def manifest_verdict(readable: Column, content: Column, parsed: Column, name: Column, wanted: Column, url: Column, version: Column, publish_to: Column, wanted_url: Column) -> Column:
    """The first rule that a repository's manifest breaks; null if none."""
    repo, want = U.repository(url), U.repository(wanted_url)
    return F.coalesce(
        F.when(~readable, "unreadable"),
        F.when(F.trim(F.coalesce(content, F.lit(""))) == "", "empty"),
        F.when(~parsed, "malformed"),
        F.when(~name.eqNullSafe(wanted), "other name"),
        F.when(F.coalesce(url, F.lit("")) == "", "no URL"),
        F.when(repo.isNull(), "bad URL"),
        F.when(~U.clone_url(repo).eqNullSafe(U.clone_url(want)), "other URL"),
        F.when(F.coalesce(version, F.lit("")) == "", "no version"),
        F.when(publish_to.isNotNull(), "not for publishing"),
    )


def shown_links(homepage: Column, repository: Column, tracker: Column, homepage_verified: Column) -> Column:
    """struct(homepage, repository, tracker): a verified homepage stands in for a missing repository, and known hosts have
    their issue list."""
    moved = repository.isNull() & homepage_verified
    repo = F.when(moved, homepage).otherwise(repository)
    parsed = U.repository(repo)
    issues = F.when(U.is_github_like(parsed), F.concat(U.clone_url(parsed), F.when(parsed["provider"] == "gitlab", F.lit("/-/issues")).otherwise(F.lit("/issues"))))
    return F.struct(F.when(~moved, homepage).alias("homepage"), repo.alias("repository"), F.coalesce(tracker, issues).alias("tracker"))


def link_issues(links: DataFrame, key: str, url: str = "url", ord_col: str = "ord") -> DataFrame:
    """Counts by class, the first offender, and the text; repeats of a link count each time."""
    kind = Q.link_class(F.col(url))
    bad = links.select(key, F.col(url).alias("url"), F.col(ord_col).alias("o"), kind.alias("kind")).where("kind <> 'secure'")
    by = bad.groupBy(key, "kind").agg(F.count(F.lit(1)).alias("n"), F.min_by("url", "o").alias("first"))
    what = F.when(F.col("kind") == "insecure", "insecure").otherwise("unparsable")
    return by.withColumn("text", F.concat(F.col("n").cast("string"), F.lit(" "), what, F.when(F.col("n") == 1, " link").otherwise(" links")))


def changelog_has(changelog: Column, version: Column) -> Column:
    return F.contains(changelog, F.regexp_extract(version, r"^[^-+]*", 0))


def sdk_tags(roots: DataFrame, sdks: DataFrame, violations: DataFrame) -> DataFrame:
    """(root, sdk) of every SDK that no violation speaks against. sdks: (sdk), a fixed list."""
    return roots.crossJoin(sdks).join(violations.select("root", "sdk").distinct(), ["root", "sdk"], "left_anti")


def beyond_allowed(declared: Column, allowed: Column) -> Column:
    """Declared SDKs, the language's own among them, that are not allowed."""
    return F.array_except(F.array_union(declared, F.array(F.lit("dart"))), allowed)


def first_failure(checks: DataFrame, key: str, order: str, ok: str) -> DataFrame:
    """The first runtime in order that fails; null if all pass."""
    return checks.groupBy(key).agg(F.min(F.when(~F.col(ok), F.col(order))).alias("failed_at"))


def merged_tags(results: DataFrame, key: str, tags: str, notes: str) -> DataFrame:
    """Union of tags and all explanations of one key."""
    flat = results.select(key, F.explode_outer(tags).alias("t")).groupBy(key).agg(F.array_sort(F.collect_set("t")).alias("tags"))
    text = results.select(key, F.posexplode_outer(notes).alias("p", "n")).groupBy(key).agg(F.count("n").alias("notes"))
    return flat.join(text, key)


def previous_equal(diffs: DataFrame, key: str, ord_col: str, op: str, text: str) -> DataFrame:
    """Each row with the last equal text before it."""
    order = Window.partitionBy(key).orderBy(ord_col).rowsBetween(Window.unboundedPreceding, -1)
    return diffs.withColumn("before", F.last(F.when(F.col(op) == "equal", F.col(text)), ignorenulls=True).over(order))


def selected(listing: DataFrame, name: str, age_days: Column, most_days: int, limit: int) -> DataFrame:
    """Names young enough, distinct, the first `limit` in order. The limit is the caller's."""
    return listing.where(age_days <= most_days).select(name).distinct().orderBy(name).limit(limit)


def plugin_tags(files: DataFrame, key: str, path: str, content: str) -> DataFrame:
    """Build-system tags: a Swift package for every system that has a native folder, and no old Kotlin plugin."""
    from ..functions.diagnostics import old_kotlin_build

    p, c = F.col(path), F.coalesce(F.col(content), F.lit(""))
    old = (p.endswith("build.gradle") & old_kotlin_build(c, True)) | (p.endswith("build.gradle.kts") & old_kotlin_build(c, False))
    agg = [F.max(p.rlike(rf"^{s}/")).alias(s) for s in ("ios", "macos", "darwin", "android")] + [F.max(p.rlike(rf"^{s}/.*Package\.swift$")).alias(f"{s}_swift") for s in ("ios", "macos", "darwin")]
    by = files.groupBy(key).agg(*agg, F.max(old).alias("old"))
    native = F.col("ios") | F.col("macos") | F.col("darwin")
    swift = native & (~F.col("ios") | F.col("ios_swift")) & (~F.col("macos") | F.col("macos_swift")) & (~F.col("darwin") | F.col("darwin_swift"))
    return by.select(key, swift.alias("swift_package"), (F.col("android") & ~F.col("old")).alias("kotlin_ready"))
