"""Rules to scores: points of subsections, sections and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: From worst to best.
STATUSES = ("failed", "partial", "passed")


def status_rank(status: Column) -> Column:
    return F.coalesce(*[F.when(status == s, k) for k, s in enumerate(STATUSES)])


def status_name(rank: Column) -> Column:
    return F.get(F.array(*map(F.lit, STATUSES)), rank)


def lower_status(a: Column, b: Column) -> Column:
    """The lesser of two ranks; null if either is."""
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def marker(status: Column) -> Column:
    return F.coalesce(F.when(status == "passed", "[*]"), F.when(status == "partial", "[~]"), F.when(status == "failed", "[x]"))


def sections(subsections: DataFrame, keys: list[str]) -> DataFrame:
    """Points and least status of each section; a section without subsections has passed."""
    lowest = F.coalesce(F.min(status_rank(F.col("status"))), F.lit(2))
    return subsections.groupBy(*keys).agg(F.coalesce(F.sum("granted"), F.lit(0)).alias("granted"), F.coalesce(F.sum("max"), F.lit(0)).alias("max"), status_name(lowest).alias("status"))


def totals(sections_: DataFrame, key: str) -> DataFrame:
    return sections_.groupBy(key).agg(F.sum("granted").alias("granted"), F.sum("max").alias("max"))


def exit_code(totals_: DataFrame, threshold: int) -> Column:
    """127 from `threshold` missing points on."""
    return F.when(F.col("max") - F.col("granted") >= threshold, 127).otherwise(0)


def subsection(granted: Column, most: int, status: Column | None = None) -> Column:
    by_points = F.when(granted == most, "passed").when(granted > 0, "partial").otherwise("failed")
    return F.struct(granted.cast("int").alias("granted"), F.lit(most).alias("max"), F.coalesce(status, by_points).alias("status") if status is not None else by_points.alias("status"))


def manifest(issues: Column, rejected_urls: Column, accepted_issues: Column) -> Column:
    bad = (issues > 0) | (rejected_urls > 0)
    return subsection(F.when(bad, 0).otherwise(10), 10, F.when(~bad & (accepted_issues > 0), "partial"))


def asset(issues: Column) -> Column:
    return subsection(F.when(issues == 0, 5).otherwise(0), 5)


def licences(detected: Column, all_open: Column) -> Column:
    return subsection(F.when(detected & all_open, 10).when(detected, 5).otherwise(0), 10)


def doc_coverage(ratio: Column) -> Column:
    return subsection(F.when(ratio >= 0.2, 10).otherwise(0), 10, F.when(ratio < 0.2, "partial"))


def example(found: Column, screenshot_problems: Column) -> Column:
    return subsection(F.when(found & (screenshot_problems == 0), 10).otherwise(0), 10)


def platforms(count: Column, web: Column, wasm: Column, old_build: Column) -> Column:
    return subsection(F.when(count == 0, 0).when((web & ~wasm) | old_build, 10).otherwise(20), 20)


def static_analysis(errors: Column, warnings: Column, others: Column) -> Column:
    points = F.when(errors > 0, 0).when(warnings > 0, 30).when(others > 0, 40).otherwise(50)
    return subsection(points, 50, F.when((errors == 0) & (warnings == 0) & (others > 0), "partial").when((errors == 0) & (warnings > 0), "failed"))


def latest_supported(worst: Column, discontinued: Column) -> Column:
    """worst: 0 outdated, 1 recent, 2 preview, null none. Points stay for the milder ones."""
    bad = (worst == 0) | discontinued
    fails = F.coalesce(bad, discontinued)
    return subsection(F.when(fails, 0).otherwise(10), 10, F.when(~fails & worst.isin(1, 2), "partial"))


def sdk_support(has: Column, allows_current: Column) -> Column:
    return subsection(F.when(has & allows_current, 10).otherwise(0), 10)


def lower_bounds(errors: Column) -> Column:
    return subsection(F.when(errors == 0, 20).otherwise(0), 20)


def issue_text(subject: Column, count: Column, shown: Column) -> Column:
    return F.concat(F.lit("Found "), count.cast("string"), F.lit(" "), subject, F.when(count == 1, "").otherwise("s"), F.lit("."), F.when(shown < count, F.concat(F.lit(" Showing the first "), shown.cast("string"), F.lit("."))).otherwise(""))
