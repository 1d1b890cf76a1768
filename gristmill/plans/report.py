"""The scored report of packages: five sections of subsections, from a table of findings, one row a package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import scoring as S

#: Sections in the order of a report, with their titles.
SECTIONS = {
    "convention": "Follow Dart file conventions",
    "documentation": "Provide documentation",
    "platform": "Platform support",
    "analysis": "Pass static analysis",
    "dependency": "Support up-to-date dependencies",
}
#: Findings that a row holds besides its key.
FINDINGS = {
    "readable": "boolean",  # whether the manifest could be read at all
    "manifest_issues": "long", "rejected_urls": "long", "accepted_issues": "long",
    "readme_issues": "long", "changelog_issues": "long",
    "licence_found": "boolean", "licence_open": "boolean",
    "documented_ratio": "double",  # null where documentation was not built
    "example": "boolean", "screenshot_problems": "long",
    "platforms": "long", "web": "boolean", "wasm": "boolean", "old_build": "boolean",
    "errors": "long", "warnings": "long", "others": "long",
    "allows_current": "boolean", "worst_update": "int", "discontinued": "boolean",
    "has_sdk": "boolean", "kit_allowed": "boolean",
    "downgrade_errors": "long",
}


def _rules() -> list[tuple[str, str, Column, Column | None]]:
    """(section, name, points, when it counts)."""
    c = F.col
    supported = S.latest_supported(c("worst_update"), c("discontinued"))
    return [
        ("convention", "manifest", S.manifest(c("manifest_issues"), c("rejected_urls"), c("accepted_issues")), None),
        ("convention", "readme", S.asset(c("readme_issues")), None),
        ("convention", "changelog", S.asset(c("changelog_issues")), None),
        ("convention", "licence", S.licences(c("licence_found"), c("licence_open")), None),
        ("documentation", "coverage", S.doc_coverage(c("documented_ratio")), c("documented_ratio").isNotNull()),
        ("documentation", "example", S.example(c("example"), c("screenshot_problems")), None),
        ("platform", "platforms", S.platforms(c("platforms"), c("web"), c("wasm"), c("old_build")), None),
        ("analysis", "diagnostics", S.static_analysis(c("errors"), c("warnings"), c("others")), None),
        ("dependency", "latest", F.when(c("allows_current"), supported).otherwise(S.subsection(F.lit(0), 10)), None),
        ("dependency", "sdk", S.sdk_support(c("has_sdk"), c("allows_current") & c("kit_allowed")), None),
        ("dependency", "lower_bounds", S.lower_bounds(c("downgrade_errors")), None),
    ]


def subsections(findings: DataFrame, key: str) -> DataFrame:
    """(key, section, name, granted, max, status), by one pass; a package whose manifest cannot be read has one failed
    subsection of 100 points instead."""
    kind = "struct<section:string,name:string,granted:int,max:int,status:string>"

    def row(section: str, name: str, points: Column, counts: Column | None) -> Column:
        r = F.struct(F.lit(section).alias("section"), F.lit(name).alias("name"), points["granted"].alias("granted"), points["max"].alias("max"), points["status"].alias("status")).cast(kind)
        return r if counts is None else F.when(counts, r)

    rows = F.array_compact(F.array(*[row(*r) for r in _rules()]))
    broken = F.array(F.struct(F.lit("convention"), F.lit("unreadable"), F.lit(0), F.lit(100), F.lit("failed")).cast(kind))
    return findings.select(key, F.explode(F.when(F.col("readable"), rows).otherwise(broken)).alias("r")).select(key, "r.*")


def sections(findings: DataFrame, key: str) -> DataFrame:
    """(key, ord, section, title, granted, max, status), the parts of each report in their order."""
    at = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("section")).cast("int")
    title = F.coalesce(*[F.when(F.col("section") == k, v) for k, v in SECTIONS.items()])
    found = subsections(findings, key)
    broken = found.groupBy(key).agg(F.bool_or(F.col("name") == "unreadable").alias("broken"))
    out = S.sections(found, [key, "section"]).join(broken, key)
    return out.select(key, at.alias("ord"), "section", F.when(F.col("broken"), "Failed to parse the manifest").otherwise(title).alias("title"), "granted", "max", "status")


def totals(findings: DataFrame, key: str) -> DataFrame:
    """(key, granted, max): 160 points at most where documentation was built, 150 where it was not, 100 for a manifest that
    cannot be read."""
    return S.totals(subsections(findings, key), key)
