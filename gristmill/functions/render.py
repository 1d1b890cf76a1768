"""Findings as Markdown: places in files, issues, sections, platform lists and import paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is shown of a place in a file, and of its excerpt.
MOST_SPAN, MOST_EXCERPT, CUT_EXCERPT = 512, 1024, 1020
#: Platforms that count for the score, in this order, by their tag.
PLATFORM_NAMES = {"platform:ios": "iOS", "platform:android": "Android", "platform:web": "Web", "platform:windows": "Windows", "platform:macos": "macOS", "platform:linux": "Linux"}


def source_span(text: Column, line: Column, col: Column, length: Column) -> Column:
    """struct(start, length, text) of a place given by line and column from 1: at most MOST_SPAN characters, no carriage
    return at either end; null where the place is not in the text or nothing is left."""
    lines = F.split(text, "\n")
    before = F.aggregate(F.slice(lines, F.lit(1), F.greatest(line - 1, F.lit(0))), F.lit(0), lambda acc, x: acc + F.length(x) + 1)
    size = F.length(text)
    start = before + col - 1
    # a line ends with its break; the last one may be left at its end
    ends = before + F.length(F.get(lines, line - 1)) + F.when(line < F.size(lines), 1).otherwise(0)
    inside = (line >= 1) & (col >= 1) & (line <= F.size(lines)) & (start <= ends)
    rest = F.substr(text, start + 1)
    moved = start + F.length(rest) - F.length(F.regexp_replace(rest, r"^\r+", ""))
    cut = F.substr(text, moved + 1, F.least(length, F.lit(MOST_SPAN), size - moved))
    shown = F.regexp_replace(cut, r"\r+$", "")
    return F.when(inside & (F.length(shown) > 0) & (length > 0), F.struct(moved.alias("start"), F.length(shown).alias("length"), shown.alias("text")))


def key_span(manifest: Column, key: str) -> Column:
    """struct(start, length, text) of the value of a key at the left margin of a YAML text, cut at MOST_SPAN."""
    value = F.regexp_extract(manifest, rf"(?m)^{key}[ \t]*:[ \t]*(\S.*?)[ \t]*$", 1)
    head = F.regexp_extract(manifest, rf"(?s)^(.*?(?:^|\n){key}[ \t]*:[ \t]*)\S", 1)
    shown = F.substr(value, F.lit(1), F.lit(MOST_SPAN))
    return F.when(value != "", F.struct(F.length(head).alias("start"), F.length(shown).alias("length"), shown.alias("text")))


def span_markdown(path: Column, line: Column, col: Column, excerpt: Column) -> Column:
    """path:line:column, from 1, and the excerpt as a code block, cut if it is long. line and col count from 0."""
    shown = F.when(F.length(excerpt) > MOST_EXCERPT, F.concat(F.substr(excerpt, F.lit(1), F.lit(CUT_EXCERPT)), F.lit("\n[...]"))).otherwise(excerpt)
    return F.concat(F.lit("`"), path, F.lit(":"), (line + 1).cast("string"), F.lit(":"), (col + 1).cast("string"), F.lit("`\n\n```\n"), shown, F.lit("\n```\n"))


def issue_markdown(description: Column, span: Column, suggestion: Column) -> Column:
    """A bullet; with a place or a suggestion, a folded block."""
    folded = F.array_compact(F.array(F.lit("<details>"), F.lit("<summary>"), description, F.lit("</summary>"), F.lit(""), span, suggestion, F.lit("</details>")))
    return F.when(span.isNull() & suggestion.isNull(), F.concat(F.lit("* "), description)).otherwise(F.array_join(folded, "\n"))


def _ended(text: Column) -> Column:
    return F.when(text.endswith("\n"), text).otherwise(F.concat(text, F.lit("\n")))


def subsection_markdown(marker: Column, granted: Column, most: Column, title: Column, prefix: Column, paragraphs: Column, issues: Column, limit: int = 2) -> Column:
    """Head line, body, a note on what is left out, and the paragraphs shown (an array)."""
    head = F.concat(F.lit("### "), marker, F.lit(" "), granted.cast("string"), F.lit("/"), most.cast("string"), F.lit(" points: "), title, F.lit("\n"))
    note = F.when(issues > limit, F.concat(F.lit("Found "), issues.cast("string"), F.lit(f" issues. Showing the first {limit}:\n")))
    parts = F.concat(F.array_compact(F.array(head, F.nullif(prefix, F.lit("")), note)), F.transform(paragraphs, _ended))
    return F.array_join(parts, "\n")


def summary(introduction: Column, subsections: Column) -> Column:
    """All parts of a section, an empty line between them."""
    parts = F.concat(F.array_compact(F.array(introduction)), subsections)
    return F.array_join(F.transform(parts, _ended), "\n")


def import_path(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, lambda n: F.concat(F.lit("* `"), n, F.lit("`"))), " that imports:\n")


def dependency_path(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, lambda n: F.concat(F.lit("* `"), n, F.lit("`"))), " that depends on:\n")


def platform_list(tags: Column) -> Column:
    """All platforms that count, the tagged ones in bold."""
    names = [F.when(F.array_contains(tags, t), f"**{n}**").otherwise(n) for t, n in PLATFORM_NAMES.items()]
    return F.concat_ws(", ", *names)


def explanations_shown(tags: Column, explanations: Column, second_kit: Column) -> Column:
    """struct(sdk, unsupported, trusted) of explanations (tag, text): those of SDKs where no SDK is tagged (for the kit's
    packages not that of the plain SDK if any platform is tagged), those of platforms without a tag or with one that
    counts and is not granted, and those of granted tags."""
    has = lambda start: F.exists(tags, lambda t: t.startswith(start))
    counted = F.array(*map(F.lit, PLATFORM_NAMES))
    granted = F.array_intersect(tags, counted)
    mine = F.filter(explanations, lambda e: second_kit | ~e["tag"].eqNullSafe(F.lit("runtime:native-aot")))
    sdk = F.filter(explanations, lambda e: e["tag"].startswith("sdk:") & ~(has("platform:") & second_kit & (e["tag"] == "sdk:dart")))
    unsupported = F.filter(mine, lambda e: e["tag"].isNull() | (F.array_contains(counted, e["tag"]) & ~F.array_contains(granted, e["tag"])))
    trusted = F.filter(mine, lambda e: F.coalesce(F.array_contains(tags, e["tag"]), F.lit(False)))
    none = F.filter(sdk, lambda _: F.lit(False))
    return F.struct(F.when(has("sdk:"), none).otherwise(sdk).alias("sdk"), unsupported.alias("unsupported"), trusted.alias("trusted"))


def dependency_table(rows: Column) -> Column:
    """A Markdown table of (package, constraint, compatible, latest, discontinued, outdated)."""
    dash = lambda c: F.coalesce(c, F.lit("-"))
    row = lambda r: F.concat(F.lit("|[`"), r["package"], F.lit("`]|"), F.coalesce(F.concat(F.lit("`"), r["constraint"], F.lit("`")), F.lit("-")), F.lit("|"), dash(r["compatible"]), F.lit("|"), F.when(r["outdated"], F.concat(F.lit("**"), dash(r["latest"]), F.lit("**"))).otherwise(dash(r["latest"])), F.lit("|"), F.when(r["discontinued"], "**Discontinued**").otherwise(""), F.lit("|"))
    head = F.array(F.lit("|Package|Constraint|Compatible|Latest|Notes|"), F.lit("|:-|:-|:-|:-|:-|"))
    return F.array_join(F.concat(head, F.transform(rows, row)), "\n")
