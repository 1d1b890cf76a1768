"""Small rules over manifests, links, processes, paths and JSON texts, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import link_verdict, trimmed_output

#: Keys of the old form of a plugin's description.
OLD_PLUGIN_KEYS = ("androidPackage", "iosPrefix", "pluginClass")
#: Platforms that a package may declare.
DECLARABLE = ("android", "ios", "linux", "macos", "web", "windows")


def json_value(text: Column) -> Column:
    """The text as a variant; null where it is no JSON."""
    return F.try_parse_json(text)


def json_object(output: Column) -> Column:
    """struct(keys, error): the keys of a process's JSON output, or, where it is no object, the output in short."""
    out = F.trim(output)
    keys = F.json_object_keys(F.when(F.try_parse_json(out).isNotNull() & out.startswith("{"), out))
    error = F.concat(F.lit("Unable to parse output as JSON:\n\n```\n"), trimmed_output(out), F.lit("\n```\n"))
    return F.struct(F.array_sort(keys).alias("keys"), F.when(keys.isNull(), error).alias("error"))


def _keys(manifest: Column, path: str) -> Column:
    """The keys of the object at a path; null where there is none."""
    inner = F.get_json_object(manifest, path)
    return F.json_object_keys(F.when(inner.startswith("{"), inner))


def _is_text(manifest: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(F.try_parse_json(manifest), path, "variant")) == "STRING", F.lit(False))


def declared_platforms(manifest: Column) -> Column:
    """The platforms that a manifest (JSON) names: those of its own map; else, of a plugin, those of the plugin's map, or
    android and ios for a plugin of the old form; null where nothing is declared."""
    known = F.array(*map(F.lit, DECLARABLE))
    own, plugin, inner = _keys(manifest, "$.platforms"), _keys(manifest, "$.flutter.plugin"), _keys(manifest, "$.flutter.plugin.platforms")
    old = F.lit(False)
    for k in OLD_PLUGIN_KEYS:
        old = old | _is_text(manifest, f"$.flutter.plugin.{k}")
    legacy = F.when(old, F.array(F.lit("android"), F.lit("ios"))).otherwise(F.array().cast("array<string>"))
    return F.when(own.isNotNull(), F.array_intersect(known, own)).when(plugin.isNotNull(), F.when(inner.isNotNull(), F.array_intersect(known, inner)).otherwise(legacy))


def has_declared_platforms(uri: Column, declared: Column) -> Column:
    return ~uri.startswith("package:") | declared.isNotNull()


def is_plugin(manifest: Column) -> Column:
    return F.coalesce(F.array_contains(_keys(manifest, "$.flutter"), "plugin"), F.lit(False))


def old_plugin_format(manifest: Column) -> Column:
    return F.coalesce(F.arrays_overlap(_keys(manifest, "$.flutter.plugin"), F.array(*map(F.lit, OLD_PLUGIN_KEYS))), F.lit(False))


def web_plugin_library(package: Column, manifest: Column) -> Column:
    """The URI of a plugin's library for the web, by its own name for it or the usual one; null where there is none."""
    web = "$.flutter.plugin.platforms.web"
    name = F.when(_is_text(manifest, f"{web}.fileName"), F.get_json_object(manifest, f"{web}.fileName")).otherwise(F.concat(package, F.lit("_web.dart")))
    return F.when(_keys(manifest, web).isNotNull(), F.concat(F.lit("package:"), package, F.lit("/"), name))


def executables(manifest: Column) -> Column:
    """map(name, file), both trimmed; a null file is an empty one."""
    text = F.get_json_object(manifest, "$.executables")
    raw = F.from_json(F.when(text.startswith("{"), text), "map<string,string>")
    pairs = F.transform(F.map_entries(raw), lambda e: F.struct(F.trim(e["key"]).alias("key"), F.trim(F.coalesce(e["value"], F.lit(""))).alias("value")))
    return F.coalesce(F.map_from_entries(pairs), F.create_map().cast("map<string,string>"))


def executable_file(name: Column, file: Column) -> Column:
    """The file in bin that an executable stands for."""
    return F.when(file.endswith(".dart"), file).otherwise(F.concat(F.when(file == "", name).otherwise(file), F.lit(".dart")))


def in_bin(path: Column) -> Column:
    """Whether a path is a program of the folder bin itself."""
    return path.rlike(r"^bin/[^/]+\.dart$")


def package_of(uri: Column) -> Column:
    return F.nullif(F.regexp_extract(uri, "^package:([^/]+)", 1), F.lit(""))


def warns_of_old_constraint(compatible: Column, latest: Column) -> Column:
    """A constraint that allows the second major version, but not all of it."""
    return compatible & ~latest


def was_error(flag: Column, exit_code: Column, timeout: Column, too_long: Column) -> Column:
    return flag | (exit_code != 0) | timeout | too_long


def remaining_seconds(total: Column, elapsed: Column) -> Column:
    """What is left of a time budget, at least a second; null where there is no budget."""
    return F.when(total.isNotNull(), F.greatest(total - elapsed, F.lit(1)))


def seconds(text: Column) -> Column:
    """An interval of whole seconds; null for an empty text, an error for any other."""
    number = F.when(text.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(text).cast("long")).otherwise(F.raise_error(F.concat(F.lit("not a number of seconds: "), text)).cast("long"))
    return F.when(F.coalesce(text, F.lit("")) != "", F.make_dt_interval(secs=number))


def is_branch(name: Column) -> Column:
    return name.rlike("^[a-z0-9]+")


def is_plain_path(path: Column) -> Column:
    """A path in its shortest form, of steps that begin with usual characters."""
    steps = F.split(path, "/")
    short = (path == ".") | ~F.exists(steps, lambda s: s.isin("", "."))
    climbs = F.aggregate(steps, F.struct(F.lit(True).alias("up"), F.lit(True).alias("ok")), lambda acc, s: F.struct((acc["up"] & (s == "..")).alias("up"), (acc["ok"] & (acc["up"] | (s != ".."))).alias("ok")), lambda acc: acc["ok"])
    return short & climbs & ~F.exists(steps, lambda s: ~s.rlike(r"^[a-zA-Z0-9_\-.]+"))


def required(value: Column, what: Column) -> Column:
    """The value; an error where it is null."""
    return F.coalesce(value, F.raise_error(what).cast("string"))


def manifest_link(kind: Column, url: Column, needed: Column, exists: Column) -> Column:
    """struct(url, issue, accepted) of an entry whose JSON kind is `kind` (null if it is not there). Anything but a text is
    rejected; an empty one too, with an issue only if it is needed; else the ladder of links decides."""
    verdict = link_verdict(url, exists)
    issue = F.when(kind != "STRING", "not a text").when(F.coalesce(url, F.lit("")) == "", F.when(needed, "missing entry")).when(verdict != "ok", F.regexp_replace(verdict, "^.*: ", ""))
    empty = kind.isNull() | (kind != "STRING") | (F.coalesce(url, F.lit("")) == "")
    accepted = ~empty & ~verdict.startswith("rejected")
    return F.struct(F.when(~empty, url).alias("url"), issue.alias("issue"), accepted.alias("accepted"))


def is_verified(link: Column) -> Column:
    return link["url"].isNotNull() & link["accepted"] & link["issue"].isNull()


def accepted_url(link: Column) -> Column:
    return F.when(link["accepted"], link["url"])


def links_verdict(links: Column) -> Column:
    """struct(issues, rejected) of an array of links: their issues in order, and whether one with an issue is rejected."""
    issues = F.array_compact(F.transform(links, lambda x: x["issue"]))
    return F.struct(issues.alias("issues"), F.exists(links, lambda x: x["issue"].isNotNull() & ~x["accepted"]).alias("rejected"))


def looked_up(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """rows with what `known` says of their keys; the side of `known` holds each key once, whatever the rows repeat."""
    return rows.join(known.dropDuplicates(keys), keys, "left")


def library_urls(entries: DataFrame, key: str, ord_col: str) -> DataFrame:
    """(key, urls): a map from the first step of each library's qualified name to its link; of equal names the last counts."""
    named = entries.where(F.col("is_library") & F.col("qualified").isNotNull() & F.col("href").isNotNull()).withColumn("name", F.substring_index("qualified", ".", 1))
    last = named.groupBy(key, "name").agg(F.max_by("href", ord_col).alias("href"))
    return last.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "href")))).alias("urls"))


def without_sdk_packages(outdated: DataFrame, locks: DataFrame, name: str = "package") -> DataFrame:
    """Rows of packages that the lock file does not take from an SDK."""
    return outdated.join(locks.where("source = 'sdk'").select(name), name, "left_anti")


def image_paths(path: Column) -> Column:
    """Where the pictures made from a screenshot lie: itself as WebP, and thumbnails of two sizes in two formats."""
    name = F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", "")
    made = [("webp", "gen/", ".webp"), ("webp_100", "gen/100x100/", ".webp"), ("png_100", "gen/100x100/", ".png"), ("webp_190", "gen/190x190/", ".webp"), ("png_190", "gen/190x190/", ".png")]
    return F.struct(*[F.concat(F.lit(folder), name, F.lit(end)).alias(n) for n, folder, end in made])


def thumbnail_size(width: Column, height: Column, most: int) -> Column:
    """struct(width, height): the longer side is `most`, 0 stands for what follows from it."""
    wide = width > height
    return F.struct(F.when(wide, most).otherwise(0).alias("width"), F.when(wide, 0).otherwise(most).alias("height"))


def kit_version(json_text: Column, plain_text: Column) -> Column:
    """The version in the JSON file, else the plain text's; an error where neither is there."""
    return F.coalesce(F.get_json_object(json_text, "$.frameworkVersion"), F.nullif(F.btrim(plain_text, F.lit(" \t\r\n")), F.lit("")), F.raise_error(F.lit("no version file")).cast("string"))


def analysis_result(homepage: Column, repository: Column, tracker: Column, documentation: Column, funding: Column, granted: Column, most: Column) -> Column:
    """What is kept of an analysis: the accepted links (structs of `manifest_link`; funding is an array of them, null where
    none is accepted) and the points."""
    paid = F.filter(F.transform(funding, accepted_url), lambda u: u.isNotNull())
    links = [accepted_url(x).alias(n) for n, x in (("homepage", homepage), ("repository", repository), ("tracker", tracker), ("documentation", documentation))]
    return F.struct(*links, F.when(F.size(paid) > 0, paid).alias("funding"), granted.alias("granted"), most.alias("max"))
