"""Platform and SDK verdicts of packages: declared platforms, imports and runtimes, and the first reason against each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import render
from ..functions import rules
from .graphs import reach


def declared(packages: DataFrame) -> DataFrame:
    """(package, platforms) of the packages (package, manifest) that declare any."""
    return packages.select("package", rules.declared_platforms(F.col("manifest")).alias("platforms")).where("platforms is not null")


def leaves(libraries: DataFrame, declared_: DataFrame) -> DataFrame:
    """(node) of the libraries whose packages speak for themselves: a search that trusts them does not go past them."""
    named = libraries.select("node", rules.package_of(F.col("node")).alias("package"))
    return named.join(declared_.select("package", "platforms"), "package", "left").where(rules.has_declared_platforms(F.col("node"), F.col("platforms"))).select("node")


def declared_violations(reached: DataFrame, declared_: DataFrame, platforms: DataFrame) -> DataFrame:
    """(root, platform, path, platforms): the first node of each root whose package declares platforms without this one;
    platforms: (platform), a fixed list."""
    named = reached.withColumn("package", rules.package_of(F.col("node")))
    bad = named.join(declared_, "package").join(F.broadcast(platforms), ~F.array_contains(F.col("platforms"), F.col("platform")))
    return _first(bad, ["root", "platform"], ["platforms"])


def runtime_violations(reached: DataFrame, imports: DataFrame, enabled: DataFrame, runtimes: DataFrame) -> DataFrame:
    """(root, runtime, path, lib): the first node of each root that imports a library which the runtime lacks. imports:
    (node, lib); enabled: (runtime, lib) and runtimes: (runtime), fixed lists."""
    bad = reached.join(imports, "node").join(F.broadcast(runtimes)).join(F.broadcast(enabled), ["runtime", "lib"], "left_anti")
    return _first(bad, ["root", "runtime"], ["lib"])


def _first(bad: DataFrame, keys: list[str], more: list[str]) -> DataFrame:
    """The row with the shortest path of each key, the least of equals; an aggregate, so that it combines before it moves."""
    best = F.min(F.struct(F.size("path").alias("n"), "path", *more)).alias("b")
    return bad.groupBy(*keys).agg(best).select(*keys, "b.path", *[f"b.{m}" for m in more])


def first_violation(libraries: DataFrame, package_bad: DataFrame, library_bad: DataFrame, runtime_bad: DataFrame, keys: list[str], targets: DataFrame) -> DataFrame:
    """(package, keys, reason) for each package and target that something speaks against: without libraries what its own
    dependencies declare, else the first of its libraries (package, root, ord), and of that what is declared before what
    is imported. The bad tables hold a text `reason`: by package, and by root."""
    none = targets.join(libraries.select("package").distinct(), "package", "left_anti").join(package_bad, ["package", *keys]).select("package", *keys, "reason")
    both = library_bad.withColumn("rank", F.lit(0)).unionByName(runtime_bad.withColumn("rank", F.lit(1)))
    of_libraries = libraries.join(both, "root").groupBy("package", *keys).agg(F.min(F.struct("ord", "rank", "reason")).alias("b")).select("package", *keys, "b.reason")
    return none.unionByName(of_libraries.join(targets.select("package").distinct(), "package", "left_semi"))


def sdk_violations(package_paths: DataFrame, sdks_of: DataFrame, allowed: DataFrame) -> DataFrame:
    """(root, sdk, path, beyond): the first package below each root that needs an SDK which this one does not allow. sdks_of:
    (node, sdks); allowed: (sdk, allowed), a fixed list."""
    needed = F.array_union("sdks", F.array(F.lit("dart")))
    rows = package_paths.join(sdks_of, "node").crossJoin(F.broadcast(allowed)).withColumn("beyond", F.array_sort(F.array_except(needed, "allowed")))  # a fixed number of SDKs
    return _first(rows.where(F.size("beyond") > 0), ["root", "sdk"], ["beyond"])


def sdk_verdicts(targets: DataFrame, declared_bad: DataFrame, libraries: DataFrame, runtime_bad: DataFrame, sdks: DataFrame) -> DataFrame:
    """(package, sdk, reason): what the packages below declare, else the first library in order with a bad import; null
    where the SDK holds. sdks: (sdk, runtime), a fixed list."""
    own = declared_bad.select(F.col("root").alias("package"), "sdk", F.concat(F.lit("Because:\n"), render.dependency_path(F.col("path")), F.lit(" that is a package requiring "), F.array_join("beyond", ", "), F.lit(".")).alias("declared"))
    libs = libraries.join(runtime_bad, "root").join(F.broadcast(sdks), "runtime").groupBy("package", "sdk").agg(F.min_by("path", "ord").alias("path"))
    imported = libs.select("package", "sdk", F.concat(F.lit("Because:\n"), render.import_path(F.col("path"))).alias("imported"))
    every = targets.select("package").crossJoin(F.broadcast(sdks.select("sdk")))  # a fixed number of SDKs
    return every.join(own, ["package", "sdk"], "left").join(imported, ["package", "sdk"], "left").select("package", "sdk", F.coalesce("declared", "imported").alias("reason"))


def wasm_ready(targets: DataFrame, libraries: DataFrame, web_libraries: DataFrame, runtime_bad: DataFrame) -> DataFrame:
    """(package, ready): no library, nor a plugin's library for the web, imports what the runtime lacks."""
    roots = libraries.select("package", "root").unionByName(web_libraries.select("package", "root"))
    bad = roots.join(runtime_bad.where("runtime = 'wasm'").select("root"), "root", "left_semi").select("package").distinct().withColumn("bad", F.lit(True))
    return targets.select("package").join(bad, "package", "left").select("package", F.col("bad").isNull().alias("ready"))


def web_libraries(packages: DataFrame, files: DataFrame) -> DataFrame:
    """(package, root) of the plugins' libraries for the web that are there. files: (root)."""
    named = packages.select("package", rules.web_plugin_library(F.col("package"), F.col("manifest")).alias("root")).where("root is not null")
    return named.join(files.select("root"), "root", "left_semi").select("package", "root")


def succeeded(tags: Column, explanations: Column) -> Column:
    """Whether a check gave tags and nothing to explain."""
    return (F.size(tags) > 0) & (F.size(explanations) == 0)


def merged(results: DataFrame, keys: list[str]) -> DataFrame:
    """Tags and explanations of all results of one key, each once: tags sorted, explanations in the order of the results
    (keys, ord, tags, explanations)."""
    tags = results.select(*keys, F.explode_outer("tags").alias("t")).groupBy(*keys).agg(F.array_sort(F.collect_set("t")).alias("tags"))
    said = results.select(*keys, "ord", F.posexplode_outer("explanations").alias("p", "e"))
    first = said.where("e is not null").groupBy(*keys, "e").agg(F.min(F.struct("ord", "p")).alias("at"))
    texts = first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "e"))), lambda x: x["e"]).alias("explanations"))
    return tags.join(texts, keys, "left").withColumn("explanations", F.coalesce("explanations", F.array().cast(results.schema["explanations"].dataType)))


def reached_libraries(edges: DataFrame, roots: DataFrame, trusted: DataFrame | None = None) -> DataFrame:
    """(root, node, path); `trusted` libraries are entered, but not left. A root that is trusted is not left either."""
    return reach(edges, roots, leaves=trusted)
