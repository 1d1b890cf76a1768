"""Reachability over edge tables: violations, paths to them, and the tags that follow."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.session import kept

# Libraries that all runtimes, native ones and those of the web offer.
_COMMON = ("async", "collection", "convert", "core", "developer", "math", "typed_data", "_internal")
_NATIVE = ("ffi", "io", "isolate")
_WEB = ("html", "html_common", "indexed_db", "js", "js_interop", "js_interop_unsafe", "js_util", "svg", "web_audio", "web_gl", "web_sql", "_js_annotations")
#: Libraries that each runtime offers.
RUNTIMES = {
    "native-aot": (*_COMMON, *_NATIVE, "cli", "nativewrappers"),
    "native-jit": (*_COMMON, *_NATIVE, "cli", "mirrors", "nativewrappers"),
    "web": (*_COMMON, *_WEB),
    "wasm": (*_COMMON, "ui", "ui_web", "js_interop", "js_interop_unsafe"),
    "flutter-native": (*_COMMON, *_NATIVE, "ui"),
    "flutter-web": (*_COMMON, *_WEB, "ui", "ui_web"),
}
#: The runtimes of platform and SDK checks: those of the kit's user interface are let through, or nearly all is.
BROAD_RUNTIMES = {
    "native": (*_COMMON, *_NATIVE, "ui"),
    "web": (*_COMMON, *_WEB, "ui"),
    "dart": tuple(dict.fromkeys((*RUNTIMES["native-jit"], *_WEB))),
    "flutter": tuple(dict.fromkeys((*_COMMON, *_NATIVE, "cli", *_WEB, *RUNTIMES["flutter-native"], *RUNTIMES["flutter-web"]))),
}
#: Platforms in this order, with the plain runtime and the one of the user interface kit.
PLATFORMS = (
    ("android", "native-aot", "flutter-native"),
    ("ios", None, "flutter-native"),
    ("windows", "native-jit", "flutter-native"),
    ("linux", "native-jit", "flutter-native"),
    ("macos", "native-jit", "flutter-native"),
    ("web", "web", "flutter-web"),
)


def runtime_table(spark, runtimes: dict | None = None) -> DataFrame:
    return spark.createDataFrame([(r, x) for r, libs in (runtimes or RUNTIMES).items() for x in libs], "runtime string, lib string")


def chosen_edges(edges: DataFrame, runtimes: DataFrame) -> DataFrame:
    """(runtime, src, slot, dst): of the conditional targets (src, slot, dst, rank, lib) of one import, the first whose library
    the runtime has; a null library always holds."""
    each = edges.crossJoin(runtimes.select("runtime").distinct()).join(runtimes.withColumn("has", F.lit(True)), ["runtime", "lib"], "left")  # a fixed number of runtimes
    return each.where(F.col("lib").isNull() | F.col("has")).groupBy("runtime", "src", "slot").agg(F.min_by("dst", "rank").alias("dst"))


def reach(edges: DataFrame, roots: DataFrame, keys: list[str] | None = None, leaves: DataFrame | None = None) -> DataFrame:
    """(keys, root, node, path): every node with one shortest path from each root, the least of equals.

    A frontier is joined with the edges until it is empty; met nodes are left out by an anti-join, so cycles end and no
    more than one path a node is kept. `leaves` are entered, but not left."""
    keys = keys or []
    seen = roots.select(*keys, "root", F.col("root").alias("node"), F.array("root").alias("path"))
    frontier = seen
    while True:
        from_ = frontier if leaves is None else frontier.join(leaves.select(F.col("node")), "node", "left_anti")
        step = from_.join(edges.select(*keys, F.col("src").alias("node"), "dst"), [*keys, "node"])
        step = step.select(*keys, "root", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        step = step.groupBy(*keys, "root", "node").agg(F.min("path").alias("path")).join(seen.select(*keys, "root", "node"), [*keys, "root", "node"], "left_anti")
        frontier = step.checkpoint()
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)


def depth_first(edges: DataFrame, roots: DataFrame, keys: list[str] | None = None, leaves: DataFrame | None = None) -> DataFrame:
    """(keys, root, node, label, path): every node with the path by which a depth-first search comes to it from each root, if
    a node's last successor (largest `ord` of edges (keys, src, dst, ord), unique among a node's successors) is tried first
    and nodes are entered once.

    That path is the least of all by its label, the list of -ord along it: a search that came to a node later than by the
    least path would have passed one of that path's nodes before, by a path that is less. And all beginnings of a least
    path are least ones. So labels settle round by round, each from those that became less in the round before; a way round
    a cycle has a node's own label as its beginning and is never less. There are as many rounds as the longest of the paths has
    edges. In the order of their labels nodes are entered. `leaves` are entered, but not left."""
    keys = keys or []
    each = [*keys, "root", "node"]
    edges = edges.groupBy(*keys, "src", "dst").agg(F.min("ord").cast("long").alias("ord")).select(*keys, F.col("src").alias("node"), "dst", "ord")
    if leaves is not None:
        edges = edges.join(leaves.select("node").distinct(), "node", "left_anti")
    edges = kept(edges)
    start = F.struct(F.array().cast("array<bigint>").alias("label"), F.array("root").alias("path")).alias("best")
    rounds = [kept(roots.select(*keys, "root", F.col("root").alias("node"), start).distinct())]
    while True:
        settled = reduce(DataFrame.unionByName, rounds).groupBy(*each).agg(F.min("best").alias("best")) if len(rounds) > 1 else rounds[0]
        step = rounds[-1].join(edges, [*keys, "node"])
        grown = F.struct(F.concat("best.label", F.array(-F.col("ord"))).alias("label"), F.concat("best.path", F.array("dst")).alias("path"))
        step = step.select(*keys, "root", F.col("dst").alias("node"), grown.alias("new")).groupBy(*each).agg(F.min("new").alias("new"))
        less = step.join(settled, each, "left").where(F.col("best").isNull() | (F.col("new.label") < F.col("best.label"))).select(*each, F.col("new").alias("best"))
        changed = kept(less)
        if changed.isEmpty():
            return settled.select(*each, "best.label", "best.path")
        rounds = [*rounds, changed] if len(rounds) < 8 else [kept(settled), changed]


def first_wanted(labels: DataFrame, wanted: Column, why: Column, keys: list[str] | None = None) -> DataFrame:
    """(keys, root, path, why): of each root the first node, in the order of a depth-first search, for which the predicate holds,
    with its explanation; both are columns over `labels` and whatever was joined to it."""
    keys = keys or []
    best = F.min_by(F.struct("path", why.alias("why")), "label").alias("b")
    return labels.where(wanted).groupBy(*keys, "root").agg(best).select(*keys, "root", "b.path", "b.why")


def first_found(successors: Callable[[DataFrame], DataFrame], roots: DataFrame, wanted: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, root, path, why): of each root the first node of `wanted` (node, why and any of the keys) that a depth-first search
    meets: what `first_wanted` finds in `depth_first`, without the paths to what the search never comes to.

    `successors` gives the edges (keys, node, dst, ord) of a table of nodes (keys, node), so that edges are joined, chosen and
    combined for those alone. Each root's open nodes are left in the order of their labels, one of each root in the first round
    and twice as many in each further one; a node is left again if a lesser label comes to it later. What is not less than the
    label of a wanted node that was met is dropped, as its own successors are greater still; a root is done when no node of it
    is open. So rounds are about as many as the logarithm of the nodes that the search enters, and tables as large as those and
    their successors."""
    keys = keys or []
    group, each = [*keys, "root"], [*keys, "root", "node"]
    on = [c for c in (*keys, "node") if c in wanted.columns]
    start = F.struct(F.array().cast("array<bigint>").alias("label"), F.array("root").alias("path")).alias("best")
    new = kept(roots.select(*group, F.col("root").alias("node"), start, F.lit(True).alias("open")).distinct())
    states, found, width = [], None, 1
    while True:
        met = new.join(wanted, on).groupBy(*group).agg(F.min(F.struct("best.label", "best.path", "why")).alias("first"))
        found = kept(met if found is None else found.unionByName(met).groupBy(*group).agg(F.min("first").alias("first")))
        rows = reduce(DataFrame.unionByName, [*states, new]).groupBy(*each).agg(F.min(F.struct("best", "open")).alias("s"))  # closed before open
        rows = rows.select(*each, "s.best", "s.open").join(found, group, "left").where(F.col("first").isNull() | (F.col("best.label") < F.col("first.label")))
        state = kept(rows.drop("first"))
        turn = F.row_number().over(Window.partitionBy(*group).orderBy("best.label", "node"))
        chosen = kept(state.where("open").withColumn("turn", turn).where(F.col("turn") <= width).drop("turn"))
        if chosen.isEmpty():
            return found.select(*group, "first.path", "first.why")
        edges = successors(chosen.select(*keys, "node").distinct()).groupBy(*keys, "node", "dst").agg(F.min("ord").cast("long").alias("ord"))
        grown = F.struct(F.concat("best.label", F.array(-F.col("ord"))).alias("label"), F.concat("best.path", F.array("dst")).alias("path"))
        step = chosen.join(edges, [*keys, "node"]).select(*group, F.col("dst").alias("node"), grown.alias("best"))
        new = kept(step.groupBy(*each).agg(F.min("best").alias("best")).withColumn("open", F.lit(True)))
        states, width = [state, chosen.withColumn("open", F.lit(False))], 2 * width


def platform_tags(roots: DataFrame, bad: DataFrame, spark) -> DataFrame:
    """(root, platform): a platform holds if its plain runtime or else that of the kit has no violation."""
    rows = [(k, p, r) for k, (p, a, b) in enumerate(PLATFORMS) for r in (a, b) if r]
    dim = spark.createDataFrame(rows, "ord int, platform string, runtime string")
    ok = roots.crossJoin(dim).join(bad.select("root", "runtime"), ["root", "runtime"], "left_anti")  # a fixed number of platforms
    return ok.groupBy("root", "platform").agg(F.min("ord").alias("ord"))


def top_libraries(libraries: DataFrame) -> DataFrame:
    """Of each package's libraries (package, path): the one called like the package, else those outside of src, else all."""
    own = F.col("path") == F.concat(F.lit("lib/"), F.col("package"), F.lit(".dart"))
    rank = F.when(own, 0).when(~F.col("path").startswith("lib/src/"), 1).otherwise(2)
    return libraries.withColumn("rank", rank).withColumn("best", F.min("rank").over(Window.partitionBy("package"))).where("rank = best").select("package", "path")
