"""Semi-structured texts: YAML to sorted JSON within bounds, option merges and manifest views."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import yaml
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limits of a document.
MAX_DEPTH, MAX_NODES = 64, 10_000


class Malformed(ValueError):
    """The text is no YAML, or beyond its bounds."""


def _plain(node, depth: int, left: list[int], above: tuple[int, ...], max_depth: int):
    left[0] -= 1
    if depth > max_depth:
        raise Malformed("too deep")
    if left[0] < 0:
        raise Malformed("too many nodes")
    if isinstance(node, (dict, list)):
        if id(node) in above:
            raise Malformed("a node holds itself")
        above = (*above, id(node))
    if isinstance(node, dict):
        if any(isinstance(k, (dict, list, tuple)) for k in node):
            raise Malformed("a key is no scalar")
        return {str(k): _plain(v, depth + 1, left, above, max_depth) for k, v in sorted(node.items(), key=lambda x: str(x[0]))}
    if isinstance(node, list):
        return [_plain(v, depth + 1, left, above, max_depth) for v in node]
    return node if isinstance(node, (str, int, float, bool, type(None))) else str(node)


class _Loader(yaml.SafeLoader):
    """No merge keys and no dates: `<<` and 2020-01-01 are plain texts."""


_Loader.yaml_implicit_resolvers = {k: [(t, r) for t, r in v if t not in ("tag:yaml.org,2002:merge", "tag:yaml.org,2002:timestamp")] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}


def yaml_object(text: str | None, max_depth: int = MAX_DEPTH, max_nodes: int = MAX_NODES) -> dict | None:
    """The map of a YAML text with sorted keys; null for any other kind of document. Aliases count wherever they appear."""
    if text is None:
        return None
    try:
        loaded = yaml.load(text, _Loader)  # noqa: S506  the loader is a safe one
    except (yaml.YAMLError, RecursionError) as e:
        raise Malformed(str(e)) from e
    return _plain(loaded, 0, [max_nodes], (), max_depth) if isinstance(loaded, dict) else None


def _each(f: Callable[[str | None], str | None]):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([f(x) for x in b], dtype=object)

    return F.pandas_udf(run, "string", F.PandasUDFType.SCALAR_ITER)


def yaml_json(text: Column, max_depth: int = MAX_DEPTH, max_nodes: int = MAX_NODES) -> Column:
    """JSON of YAML texts; null where there is no map or the text is malformed."""

    def one(x):
        try:
            found = yaml_object(x, max_depth, max_nodes)
        except Malformed:
            return None
        return None if found is None else json.dumps(found, ensure_ascii=False, allow_nan=False, default=str)

    return _each(one)(text)


def sorted_json(text: Column) -> Column:
    """JSON with the keys of all maps sorted; lists keep their order."""
    return _each(lambda x: None if x is None else json.dumps(json.loads(x), sort_keys=True, ensure_ascii=False))(text)


#: Folders that are never analysed.
ALWAYS_EXCLUDED = ("test/**", "example/**")


def merged_options(original: str | None, custom: str) -> str:
    """The custom options with what may pass from the original: error levels, exclusions, one experiment, linter rules and
    formatter settings. The custom include wins. Broken YAML counts as empty."""

    def read(x):
        try:
            return yaml_object(x) or {}
        except Malformed:
            return {}

    ours, own = read(original), read(custom)

    def inner(m: dict, *path: str, kind: type = dict):
        for p in path:
            m = m.get(p) if isinstance(m, dict) else None
        return m if isinstance(m, kind) else None

    analyzer = own.setdefault("analyzer", {})
    exclude = inner(own, "analyzer", "exclude", kind=list) or []
    exclude += [x for x in (*ALWAYS_EXCLUDED, *(inner(ours, "analyzer", "exclude", kind=list) or [])) if x not in exclude]
    analyzer["exclude"] = list(dict.fromkeys(exclude))
    if (errors := inner(ours, "analyzer", "errors")) is not None:
        analyzer.setdefault("errors", {}).update(errors)
    if "macros" in (inner(ours, "analyzer", "enable-experiment", kind=list) or []):
        analyzer.setdefault("enable-experiment", []).append("macros")
    if (rules := inner(ours, "linter", "rules")) is not None:
        linter = own.setdefault("linter", {})
        mine = linter.setdefault("rules", {})
        if isinstance(mine, list):
            linter["rules"] = mine = {str(r): True for r in mine}
        mine.update(rules)
    if (formatter := inner(ours, "formatter")) is not None:
        own.setdefault("formatter", {}).update(formatter)
    if (include := own.get("include", ours.get("include"))) is not None:
        own["include"] = include
    return json.dumps(own, ensure_ascii=False)


def kept_keys(options: Column, allowed: list[str], constant: dict[str, str]) -> Column:
    """The allowed keys of a map, and constant ones over them."""
    some = F.map_filter(options, lambda k, v: k.isin(*allowed))
    fixed = F.create_map(*[F.lit(x) for kv in constant.items() for x in kv])
    return F.map_concat(F.map_filter(some, lambda k, v: ~k.isin(*constant)), fixed)


def without_keys(manifest: Column, *dropped: str) -> Column:
    return F.map_filter(manifest, lambda k, v: ~k.isin(*dropped))


def has_path(variant: Column, *path: str) -> Column:
    """Whether a key path is there, its value being null or not."""
    above = "$" + "".join(f".{p}" for p in path[:-1])
    return F.coalesce(F.array_contains(F.json_object_keys(F.get_json_object(variant, above)), path[-1]), F.lit(False))


def dependent_sdks(environment: Column, dependencies: Column, dev_dependencies: Column) -> Column:
    """Sorted SDK names: of dependencies given as {sdk: name} (maps from name to SDK or null), and of the environment."""
    named = lambda m: F.filter(F.map_values(m), lambda v: v.isNotNull())
    return F.array_sort(F.array_union(F.array_union(named(dependencies), named(dev_dependencies)), F.array_except(F.map_keys(environment), F.array(F.lit("sdk")))))


def unknown_sdks(sdks: Column) -> Column:
    return F.array_except(sdks, F.array(F.lit("flutter")))


def uses_flutter(environment: Column, dependencies: Column, dev_dependencies: Column, keys: Column) -> Column:
    sdks = dependent_sdks(environment, dependencies, dev_dependencies)
    return F.array_contains(sdks, "flutter") | F.map_contains_key(dependencies, "flutter") | F.array_contains(keys, "flutter")


def shown_dependencies(*lists: Column) -> Column:
    """Distinct names of several lists, without those that hold a dash or a dot, sorted."""
    out = lists[0]
    for x in lists[1:]:
        out = F.array_union(out, x)
    return F.array_sort(F.filter(F.array_distinct(out), lambda x: ~x.rlike("[-.]")))


def open_git_dependency(refs: Column) -> Column:
    """Whether any git dependency (map from name to ref) is not bound to a full commit."""
    return F.exists(F.map_values(refs), lambda r: r.isNull() | (F.length(r) < 40))


def executables(names: Column) -> Column:
    """Names to trimmed file names; none is an empty text."""
    return F.transform_values(names, lambda k, v: F.coalesce(F.trim(v), F.lit("")))
