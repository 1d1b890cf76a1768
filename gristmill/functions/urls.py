"""Repository URLs: parse to host, repository, branch and path, and resolve references inside of them."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from urllib.parse import urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .quality import IMAGE_ENDINGS

#: Hosts with a known layout.
PROVIDERS = {"github.com": "github", "gitlab.com": "gitlab"}
#: Steps that end a repository's name.
SEPARATORS = ("blob", "raw", "tree")


def repository(url: Column) -> Column:
    """struct(provider, host, repository, branch, path); null where the text is no repository URL."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^https?://([^/?#]+)", 1)), r"^www\.(?=github\.com$|gitlab\.com$)", "")
    raw = F.regexp_extract(url, r"^https?://[^/?#]+/([^?#]*)", 1)
    steps = F.filter(F.split(raw, "/"), lambda s: s != "")
    plain = ~raw.rlike(r"(^|/)\.\.?(/|$)") & ~raw.rlike(r"//")
    git = F.array_position(F.transform(steps, lambda s: s.endswith(".git")), True).cast("int")
    cut = F.array_position(F.transform(steps, lambda s, i: s.isin(*SEPARATORS) & (i >= 2)), True).cast("int")
    cut = F.when(F.get(steps, cut - 2) == "-", cut - 1).otherwise(cut)  # some hosts put a dash before the separator
    size = F.when(git > 0, git).when(cut > 0, cut - 1).otherwise(F.when(F.size(steps) >= 2, 2))
    name = F.regexp_replace(F.array_join(F.slice(steps, F.lit(1), size), "/"), r"\.git$", "")
    rest = F.slice(steps, size + 1, F.greatest(F.size(steps) - size, F.lit(0)))
    rest = F.when(F.get(rest, F.lit(0)) == "-", F.slice(rest, F.lit(2), F.greatest(F.size(rest) - 1, F.lit(0)))).otherwise(rest)
    after = F.get(rest, F.lit(0)).isin(*SEPARATORS)
    branch = F.when(after, F.get(rest, F.lit(1)))
    skip = F.when(after, 2).otherwise(0)
    path = F.array_join(F.slice(rest, skip + 1, F.greatest(F.size(rest) - skip, F.lit(0))), "/")
    provider = F.coalesce(*[F.when(host == h, p) for h, p in PROVIDERS.items()], F.lit("unknown"))
    known = F.struct(provider.alias("provider"), host.alias("host"), name.alias("repository"), branch.alias("branch"), F.nullif(path, F.lit("")).alias("path"))
    return F.when(url.rlike(r"^https?://[^/?#]+/") & plain & size.isNotNull(), known)


def clone_url(repo: Column) -> Column:
    return F.concat(F.lit("https://"), repo["host"], F.lit("/"), repo["repository"])


def is_github_like(repo: Column) -> Column:
    return repo["provider"].isin("github", "gitlab")


def resolve_reference(base: str | None, reference: str | None, relative_from: str = "", branch: str | None = None, embedded: bool = False) -> str | None:
    """Where a reference in a repository's file points; absolute ones and anchors stay; null where it cannot be told."""
    if reference is None or reference.startswith("#"):
        return reference
    try:
        ref, at = urlsplit(reference), urlsplit(base or "")
    except ValueError:
        return None
    if ref.scheme:
        return reference
    steps = [s for s in at.path.split("/") if s]
    if at.scheme not in ("http", "https") or not at.netloc or len(steps) < 2:
        return None
    host = at.netloc.lower().removeprefix("www.")
    if host not in PROVIDERS:
        return None
    owner, name = steps[0], steps[1].removesuffix(".git")
    rest = steps[2:]
    if rest[:1] == ["-"]:
        rest = rest[1:]
    inner = ""
    if rest and rest[0] in SEPARATORS:
        branch, inner = (rest[1] if len(rest) > 1 else branch), "/".join(rest[2:])
    start = "/" if ref.path.startswith("/") else "/" + posixpath.join(inner, posixpath.dirname(relative_from))
    path = posixpath.normpath(posixpath.join(start, ref.path.lstrip("/"))).strip("/")
    path = "" if path == "." else path
    kind = "raw" if embedded or reference.lower().endswith(IMAGE_ENDINGS) else "blob"
    dash = "-/" if PROVIDERS[host] == "gitlab" else ""
    return urlunsplit(("https", host, f"/{owner}/{name}/{dash}{kind}/{branch or 'master'}/{path}", ref.query, ref.fragment))


def resolved(base: Column, reference: Column, relative_from: Column) -> Column:
    """resolve_reference of each row. Python, as path steps are folded one by one; a batch at a time."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b, c in batches:
            yield pd.Series([resolve_reference(x, y, z or "") for x, y, z in zip(a, b, c)], dtype=object)

    return F.pandas_udf(run, "string", F.PandasUDFType.SCALAR_ITER)(base, reference, relative_from)
