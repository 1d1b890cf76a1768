"""Scalar rules over texts, paths and links, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings of image files.
IMAGE_ENDINGS = (".bmp", ".gif", ".ico", ".jpeg", ".jpg", ".png", ".svg", ".webp")
#: Where an example is looked for, in this order; {} is the package's name.
EXAMPLE_PATHS = (
    "example/README.md",
    "example/example.md",
    "example/lib/main.dart",
    "example/bin/main.dart",
    "example/main.dart",
    "example/lib/{}.dart",
    "example/bin/{}.dart",
    "example/{}.dart",
    "example/lib/{}_example.dart",
    "example/bin/{}_example.dart",
    "example/{}_example.dart",
    "example/lib/example.dart",
    "example/bin/example.dart",
    "example/example.dart",
)


def non_ascii_ratio(text: Column) -> Column:
    """Characters from 128 on over characters over 32; no such characters: 0."""
    seen = F.length(F.regexp_replace(text, r"[\x00-\x20]", ""))
    high = F.length(F.regexp_replace(text, r"[\x00-\x7F]", ""))
    return F.when(seen > 0, high / seen).otherwise(F.lit(0.0))


def description_class(text: Column) -> Column:
    n = F.length(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(n == 0, "empty").when(n < 50, "short").when(n > 180, "long").when(non_ascii_ratio(text) > 0.1, "non-ascii").otherwise("ok")


def scheme(url: Column) -> Column:
    """Lower-cased scheme; empty for a relative link, null for a text that is no link."""
    bad = url.rlike(r"[\s<>\"{}|\\^`]") | url.rlike("^[0-9][A-Za-z0-9+.-]*:") | url.rlike("^:")
    return F.when(~bad, F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)))


def link_class(url: Column) -> Column:
    """unparsed, or insecure (a scheme that is neither https nor mailto), or secure."""
    s = scheme(url)
    return F.when(s.isNull(), "unparsed").when((s != "") & ~s.isin("https", "mailto"), "insecure").otherwise("secure")


def url_status(url: Column, exists: Column) -> Column:
    """First of invalid, insecure and missing; null where none holds."""
    s = F.coalesce(scheme(url), F.lit(""))
    return F.coalesce(F.when(~s.isin("http", "https"), "invalid"), F.when(s != "https", "insecure"), F.when(~exists, "missing"))


def link_verdict(url: Column, exists: Column) -> Column:
    """Ladder for a manifest's link: an unreachable one is accepted with an issue before its scheme is looked at."""
    s = F.coalesce(scheme(url), F.lit(""))
    return F.when(~s.isin("http", "https"), "rejected: invalid").when(~exists, "accepted: missing").when(s == "http", "rejected: insecure").otherwise("ok")


def is_analysis_target(path: Column) -> Column:
    return (path == "pubspec.yaml") | F.get(F.split(path, "/"), F.lit(0)).isin("bin", "lib")


def is_library_href(href: Column) -> Column:
    """Links to a library's page: one named so, or, where pages have no ending, a path of a single step."""
    steps = F.size(F.split(F.regexp_replace(href, "/$", ""), "/"))
    return F.coalesce(F.when(href == "", False).when(href.endswith("-library.html"), True).when(href.endswith(".html"), False).otherwise(steps == 1), F.lit(False))


def is_class_href(href: Column) -> Column:
    return href.endswith("-class.html")


def severity_rank(severity: Column) -> Column:
    s = F.upper(severity)
    return F.when(s == "ERROR", 0).when(s == "WARNING", 1).when(s == "INFO", 2).otherwise(3)


def screenshot_issues(description: Column, path: Column, exists: Column, size: Column, most: int = 4 << 20) -> Column:
    """All complaints about one screenshot, in order."""
    n = F.length(F.coalesce(description, F.lit("")))
    p = F.coalesce(path, F.lit(""))
    outside = F.exists(F.split(p, "/"), lambda x: x == "..") | p.startswith("/")
    return F.array_compact(
        F.array(
            F.when(n == 0, "description is empty"),
            F.when(n > 160, "description is over 160 characters"),
            F.when(p == "", "path is empty"),
            F.when(p.contains(":"), "path holds a colon"),
            F.when(outside, "path is outside of the package"),
            F.when((p != "") & ~outside & ~exists, "file is missing"),
            F.when(size > most, "file is over 4 MB"),
        )
    )


def trimmed_output(text: Column, lines: int = 10, width: int = 200) -> Column:
    """At most ten lines of at most 200 characters, with a note on what is left out."""
    all_ = F.split(text, "\n")
    short = F.transform(F.slice(all_, F.lit(1), F.lit(lines)), lambda x: F.when(F.length(x) > width, F.concat(F.substring(x, 1, width - 5), F.lit("[...]"))).otherwise(x))
    more = F.size(all_) - lines
    return F.array_join(F.when(more > 0, F.array_append(short, F.concat(F.lit("["), more.cast("string"), F.lit(" more lines]")))).otherwise(short), "\n")


def elided(text: Column, most: int = 64, side: int = 24) -> Column:
    """A text of `most` characters or more keeps its first and last ones."""
    n = F.length(text)
    return F.when(n < most, text).otherwise(F.concat(F.substring(text, 1, side), F.lit("[...]"), F.substring(text, n - side + 1, F.lit(side))))


#: Operation codes of coded text operations.
OP_CODES = {"delete": 0, "match": 1, "insert": 2}


def ops_flat(ops: Column) -> Column:
    """[code, start, length, (content of deletes)] of each operation, end to end, as strings."""

    def one(o):
        head = F.array(F.coalesce(*[F.when(o["type"] == k, str(v)) for k, v in OP_CODES.items()]), o["start"].cast("string"), o["length"].cast("string"))
        return F.when(o["type"] == "delete", F.array_append(head, o["content"])).otherwise(head)

    return F.flatten(F.transform(ops, one))


def ops_nested(flat: Column) -> Column:
    """The inverse of ops_flat. An unknown code is an error."""
    kind = "array<struct<type:string,start:int,length:int,content:string>>"
    names = F.create_map(*[F.lit(x) for k, v in OP_CODES.items() for x in (str(v), k)])
    start = F.struct(F.lit(0).alias("stage"), F.lit("").alias("code"), F.lit(0).alias("a"), F.lit(0).alias("n"), F.array().cast(kind).alias("out"))

    def put(acc, content):
        name = F.coalesce(names[acc["code"]], F.raise_error(F.concat(F.lit("unknown operation "), acc["code"])).cast("string"))
        return F.array_append(acc["out"], F.struct(name.alias("type"), acc["a"].alias("start"), acc["n"].alias("length"), content.alias("content")))

    def state(stage, code, a, n, out):
        return F.struct(F.lit(stage).alias("stage"), code.alias("code"), a.alias("a"), n.alias("n"), out.alias("out"))

    def length(acc, x):
        done = F.struct(acc["stage"].alias("stage"), acc["code"].alias("code"), acc["a"].alias("a"), x.cast("int").alias("n"), acc["out"].alias("out"))
        return F.when(acc["code"] == "0", state(3, acc["code"], acc["a"], x.cast("int"), acc["out"])).otherwise(state(0, acc["code"], acc["a"], x.cast("int"), put(done, F.lit(None).cast("string"))))

    def step(acc, x):
        return (
            F.when(acc["stage"] == 0, state(1, x, acc["a"], acc["n"], acc["out"]))
            .when(acc["stage"] == 1, state(2, acc["code"], x.cast("int"), acc["n"], acc["out"]))
            .when(acc["stage"] == 2, length(acc, x))
            .otherwise(state(0, acc["code"], acc["a"], acc["n"], put(acc, x)))
        )

    return F.aggregate(flat, start, step, lambda acc: acc["out"])
