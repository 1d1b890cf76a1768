"""A paged listing as a Python data source, batch and stream, and the names that a search over its pages selects.

Pages are saved answers below a folder that driver and executors share: `<path>/page=<n>/` holds files of JSON texts, each
an object with a list `packages` of objects with a name `package`. Numbers start at 1; a listing ends before its first page
that is missing or without entries.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from .session import kept

NAME = "paged_listing"


class _Page(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)
        self.number = number


def _place(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace(":", "://", 1))


def _entries(path: str, page: int) -> list[str]:
    """Names of a page in their order. A page without a list of packages is an error, as is an entry without a name."""
    from pyarrow import fs

    system, root = _place(path)
    out: list[str] = []
    found = system.get_file_info(fs.FileSelector(f"{root}/page={page}", allow_not_found=True))
    for f in sorted(x.path for x in found if x.base_name[:1] not in "._"):
        with system.open_input_stream(f) as body:
            for text in filter(None, body.read().decode().split("\n")):
                out += [x["package"] for x in json.loads(text)["packages"]]
    return out


def _pages(path: str) -> int:
    """How many pages are there without a gap."""
    from pyarrow import fs

    system, root = _place(path)
    names = (x.base_name for x in system.get_file_info(fs.FileSelector(root, allow_not_found=True)))
    numbers = {int(n[5:]) for n in names if n.startswith("page=") and n[5:].isdigit()}
    last = 0
    while last + 1 in numbers:
        last += 1
    return last


class _Batch(DataSourceReader):
    """One partition a page; comparisons of the page's number leave pages unread."""

    def __init__(self, path: str):
        self.path, self.low, self.high = path, 1, None

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            bounds = {EqualTo: (0, 0), GreaterThan: (1, None), GreaterThanOrEqual: (0, None), LessThan: (None, -1), LessThanOrEqual: (None, 0)}.get(type(f))
            if bounds is None or f.attribute != ("page",):
                yield f
                continue
            if bounds[0] is not None:
                self.low = max(self.low, f.value + bounds[0])
            if bounds[1] is not None:
                self.high = f.value + bounds[1] if self.high is None else min(self.high, f.value + bounds[1])

    def partitions(self) -> list[_Page]:
        last = _pages(self.path)
        return [_Page(n) for n in range(self.low, min(last, last if self.high is None else self.high) + 1)] or [_Page(0)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        for k, name in enumerate(_entries(self.path, partition.number) if partition.number else []):
            yield partition.number, k, name


class _Stream(DataSourceStreamReader):
    """New pages as they appear; the offset is the number of pages that were read."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"pages": 0}

    def latestOffset(self) -> dict:
        return {"pages": _pages(self.path)}

    def partitions(self, start: dict, end: dict) -> list[_Page]:
        return [_Page(n + 1) for n in range(start["pages"], end["pages"])]

    def read(self, partition: _Page) -> Iterator[tuple]:
        for k, name in enumerate(_entries(self.path, partition.number)):
            yield partition.number, k, name


class PagedListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "page int, ord int, package string"

    def reader(self, schema) -> _Batch:
        return _Batch(self.options["path"])

    def streamReader(self, schema) -> _Stream:
        return _Stream(self.options["path"])


def listing(spark: SparkSession, path: str, first: int = 1, last: int | None = None) -> DataFrame:
    """(page, ord, package) of the pages first to last; others are not read. A Python source takes filters only where the
    session lets it."""
    spark.dataSource.register(PagedListing)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    df = spark.read.format(NAME).load(path).where(F.col("page") >= first)
    return df if last is None else df.where(F.col("page") <= last)


def selected(spark: SparkSession, path: str, limit: int, keep: Callable[[DataFrame], DataFrame] = lambda names: names, at_once: int = 8) -> DataFrame:
    """The first `limit` distinct packages of the listing that `keep` lets through, by name. Pages are read in waves, each
    twice as long as the one before, until there are enough names or a page without entries ends the listing."""
    first, found = 1, None
    while True:
        wave = kept(listing(spark, path, first, first + at_once - 1))
        pages = wave.select("page").distinct().agg(F.count(F.lit(1)).alias("n"), F.max("page").alias("last")).first()
        whole = pages.n == at_once
        if not whole:  # entries after a page without any are not part of the listing
            after = wave.select("page").distinct().select((F.col("page") - F.lit(first)).alias("k"))
            gaps = F.array_except(F.sequence(F.lit(0), F.lit(at_once)), F.collect_set("k"))  # a wave's pages
            wave = wave.where(F.col("page") < first + after.agg(F.array_min(gaps)).first()[0])
        new = keep(wave).groupBy("package").agg(F.min(F.struct("page", "ord")).alias("at"))
        found = kept(new if found is None else found.unionByName(new).groupBy("package").agg(F.min("at").alias("at")))
        if not whole or found.count() >= limit:
            return found.orderBy("at", "package").limit(limit).select("package").orderBy("package")
        first, at_once = first + at_once, 2 * at_once
