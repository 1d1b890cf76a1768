"""Pluggable checks of texts as table functions of SQL.

A check is a Python generator of details over one text. `register` makes two table functions of a set of them: one that gives the
issues of a text, to be joined LATERAL, and one over a table of issues, PARTITION BY whatever they are shown for and ORDER BY how,
that gives the first few of each partition and at its end how many more there are. A partition is read row by row with two counters as
its state, so its size does not matter to memory.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

Check = Callable[[str], Iterable[str]]

_INSECURE = re.compile(r"http://[A-Za-z0-9./_-]+")
_IMAGE = re.compile(r"<img[^>]*>")


def insecure_links(text: str) -> Iterator[str]:
    """Addresses without encryption, as often as they stand there."""
    return (m[0] for m in _INSECURE.finditer(text))


def bare_images(text: str) -> Iterator[str]:
    """Images without a text in their place."""
    return (m[0] for m in _IMAGE.finditer(text) if " alt=" not in m[0])


def long_lines(text: str, most: int = 120) -> Iterator[str]:
    """Lengths of lines that are longer than `most` characters."""
    return (str(len(x)) for x in text.split("\n") if len(x) > most)


PAGE_CHECKS: dict[str, Check] = {"insecure": insecure_links, "bare_image": bare_images, "long_line": long_lines}


def register(spark: SparkSession, checks: dict[str, Check], name: str, shown: int = 5) -> None:
    """SQL functions `name`(text), with columns code, nth and detail, and `name`_shown(TABLE(...)) of rows (key, code, nth, detail),
    with columns key, place, code, nth, detail: the first `shown` of each partition, then a row `more` with the rest's number as nth.
    A null text has no issues."""
    checks = dict(checks)

    class Issues:
        def eval(self, text: str):
            for code, check in checks.items():
                for nth, detail in enumerate(check(text) if text is not None else (), 1):
                    yield code, nth, detail

    class Shown:
        def __init__(self):
            self.n, self.key = 0, None

        def eval(self, row: Row):
            self.n, self.key = self.n + 1, row["key"]
            if self.n <= shown:
                yield row["key"], self.n, row["code"], row["nth"], row["detail"]

        def terminate(self):
            if self.n > shown:
                yield self.key, shown + 1, "more", self.n - shown, None

    spark.udtf.register(name, udtf(Issues, returnType="code: string, nth: int, detail: string"))
    spark.udtf.register(f"{name}_shown", udtf(Shown, returnType="key: bigint, place: int, code: string, nth: int, detail: string"))
