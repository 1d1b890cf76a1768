"""Images and links of Markdown texts, in document order, with raw HTML read as HTML."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
_DEFINED = re.compile(r"^ {0,3}\[([^\[\]]+)\]:[ \t]*<?([^\s<>]+)>?(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?[ \t]*$")
_SPAN = re.compile(r"(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.S)
_TARGET = r"<[^<>\n]*>|(?:[^\s()<>]|\([^\s()]*\))*"
_INLINE = re.compile(r"(!?)\[((?:[^\[\]\\]|\\.|\[[^\[\]]*\](?:\([^()]*\))?)*)\](?:\(\s*(" + _TARGET + r")(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?\s*\)|\[([^\[\]]*)\])?")
_AUTO = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9.-]+)>")


class _Tags(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str]] = []

    def handle_starttag(self, tag, attrs):
        wanted = {"img": "src", "a": "href"}.get(tag)
        for name, value in attrs:
            if name == wanted:
                self.found.append(("image" if tag == "img" else "link", value or ""))
                return


def _attribute(text: str) -> str:
    return text.replace("&", "&amp;").replace('"', "&quot;").replace("<", "&lt;").replace(">", "&gt;")


def _without_code(text: str) -> tuple[str, dict[str, str]]:
    """The text without code blocks and spans, and the targets that its definitions name."""
    kept, targets, fence = [], {}, None
    blank = True
    for line in text.splitlines():
        mark = _FENCE.match(line)
        if fence:
            if mark and mark[1].startswith(fence) and not line.strip().strip(fence[0]):
                fence = None
            continue
        if mark:
            fence = mark[1]
        elif blank and line.startswith(("    ", "\t")) and line.strip():
            continue
        elif defined := _DEFINED.match(line):
            targets.setdefault(" ".join(defined[1].lower().split()), defined[2])
        else:
            kept.append(line)
            blank = not line.strip()
    return _SPAN.sub("", "\n".join(kept)), targets


def _as_html(text: str, targets: dict[str, str]) -> str:
    """Links and images as HTML tags; all else stays."""

    def inline(m: re.Match) -> str:
        mark, label, target, name = m.groups()
        if target is None:
            target = targets.get(" ".join((name or label).lower().split()))
            if target is None:
                return mark + "[" + _INLINE.sub(inline, label) + "]" + (f"[{name}]" if name is not None else "")
        target = _attribute(unescape(target.strip("<>")))
        if mark:
            return f'<img src="{target}">'
        return f'<a href="{target}">{_INLINE.sub(inline, label)}</a>'

    def auto(m: re.Match) -> str:
        mail = "" if re.match(r"[A-Za-z][A-Za-z0-9+.-]{1,31}:", m[1]) else "mailto:"
        return f'<a href="{mail}{_attribute(m[1])}">'

    return _INLINE.sub(inline, _AUTO.sub(auto, text))


def content(text: str) -> tuple[list[str], list[str]]:
    """Images and links of a text, each once, in the order in which they first stand."""
    parser = _Tags()
    parser.feed(_as_html(*_without_code(text)))
    parser.close()
    return tuple(list(dict.fromkeys(u for kind, u in parser.found if kind == k)) for k in ("image", "link"))


def extracted(text: Column) -> Column:
    """struct(images, links) of each text. Python, as Markdown is read in order; a batch at a time."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([content(t or "") for t in b], columns=["images", "links"])

    return F.pandas_udf(run, "images array<string>, links array<string>", F.PandasUDFType.SCALAR_ITER)(text)
