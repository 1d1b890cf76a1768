import json
import random
import re

import pytest
from pyspark.sql import functions as F

from gristmill.functions import diagnostics as D
from gristmill.functions import alignment as A
from gristmill.functions import diffs as X
from gristmill.functions import markdown as MD
from gristmill.functions import quality as Q
from gristmill.functions import render as N
from gristmill.functions import rules as L
from gristmill.functions import semi as J
from gristmill.functions import tokens as T
from gristmill.functions import urls as U
from gristmill.functions import versions as V


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text, expected",
    [
        ("/* Grant, subject to section 4.2! */", "grant subject to section 4.2"),  # marks go, a number's inner points stay
        ("## analyse the sub license per cent of the copyright holder", "analyze the sublicense percent of the copyright owner"),  # spellings and pairs
        ("1. first point\n  iv) second point iv.\n(c) third", "first point second point iv third"),  # list items go where they open a line
        ("Ver. 10.3.1-beta_7 of f(x)=y", "ver 10.3.1-7 of fxy"),  # in a word that begins with a digit, letters go
        ("per\ncent of copyright\nholder", "per cent of copyright holder"),  # a new line keeps a pair apart
        ("A-b C_d e'f \"g\"", "ab cd ef g"),
    ],
)
def test_tokens(text, expected):
    assert " ".join(t for t, _, _ in T.scan(text)) == expected


def test_token_places():
    """Every token stands where its word does; those of a pair reach over both."""
    text = "* The  sub license,\r\n2) as-is: (C) 2020"
    got = T.scan(text)
    assert [t for t, _, _ in got] == ["the", "sublicense", "asis", "c", "2020"]
    assert [text[a:b] for _, a, b in got] == ["The", "sub license,", "as-is:", "C)", "2020"]


def test_granularity():
    assert [T.granularity(x) for x in (0.95, 0.9, 0.8, 0.5, 0.3)] == [10, 9, 4, 1, 1]


def test_stripped(spark):
    text = "isc license:\nkeep\nCopyright (c) 2020 Someone\nCopyright © 1999-2001, X\nend"
    assert value(spark, T.stripped(F.lit("ISC"), F.lit(text))) == "keep\nend"


def test_ratio(spark):
    assert value(spark, Q.non_ascii_ratio(F.lit("abcd éèêëìí"))) == 0.6
    assert value(spark, Q.non_ascii_ratio(F.lit(" \n"))) == 0


@pytest.mark.parametrize("url, kind", [("http://a.b", "insecure"), ("https://a.b", "secure"), ("mailto:a@b.c", "secure"), ("/a/b", "secure"), ("a b", "unparsed"), ("ftp://x", "insecure")])
def test_link_class(spark, url, kind):
    assert value(spark, Q.link_class(F.lit(url))) == kind


@pytest.mark.parametrize("href, yes", [("x-library.html", True), ("pkg/", True), ("pkg", True), ("a/b", False), ("a.html", False), ("", False)])
def test_library_href(spark, href, yes):
    assert value(spark, Q.is_library_href(F.lit(href))) is yes


def test_elided(spark):
    assert value(spark, Q.elided(F.lit("x" * 63))) == "x" * 63
    assert value(spark, Q.elided(F.lit("a" * 30 + "b" * 34))) == "a" * 24 + "[...]" + "b" * 24


def test_operations_round_trip(spark):
    ops = "array(named_struct('type','delete','start',0,'length',24,'content','x'), named_struct('type','match','start',24,'length',1022,'content',cast(null as string)))"
    flat = Q.ops_flat(F.expr(ops))
    assert value(spark, flat) == ["0", "0", "24", "x", "1", "24", "1022"]
    assert [tuple(o) for o in value(spark, Q.ops_nested(flat))] == [("delete", 0, 24, "x"), ("match", 24, 1022, None)]


@pytest.mark.parametrize(
    "constraint, version, yes",
    [
        ("^1.2.3", "1.9.0", True), ("^1.2.3", "2.0.0", False), ("^1.2.3", "2.0.0-dev", False), ("^0.1.2", "0.2.0", False), ("^0.1.2", "0.1.9", True),
        (">=1.0.0 <2.0.0", "2.0.0-dev.1", False), (">=1.0.0 <=2.0.0", "2.0.0", True), (">1.0.0", "1.0.0", False), ("any", "0.0.1", True), ("1.2.3", "1.2.3", True), ("1.2.3", "1.2.4", False),
    ],
)
def test_constraints(spark, constraint, version, yes):
    assert value(spark, V.allows(V.bounds(F.lit(constraint)), V.key(F.lit(version)))) is yes


def test_version_order(spark):
    ordered = ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.0.10", "1.2.0", "10.0.0"]
    rows = spark.createDataFrame([(v,) for v in reversed(ordered)], "v string").orderBy(V.key(F.col("v"))).collect()
    assert [r.v for r in rows] == ordered
    assert value(spark, V.key(F.lit("1.x"))) is None


def test_sdk_flags(spark):
    f = lambda c: tuple(value(spark, V.sdk_flags(F.lit(c))))
    assert f(">=2.12.0 <3.0.0") == (True, True, True, True)
    assert f(">=2.0.0 <2.12.0") == (True, False, True, False)
    assert f("^3.0.0") == (True, False, False, True)
    assert value(spark, V.widened(F.lit(">=2.12.0 <3.0.0"))) == ">=2.12.0 <4.0.0"
    assert value(spark, V.widened(F.lit(">=2.1.0 <3.0.0"))) == ">=2.1.0 <3.0.0"
    assert value(spark, V.without_top(F.lit(">=1.0.0 <2.0.0"))) == ">=1.0.0"


@pytest.mark.parametrize(
    "url, expected",
    [
        ("https://github.com/a/b", ("github", "github.com", "a/b", None, None)),
        ("http://www.github.com/a/b.git", ("github", "github.com", "a/b", None, None)),
        ("https://github.com/a/b/tree/main/pkg/x", ("github", "github.com", "a/b", "main", "pkg/x")),
        ("https://gitlab.com/a/b/-/blob/dev/x.md", ("gitlab", "gitlab.com", "a/b", "dev", "x.md")),
        ("https://example.com/a/b/c.git/x", ("unknown", "example.com", "a/b/c", None, "x")),
        ("https://github.com/a/../b", None),
        ("ftp://github.com/a/b", None),
    ],
)
def test_repository(spark, url, expected):
    got = value(spark, U.repository(F.lit(url)))
    assert (tuple(got) if got else None) == expected


def test_resolve():
    r = lambda x, **k: U.resolve_reference("https://github.com/a/b", x, **k)
    assert r("#top") == "#top"
    assert r("https://x.y/z") == "https://x.y/z"
    assert r("doc/x.md") == "https://github.com/a/b/blob/master/doc/x.md"
    assert r("../x.png", relative_from="doc/README.md") == "https://github.com/a/b/raw/master/x.png"
    assert r("../../../x.md") == "https://github.com/a/b/blob/master/x.md"
    assert r("x.md?a=1#b", branch="main") == "https://github.com/a/b/blob/main/x.md?a=1#b"
    assert U.resolve_reference("https://nowhere.org/a/b", "x.md") is None


def test_problem_line(spark):
    p = value(spark, D.problem(F.lit(r"ERROR|STATIC_WARNING|CODE_X|C:\\a\|b.dart|3|4|5|what | why")))
    assert tuple(p) == ("ERROR", "STATIC_WARNING", "CODE_X", "C:\\a|b.dart", 3, 4, 5, "what | why")
    assert value(spark, D.problem(F.lit("nothing"))) is None


def test_tool_output(spark):
    assert value(spark, D.format_failures(F.lit("Changed b.dart\nnoise\nChanged a.dart"))) == ["a.dart", "b.dart"]
    assert tuple(value(spark, D.sdk_version(F.lit('Dart SDK version: 2.10.0 (stable) (Tue) on "linux_x64"')))) == ("2.10.0", "stable", "linux_x64")
    assert value(spark, D.inner_sdk_version(F.lit("2.9.0 (build 2.9.0-14.1.beta)"))) == "2.9.0-14.1.beta"
    assert value(spark, D.head_branch(F.lit("  x\n  HEAD branch: main\n"))) == "main"


@pytest.mark.parametrize(
    "content, groovy, yes",
    [
        ("apply plugin: 'kotlin-android'", True, True),
        ("  apply \t plugin :  \"org.jetbrains.kotlin.android\" // old", True, True),
        ("apply plugin: 'kotlin-android\"", True, False),
        ("// apply plugin: 'kotlin-android'", True, False),
        ("apply plugin: 'kotlin-android'", False, False),
        ("plugins {\n  id 'org.jetbrains.kotlin.android'\n}", True, True),
        ("plugins { id 'kotlin-android' }", True, True),
        ("plugins {\n  id 'a'\n  alias(\n libs.plugins.kotlin.android\n )\n}", True, True),
        ("plugins {\n  id 'kotlin-android' version '1'\n}", True, False),
        ("plugins {\n  id 'com.android.library'\n}\nid 'kotlin-android'", True, False),
        ("plugins {\n  x {\n }\n  id 'kotlin-android'\n}", True, False),
        ("other {\n  id 'kotlin-android'\n}", True, False),
        ("android {\n  kotlinOptions {\n  }\n}", True, True),
        ("android.kotlinOptions { }", False, True),
        ("mykotlinOptions {", True, False),
        ('plugins {\n  id("org.jetbrains.kotlin.android")\n}', False, True),
        ('plugins {\n  id ( "kotlin-android" )}', False, True),
        ("plugins {\n  id 'org.jetbrains.kotlin.android'\n}", False, False),
        ("plugins {\n  alias(libs.plugins.android.kotlin\n}", False, False),
    ],
)
def test_kotlin(spark, content, groovy, yes):
    assert value(spark, D.old_kotlin_build(F.lit(content), groovy)) is yes


def changed_words(found, known):
    """Least changed words between `known` and any part of `found`, by the whole table."""
    row = list(range(len(known) + 1))
    best = row[-1]
    for x in found:
        new = [0]
        for j, y in enumerate(known):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
        best = min(best, row[-1])
    return best


def test_differences():
    g = random.Random(3)
    for _ in range(1200):
        a, b = ([g.choice("abcde") for _ in range(g.randrange(16))] for _ in range(2))
        d = X.differences(a, b)
        assert [w for o, ws in d if o != "insert" for w in ws] == a and [w for o, ws in d if o != "delete" for w in ws] == b
        least = changed_words(a, b)
        assert X.distance(X.trimmed(d)) == least, (a, b, d)
        assert X.differences(a, b, least) == d and (not least or X.differences(a, b, least - 1) is None)
        assert all(x[0] != y[0] for x, y in zip(d, d[1:]))


def test_alignment():
    """Scripts of whole sequences, of words and of characters, against the table."""
    g = random.Random(5)
    for _ in range(400):
        a, b = ("".join(g.choice("abc") for _ in range(g.randrange(40))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b):
                new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
            row = new
        s = A.script(a, b)
        assert sum(max(p[2] - p[1], p[4] - p[3]) for p in s if p[0] == "change") == row[-1]
        assert all(a[p[1] : p[2]] == b[p[3] : p[4]] for p in s if p[0] == "equal")
        assert [(p[1], p[3]) for p in s] + [(len(a), len(b))] == [(0, 0)] + [(p[2], p[4]) for p in s]


def test_long_differences():
    """A known text of 20,000 words inside of 39,000: in seconds and a few MB."""
    import time
    import tracemalloc

    g = random.Random(1)
    known = [f"w{g.randrange(3000)}" for _ in range(20000)]
    changed = sorted(g.sample(range(20000), 400))
    body = list(known)
    for k in changed:
        body[k] = "new"
    found = [f"v{g.randrange(3000)}" for _ in range(9000)] + body + [f"v{g.randrange(3000)}" for _ in range(10000)]
    began = time.time()
    d = X.differences(found, known, 1000)
    assert time.time() - began < 20 and X.distance(X.trimmed(d)) == 400
    assert [len(w) for _, w in (d[0], d[-1])] == [9000, 10000]
    tracemalloc.start()
    A.part(found[8000:16000], known[:5000])
    assert tracemalloc.get_traced_memory()[1] < 8e6
    tracemalloc.stop()


def test_distance():
    d = X.differences("intro the quick fox outro".split(), "the slow quick fox".split())
    assert X.known_range(d) == (1, 4) and X.trimmed(d) == [("equal", ["the"]), ("insert", ["slow"]), ("equal", ["quick", "fox"])]
    assert X.distance(X.trimmed(d)) == 1 and X.confidence(1, 4) == 0.75 and X.confidence(3, 0) == 1
    assert X.known_range([("delete", ["a"])]) == (0, 0) and X.changes_allowed(20, 0.95) == 1 and X.changes_allowed(19, 0.95) == 0


def test_token_ops():
    text = "so the red  fox ran"
    spans, at = [], 0
    for w in text.split():
        at = text.index(w, at)
        spans.append((at, at + len(w)))
    d = X.differences(text.split(), "the big fox ran far".split())
    ops = X.token_ops(d, spans)
    assert [(o["type"], text[o["start"] : o["start"] + o["length"]] if o["content"] is None else o["content"]) for o in ops] == [("insert", "so"), ("match", "the"), ("insert", "red"), ("delete", "big"), ("match", "fox ran"), ("delete", "far")]
    assert X.token_places(["ab", "c"]) == [0, 0, 0, 1, 1]


def test_fine_token_ops():
    """Within a changed word its common characters are a match of the word, and what differs an insert and a delete of it."""
    d = X.differences("an original licenced work".split(), "an original licensed work".split())
    assert X.text_runs(d) == [("equal", "an original "), ("delete", "licenced "), ("insert", "licensed "), ("equal", "work ")]
    assert X.text_runs(d, fine=True) == [("equal", "an original licen"), ("delete", "ced "), ("insert", "sed "), ("equal", "work ")]
    assert X.text_runs(X.differences(["abcx", "y"], ["abcz", "y"]), fine=True) == [("delete", "abcx "), ("insert", "abcz "), ("equal", "y ")]
    ops = X.token_ops(d, [(0, 2), (3, 11), (12, 20), (21, 25)], fine=True)
    assert [(o["type"], o["start"], o["length"], o["content"]) for o in ops] == [("match", 0, 20, None), ("insert", 12, 8, None), ("delete", 20, 8, "licensed"), ("match", 21, 4, None)]


@pytest.mark.parametrize(
    "diffs, ident, why",
    [
        ([("equal", ["under", "version"]), ("insert", ["7"])], "X", "version"),
        ([("equal", ["the", "standard", "version"]), ("insert", ["7"])], "X", None),
        ([("equal", ["the", "contributor", "version"]), ("delete", ["6"]), ("insert", ["7.1", "or"])], "X", None),
        ([("equal", ["under", "version"]), ("delete", ["7"])], "X", None),
        ([("insert", ["some", "affero", "text"])], "AGPL-1", "phrase"),
        ([("delete", ["affero"])], "AGPL-1", None),
        ([("insert", ["affero"])], "MIT", None),
        ([("equal", ["the", "gnu"]), ("insert", ["lesser"])], "GPL", "lesser"),
        ([("equal", ["the", "gnu"]), ("delete", ["lesser"])], "GPL", "lesser"),
        ([("equal", ["the", "gnu"]), ("delete", ["library"]), ("insert", ["lesser"])], "GPL", None),
        ([("equal", ["the", "gnu"]), ("delete", ["lesser"]), ("insert", ["library"])], "GPL", "lesser"),
        ([("equal", ["no", "warranty", "gnu"]), ("insert", ["lesser"])], "GPL", None),
        ([("equal", ["gnu"]), ("delete", ["library"]), ("equal", ["gnu"]), ("insert", ["lesser"])], "GPL", "lesser"),
    ],
)
def test_rejections(diffs, ident, why):
    assert X.rejected(diffs, ident) == why


def test_problem_forms(spark):
    one = lambda t: value(spark, D.problem(F.lit(t)))
    assert tuple(one("lib/a.dart is a part and cannot be analyzed.")) == ("ERROR", "ANALYSIS", "UNKNOWN", "lib/a.dart", 0, 0, 0, "is a part and cannot be analyzed.")
    assert one("STDERR exceeded 9 lines.").error_code == "TOO_MANY_LINES"
    assert one("") is None and one("Please pass in a library that contains this part.") is None and one("what?") is None
    with pytest.raises(Exception, match="unexpected output: what"):
        value(spark, D.problem(F.lit("what?"), strict=True))


def test_formatter(spark):
    run = lambda out, code: tuple(value(spark, D.formatted(F.lit(out), F.lit(code), F.lit("/w/pkg/"))))
    assert run("Changed /w/pkg/lib/b.dart\nChanged /w/pkg/bin/a.dart\nChanged /w/pkg/test/c.dart\nFormatted 3", 0) == (["bin/a.dart", "lib/b.dart"], None)
    assert run("boom\nChanged lib/a.dart", 1) == (["lib/a.dart"], None)
    assert run("boom\nChanged lib/a.dart", 2) == (None, "boom\nChanged lib/a.dart")
    assert run("line 3, column 9 of /w/pkg/example/x.dart: odd\n 4 | code\nCould not format because the source could not be parsed:", 65) == ([], None)
    assert run("line 3, column 9 of /w/pkg/lib/x.dart: odd\n" + "x\n" * 30, 65) == (None, "line 3, column 9 of /w/pkg/lib/x.dart: odd\n" + "\n".join("x" * 19))


def test_markdown():
    text = """# Top ![logo](img/a.png "the logo") and [home](https://a.b/c_(d))
[![badge](http://b.c/x.svg)](https://ci) [by name][Ref  One] [ref one] <https://auto.x/y?a=1&b=2> <me@x.org>

    [code](block)

```
[fenced](f)
```
`[span](s)` <a class="k" href='raw?a=1&amp;b=2'>x</a> <IMG SRC=last.gif> <!-- <a href="hidden"> --> [home again](https://a.b/c_(d))

[ref one]: <sp.md> 'title'
"""
    assert MD.content(text) == (["img/a.png", "http://b.c/x.svg", "last.gif"], ["https://a.b/c_(d)", "https://ci", "sp.md", "https://auto.x/y?a=1&b=2", "mailto:me@x.org", "raw?a=1&b=2"])
    assert MD.content("") == ([], []) and MD.content("[a] [b](") == ([], [])


def test_rendering(spark):
    span = lambda t, l, c, n: value(spark, N.source_span(F.lit(t), F.lit(l), F.lit(c), F.lit(n)))
    assert tuple(span("ab\ncde\n", 2, 2, 2)) == (4, 2, "de") and tuple(span("ab\r\ncd", 1, 3, 3)) == (3, 3, "\ncd")
    assert tuple(span("ab\r\ncd", 1, 2, 2)) == (1, 1, "b") and span("ab", 3, 1, 1) is None and span("ab", 1, 9, 1) is None and span("\r\r", 1, 1, 2) is None
    assert span("x" * 900, 1, 1, 900).length == 512
    assert tuple(value(spark, N.key_span(F.lit("name: x\nsdk:  '>=2'\n sdk: no\n"), "sdk"))) == (14, 5, "'>=2'") and value(spark, N.key_span(F.lit("a: 1"), "b")) is None
    assert value(spark, N.import_path(F.array(F.lit("a"), F.lit("b")))) == "* `a` that imports:\n* `b`"
    assert value(spark, N.summary(F.lit("Intro"), F.array(F.lit("one"), F.lit("two\n")))) == "Intro\n\none\n\ntwo\n"


def test_json_and_lists(spark):
    assert value(spark, L.json_value(F.lit("{"))) is None and value(spark, L.json_value(F.lit('{"a": [1]}')).cast("string")) == '{"a":[1]}'
    assert value(spark, L.required(F.lit("x"), F.lit("no target"))) == "x"
    with pytest.raises(Exception, match="no target"):
        value(spark, L.required(F.lit(None).cast("string"), F.lit("no target")))
    with pytest.raises(Exception, match="not a number of seconds"):
        value(spark, L.seconds(F.lit("1.5")))
    with pytest.raises(Exception, match="no version file"):
        value(spark, L.kit_version(F.lit(None).cast("string"), F.lit(" ")))


def test_yaml():
    assert J.yaml_object("b: 1\na: {d: [1, x], c: 2020-01-01}\n") == {"a": {"c": "2020-01-01", "d": [1, "x"]}, "b": 1}
    assert J.yaml_object("- 1") is None and J.yaml_object(None) is None
    assert J.yaml_object("<<: {a: 1}") == {"<<": {"a": 1}}
    for bad in ("a: &x\n  b: *x", "a: " + "{a: " * 70 + "1" + "}" * 70, "a: &a [x,x,x,x,x,x,x,x,x,x]\nb: &b [*a,*a,*a,*a,*a,*a,*a,*a,*a,*a]\nc: &c [*b,*b,*b,*b,*b,*b,*b,*b,*b,*b]\nd: [*c,*c,*c,*c,*c,*c,*c,*c,*c,*c]", "a: [", "? [a]\n: 1"):
        with pytest.raises(J.Malformed):
            J.yaml_object(bad)


def test_options():
    got = json.loads(J.merged_options("analyzer:\n  errors: {x: ignore}\n  exclude: [gen/**]\nlinter:\n  rules: {b: false}\ninclude: theirs\n", "linter:\n  rules: [a]\n"))
    assert got == {"linter": {"rules": {"a": True, "b": False}}, "analyzer": {"exclude": ["test/**", "example/**", "gen/**"], "errors": {"x": "ignore"}}, "include": "theirs"}
    assert json.loads(J.merged_options("a: [", "include: mine"))["include"] == "mine"


def test_manifest(spark):
    m = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv]) if d else F.create_map().cast("map<string,string>")
    sdks = J.dependent_sdks(m({"sdk": ">=2", "flutter": ">=1"}), m({"a": None, "b": "fuchsia"}), m({}))
    assert value(spark, sdks) == ["flutter", "fuchsia"]
    assert value(spark, J.unknown_sdks(sdks)) == ["fuchsia"]
    assert value(spark, J.shown_dependencies(F.array(F.lit("b"), F.lit("a-x")), F.array(F.lit("a"), F.lit("b")))) == ["a", "b"]
    assert value(spark, J.has_path(F.lit('{"a": {"b": null}}'), "a", "b")) is True
    assert value(spark, J.has_path(F.lit('{"a": {}}'), "a", "b")) is False
    assert value(spark, J.yaml_json(F.lit("b: 1\na: 2"))) == '{"a": 2, "b": 1}'


def test_generators(spark):
    """Own checks, joined LATERAL; the first of each partition, and how many more."""
    from gristmill.functions import generators

    checks = {"shout": lambda t: re.findall("[A-Z]{3,}", t), "empty": lambda t: ["empty"] if not t else []}
    generators.register(spark, checks, "own_checks", shown=2)
    texts = {1: "ABC def GHI JKL MNO", 2: "", 3: None, 4: "quiet", 5: "ONE TWO"}
    df = spark.createDataFrame(list(texts.items()), "key long, text string")
    issues = spark.sql("SELECT t.key, i.* FROM {t} t, LATERAL own_checks(t.text) i", t=df)
    assert sorted(map(tuple, issues.collect())) == [(1, "shout", 1, "ABC"), (1, "shout", 2, "GHI"), (1, "shout", 3, "JKL"), (1, "shout", 4, "MNO"), (2, "empty", 1, "empty"), (5, "shout", 1, "ONE"), (5, "shout", 2, "TWO")]
    shown = spark.sql("SELECT * FROM own_checks_shown(TABLE({i}) PARTITION BY key ORDER BY nth DESC)", i=issues)
    assert sorted(map(tuple, shown.collect())) == [(1, 1, "shout", 4, "MNO"), (1, 2, "shout", 3, "JKL"), (1, 3, "more", 2, None), (2, 1, "empty", 1, "empty"), (5, 1, "shout", 2, "TWO"), (5, 2, "shout", 1, "ONE")]
