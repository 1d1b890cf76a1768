import json
import random
import re

import pytest
from pyspark.sql import functions as F

from gristmill.sources import session, tables
from gristmill.streaming import chunks, lines


def test_corpus(spark, tmp_path):
    (tmp_path / "Some-1.0.txt").write_text(f"one\n{tables.END_MARK}\nmore")
    (tmp_path / "Other+.txt").write_text("two")
    (tmp_path / "._Other.txt").write_text("fork")
    found = tables.files(spark, str(tmp_path), ".txt")
    text, broken = tables.decoded(F.col("content"))
    rows = [tuple(r) for r in tables.corpus(found.select("path", text.alias("content"))).collect()]
    assert rows == [("Other+", "two"), ("Some-1.0", f"one\n{tables.END_MARK}"), ("Some-1.0", f"one\n{tables.END_MARK}\nmore")]
    assert not any(r.b for r in found.select(broken.alias("b")).collect())
    (tmp_path / "no id!.txt").write_text("x")
    with pytest.raises(Exception, match="not a known text"):
        tables.corpus(tables.files(spark, str(tmp_path), ".txt").select("path", F.col("content").cast("string").alias("content"))).collect()


def test_broken_bytes(spark):
    r = spark.createDataFrame([(bytearray(b"a\xffb"),), (bytearray("é".encode()),)], "c binary")
    text, broken = tables.decoded(F.col("c"))
    assert [tuple(x) for x in r.select(text, broken).collect()] == [("a\ufffdb", True), ("é", False)]


def test_listings(spark, tmp_path):
    paths = spark.createDataFrame([("/p/lib/b.dart",), ("/p/lib/a/c.dart",), ("/p/test/lib/x.dart",), ("/p/lib/d.txt",), ("/p/LICENSE",), ("/p/LICENSE.md",)], "path string")
    assert [r.path for r in tables.library_files(paths, "/p/", ".dart").collect()] == ["/p/lib/a/c.dart", "/p/lib/b.dart"]
    assert [r.path for r in tables.own_text(paths).collect()] == ["/p/LICENSE"]
    assert spark.range(1).select(tables.tree_listing(F.lit("a\0b/c\0")).alias("x")).first().x == ["a", "b/c"]
    (tmp_path / "i.json").write_text(json.dumps([{"a": 1, "b": [2]}, {"a": 3}]))
    assert [tuple(r) for r in tables.json_array(spark, str(tmp_path / "i.json"), "a int, b array<int>").orderBy("a").collect()] == [(1, [2]), (3, None)]
    maps = spark.createDataFrame([("x", [5, 6])], "path string, ids array<int>")
    assert [tuple(r) for r in tables.id_lists(maps).collect()] == [("x", 0, 5), ("x", 1, 6)]
    tables.write_report(spark.createDataFrame([(1, None)], "a int, b string"), f"file://{tmp_path}/out")
    assert spark.read.text(f"file://{tmp_path}/out").first()[0] == '{"a":1}'


def test_settings(tmp_path):
    for name, text in (("c.yaml", "a: 2\nc: [x]\n"), ("c.json", '{"a": 2, "c": ["x"]}')):
        (tmp_path / name).write_text(text)
        assert tables.settings(str(tmp_path / name), {"a": 1, "b": 1}) == {"a": 2, "b": 1, "c": ["x"]}
    assert tables.settings(None, {"a": 1}) == {"a": 1}
    (tmp_path / "e.yml").write_text("")
    assert tables.settings(str(tmp_path / "e.yml"), {"a": 1}) == {"a": 1}
    with pytest.raises(ValueError):
        tables.settings("c.txt", {})


def test_scoped(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with pytest.raises(KeyError), session.scoped(spark, spark__sql__shuffle__partitions="7", gristmill__own="x"):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "7" and spark.conf.get("gristmill.own") == "x"
        raise KeyError
    assert spark.conf.get("spark.sql.shuffle.partitions") == before and spark.conf.get("gristmill.own", None) is None


def run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.sql(f"select * from {name}").collect()


def test_streams(spark, tmp_path):
    """Windows, sessions and the cache over events by the minute."""
    (tmp_path / "in").mkdir()
    minutes = [(0, "a"), (1, "a"), (6, "b"), (7, "a"), (50, "a")]
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"ts": f"2024-01-01T00:{m:02}:00Z", "kind": k, "n": m}) for m, k in minutes))
    events = spark.readStream.schema("ts timestamp, kind string, n int").json(str(tmp_path / "in"))
    counts = {(r.start.minute, r.kind): r.n for r in run(lines.event_counts(events, "ts", "kind"), "windows", "complete")}
    assert counts == {(0, "a"): 2, (5, "b"): 1, (5, "a"): 1, (50, "a"): 1}
    found = sorted((r.kind, r.start.minute, r.n) for r in run(lines.sessions(events, "ts", "kind", "20 minutes"), "visits", "complete"))
    assert found == [("a", 0, 3), ("a", 50, 1), ("b", 6, 1)]
    cached = {r.kind: (r.n, r.expired) for r in run(lines.cached_values(events, "kind", "n"), "cached", "append")}
    assert cached == {"a": (50, False), "b": (6, False)}


def brute_lines(data, spoils):
    out = []
    for part in re.split(rb"[\r\n]+", data):
        if part:
            text = part.decode("utf-8", "replace")
            out.append((len(out) + 1, text, spoils(text)))
            if spoils(text):
                break
    return out


def test_assembled_lines(spark, tmp_path):
    """Cut at every byte, in one or many batches and out of order, with a character over a cut and a line that spoils the rest."""
    whole = "ERROR|A|B|f.dart|1|2|3|\u00e9t\u00e9\r\n\nERROR|A|B|g.dart|1|2|3|x\rnoise\nERROR|A|B|h.dart|1|2|3|x\nend".encode()
    spoils = lambda line: "bad" if line == "noise" else None
    rows = []
    for at in range(len(whole) + 1):
        rows += [(f"cut{at}", 0, whole[:at], False), (f"cut{at}", 1, whole[at:], True)]
    rows += [("bytes", k, whole[k : k + 1], k == len(whole) - 1) for k in range(len(whole))]
    rows += [("good", 0, b"one\xfftwo\r", False), ("good", 0, b"again", False), ("good", 2, b"ee\n", True), ("good", 1, b"thr", False), ("open", 0, b"no end", False), ("long", 0, b"x" * 300, True), ("early", 9, b"x\n", True), ("null", None, b"x", True), ("null", 0, None, True)]
    random.Random(4).shuffle(rows)
    (tmp_path / "in").mkdir()
    frame = spark.createDataFrame(rows, "source string, seq long, data binary, last boolean")
    for batch, some in enumerate(frame.randomSplit([1.0] * 4, 7)):
        some.coalesce(1).write.parquet(f"{tmp_path}/in/{batch}")
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    got = run(chunks.assembled(stream, "source", spoils, most_bytes=200), "lines_of_chunks", "append")
    by = {}
    for r in sorted(got, key=lambda r: (r.source, r.n)):
        by.setdefault(r.source, []).append((r.n, r.line, r.error))
    want = brute_lines(whole, spoils)
    assert [e for *_, e in want] == [None, None, "bad"]
    assert all(by[f"cut{at}"] == want for at in range(len(whole) + 1)) and by["bytes"] == want
    assert by["good"] == [(1, "one\ufffdtwo", None), (2, "three", None)]
    assert "open" not in by and "early" not in by and "null" not in by and by["long"] == [(1, None, "a line of more than 200 bytes")]
    assert chunks.unexpected("noise") and not any(chunks.unexpected(x) for x in ("", "ERROR|A|B|f.dart|1|2|3|x", "x is a part and cannot be analyzed."))


def test_assembled_after_restart(spark, tmp_path):
    """A line that is open when the query stops goes on when it starts again from its checkpoint."""
    (tmp_path / "in").mkdir()
    schema = "source string, seq long, data binary, last boolean"
    rows = []
    for k, part in enumerate((b"first\nsec", b"ond\nthird\n")):
        spark.createDataFrame([("a", k, part, k == 1)], schema).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        q = chunks.assembled(stream, "source").writeStream.option("checkpointLocation", f"{tmp_path}/state").format("parquet").trigger(availableNow=True).start(f"{tmp_path}/out")
        q.awaitTermination(120)
        assert q.exception() is None
        rows.append(sorted(r.line for r in spark.read.parquet(f"{tmp_path}/out").collect()))
    assert rows == [["first"], ["first", "second", "third"]]


def pages(folder, listing):
    for n, names in listing.items():
        (folder / f"page={n}").mkdir(parents=True)
        (folder / f"page={n}" / "a.json").write_text(json.dumps({"packages": [{"package": x} for x in names]}) + "\n")


def test_paged_listing(spark, tmp_path):
    """Pages beyond the needed ones are broken, so that reading one of them would fail."""
    from gristmill.sources import paged

    pages(tmp_path, {n: [f"p{n}_{k}" for k in range(3)] + ["same"] for n in range(1, 7)} | {9: ["late"]})
    for n in (4, 5, 6):
        (tmp_path / f"page={n}" / "a.json").write_text("broken")
    path = f"file://{tmp_path}"
    assert [tuple(r) for r in paged.listing(spark, path, 2, 2).collect()] == [(2, 0, "p2_0"), (2, 1, "p2_1"), (2, 2, "p2_2"), (2, 3, "same")]
    names = lambda n, **o: [r.package for r in paged.selected(spark, path, n, at_once=1, **o).collect()]
    assert names(2) == ["p1_0", "p1_1"] and names(7) == ["p1_0", "p1_1", "p1_2", "p2_0", "p2_1", "p2_2", "same"]
    assert names(2, keep=lambda d: d.where(F.col("package") != "p1_1")) == ["p1_0", "p1_2"]
    with pytest.raises(Exception, match="JSON|Expecting"):
        names(11)  # pages 1, 2 and 3 have ten


def test_paged_listing_ends(spark, tmp_path):
    from gristmill.sources import paged

    pages(tmp_path, {1: ["b", "a"], 2: ["c"], 3: [], 4: ["not reached"], 6: ["nor this"]})
    assert [r.package for r in paged.selected(spark, f"file://{tmp_path}", 10).collect()] == ["a", "b", "c"]
    assert paged.selected(spark, f"file://{tmp_path}/none", 10).count() == 0


def test_paged_stream(spark, tmp_path):
    """New pages come once each, also after a restart from the checkpoint."""
    from gristmill.sources import paged

    spark.dataSource.register(paged.PagedListing)
    source, out, mark = tmp_path / "in", f"file://{tmp_path}/out", f"file://{tmp_path}/mark"
    seen = []
    for k, new in enumerate(({1: ["a"], 2: ["b"]}, {3: ["c"], 5: ["no"]}, {4: ["d"]})):
        pages(source, new)
        q = spark.readStream.format(paged.NAME).load(f"file://{source}").writeStream.format("parquet").option("checkpointLocation", mark).trigger(availableNow=True).start(out)
        q.awaitTermination(60)
        seen.append(sorted(r.package for r in spark.read.schema("package string").parquet(out).collect()))
    assert seen == [["a", "b"], ["a", "b", "c"], ["a", "b", "c", "d", "no"]]


def test_report_sink(spark, tmp_path):
    from gristmill.sources import report_sink as sink

    path = f"file://{tmp_path}/reports"
    first = spark.range(20, numPartitions=3).select(F.concat(F.lit("p/é"), "id").alias("name"), F.to_json(F.struct("id")).alias("report"))
    with pytest.raises(AssertionError, match="written now"):
        sink.expect_reports(first, path)
    sink.expect_reports(first.repartition(2), path)
    before = sink.manifest(path)
    assert before["reports"] == 20 and sink.read_reports(spark, path).count() == 20
    failing = first.withColumn("report", F.when(F.col("name") != "p/é19", F.col("report")))
    with pytest.raises(Exception, match="needs a name"):
        sink.write_reports(failing, path)
    assert sink.manifest(path) == before and not [x for x in (tmp_path / "reports").iterdir() if x.name.startswith("_")]
    with pytest.raises(AssertionError, match="p/é3"):
        sink.expect_reports(first.where("name <> 'p/é3'"), path)
    sink.write_reports(first.limit(0), path)
    assert sink.manifest(path)["reports"] == 0 and sink.read_reports(spark, path).count() == 0
