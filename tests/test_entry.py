import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "item_id", "similarity"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["token_similarity", "diagonal_runs", "density_windows", "link_classes", "problem_order", "section_score", "doc_coverage", "outdated_grace", "reachability", "id_diff", "package_report", "platform_verdicts", "sdk_verdicts", "page_content", "source_spans", "repository_urls", "dependency_tables", "first_import_paths", "assembled_lines", "page_issues", "paged_names"])
def test_oracles(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    got = entry.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = con.sql(entry.oracle_sql()[name]).to_arrow_table().to_pylist()
    row = lambda r: tuple(repr(r[c]) for c in cols)
    assert sorted(map(row, got.toArrow().to_pylist())) == sorted(map(row, want))


def test_streaming(spark, tmp_path):
    from gristmill.streaming.lines import log_lines, problem_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("ERROR|A|B|f.dart|1|2|3|x\nnoise\nERROR|A|B|f.dart|1|2|9|x\n")
    q = problem_stream(log_lines(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("found").outputMode("append").start()
    try:
        q.processAllAvailable()
        assert spark.sql("select * from found").count() == 1
    finally:
        q.stop()
