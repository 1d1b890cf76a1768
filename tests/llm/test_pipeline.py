import collections
import hashlib
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages(spark, docs, empty):
    import corpus_pipeline as C

    assert [n for n, _ in C.STAGES] == ["quality rules", "line dedup", "near dedup", "mixing", "byte BPE"]
    for table in (docs, empty):
        for k, (_, stage) in enumerate(C.STAGES):
            out = stage(spark, table, "")
            assert out.count() <= 3 * table.count()
            if k + 1 < len(C.STAGES):
                assert out.columns == table.columns


def test_decisions(spark, docs):
    import corpus_pipeline as C

    kept = {r.doc_id for r in C.quality_rules(spark, docs, "").collect()}
    assert 2 not in kept and 4 not in kept and 10 in kept
    near = [r.doc_id for r in C.near_dedup(spark, docs, "").collect()]
    assert 100 in near and not set(near) & set(range(101, 115)) and 10 in near
    lines = {r.doc_id for r in C.line_dedup_stage(spark, docs, "").collect()}
    assert 100 in lines and 101 not in lines


def brute_pipeline(rows):
    """(id, digest of the ids) of each copy, by loops over (id, text, source)."""
    from test_llm_operators import WORDS, brute_classes, brute_lines, brute_quality, tiktoken_encoding

    fails, bad = collections.defaultdict(list), []
    for _, t, source in rows:
        m = brute_quality(t)
        bad.append(m[0] < 20 or 100 * m[4] > 30 * m[0])
        if source is not None:
            fails[source].append(bad[-1])
    rate = [np.mean(x) for x in fails.values()]
    mean, var = np.mean(rate), np.var(rate)
    k = max(1, mean * (1 - mean) / var - 1) if var > mean * (1 - mean) / 1e6 else 1e6
    gone = {h for h, x in fails.items() if (sum(x) + mean * k) / (len(x) + k) > 0.5}
    rows = [r for r, b in zip(rows, bad) if not b and r[2] not in gone]
    text = brute_lines([(i, t) for i, t, _ in rows])
    rows = [(i, text[i], s) for i, _, s in rows if WORDS.search(text[i])]
    classes = brute_classes([(i, t) for i, t, _ in rows], 5)
    rows = [r for r in rows if r[0] is None or classes[r[0]][1] == r[0]]
    n = collections.Counter(s for *_, s in rows)
    enc = tiktoken_encoding()
    for i, t, s in rows:
        lam = n[s] ** 0.5 / sum(x**0.5 for x in n.values()) * len(rows) / n[s]
        u = int(hashlib.md5(f"17:{chr(0) + 'none' if i is None else i}".encode()).hexdigest()[:12], 16) / 2**48
        p = cdf = math.exp(-lam)
        copies = 0
        while cdf <= u:
            copies += 1
            p *= lam / copies
            cdf += p
        digest = hashlib.sha256(" ".join(map(str, enc.encode_ordinary(t))).encode()).hexdigest()
        yield from [(i, digest)] * copies


def test_brute(spark, docs, tmp_path):
    import corpus_pipeline as C

    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    got = collections.Counter((r.doc_id, r.ids_sha256) for r in C.run(spark, f"file://{tmp_path}").collect())
    want = collections.Counter(brute_pipeline([(r.doc_id, r.text or "", r.source) for r in docs.collect()]))
    assert got == want and len(got) > 5


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_run(spark):
    """The pipeline's rows against its stages one by one, and their ids against the texts they decode to."""
    import __spark_entry__ as entry

    got = entry.queries()["pipeline"](spark, SF)
    assert {"doc_id", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256"} <= set(got.columns)
    rows = got.collect()
    assert rows and all(r.n_tokens == len(r.ids) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["op3_host_rules", "op4_line_dedup", "op6_poisson_mix", "op8_pivot_search", "op9_superminhash"])
def test_oracles(spark, name):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    got = entry.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = con.sql(entry.oracle_sql()[name]).to_arrow_table().to_pylist()
    row = lambda r: tuple(repr(round(r[c], 9) if isinstance(r[c], float) else r[c]) for c in cols)
    assert sorted(map(row, got.toArrow().to_pylist())) == sorted(map(row, want))
