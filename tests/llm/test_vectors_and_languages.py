"""The operators on embeddings and the language model, against brute force or held-out rows, with the odd cases."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

ODD = [(2000, None), (2100, []), (2200, [float("nan")] * 8), (2300, [1.0] * 7 + [None]), (2400, [1.0, 2.0]), (2500, [3.0, 1.0]), (2600, [float("inf")] * 8)]


def whole(v, scale):
    """floor(scale * x) as Python integers, or None where the vector takes no part."""
    if v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v):
        return None
    return [int(np.floor(scale * float(np.float32(x)))) for x in v]


# 12
def test_chan_parts():
    from gristmill.llm import whitening as W

    g = np.random.default_rng(5)
    x = np.floor(g.normal(size=(500, 6)) * 1000) + 10.0**9
    parts = [W.part_of(x[a:b], True) for a, b in ((0, 1), (1, 40), (40, 41), (41, 500))]
    one = W.merged(W.merged(parts[0], parts[1]), W.merged(parts[2], parts[3]))
    c = x - x.mean(0)
    assert one[0] == 500 and one[1] == [int(s) for s in x.sum(0)] and np.allclose(one[2], c.T @ c, rtol=1e-12)
    assert W.squared(np.array([[2**61, -(2**61) + 1], [-7, 3], [0, -(2**40) - 5]])) == [2**122 + (2**61 - 1) ** 2, 58, (2**40 + 5) ** 2]


def brute_whitening(vectors, components=8):
    """(id, component) -> (n, deviation, |whitened|, explained) of rows of one length."""
    x = np.array([v for _, v in vectors], object)
    n, s = len(x), sum(x)
    d = n * x - s
    v = (d / n).astype(float)
    e, u = np.linalg.eigh(v.T @ v / n)
    out = {}
    for k in range(min(components, len(e))):
        if e[-1 - k] > 1e-12 * e[-1]:
            for (i, _), row, own in zip(vectors, v, d):
                out[i, k + 1] = (n, sum(int(a) ** 2 for a in own), abs(row @ u[:, -1 - k]) / np.sqrt(e[-1 - k]), e[-1 - k] / e.sum())
    return out


def test_whitening(spark):
    from gristmill.llm import whitening as W

    g = np.random.default_rng(3)
    vectors = [(k, (g.normal(size=8) * [9, 7, 5, 4, 3, 2, 1, 0.5] + 100).tolist()) for k in range(300)] + [(500 + k, [0.25] * 8) for k in range(200)] + ODD + [(2400, [5.0, 2.5])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumns({"dim": F.lit("own"), "component": F.lit(1)}).repartition(7)
    got = W.whiten(df).collect()
    by_dim = {}
    for i, v in vectors:
        if x := whole(v, 1024):
            by_dim.setdefault(len(x), []).append((len(by_dim.get(len(x), [])) * 10**6 + i, x))
    want = {(i % 10**6, c, round(float(d))): r for dim, rows in by_dim.items() for (i, c), r in brute_whitening(rows).items() for d in [r[1]]}
    assert len(got) == sum(len(brute_whitening(r)) for r in by_dim.values())
    for r in got:
        n, d, w, e = want[r.vec_id, r.component, round(float(r.deviation))]
        assert (r.n, int(r.deviation)) == (n, d) and np.isclose(abs(r.whitened), w, rtol=1e-9, atol=1e-9) and np.isclose(r.explained, e) and r.identity_error < 1e-9
    assert W.whiten(df.limit(0)).count() == 0 and W.whiten(df.where("vec_id between 500 and 699")).count() == 0


def test_whitening_of_large_numbers(spark):
    from gristmill.llm import whitening as W

    vectors = [(k, [float(2.0**40 * k), float(k * k % 7)]) for k in range(50)] + [(None, [1.0, 2.0]), (7, [7.0, 7.0])]
    got = W.whiten(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).where("component = 1").collect()
    x = np.array([[int(1024 * a) for a in v] for _, v in vectors], object)
    d = len(x) * x - sum(x)
    assert sorted(int(r.deviation) for r in got) == sorted(int(sum(a * a for a in row)) for row in d)


@pytest.fixture(scope="session")
def small_embeddings(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("embeddings"))
    g = np.random.default_rng(8)
    rows = [(k, g.normal(size=6).astype(np.float32).tolist(), int(k % 10)) for k in range(150)] + [(200, None, 1), (300, [1.0] * 5 + [None], 2), (400, [2.0] * 6, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path, rows


def test_op12(spark, small_embeddings):
    from gristmill.llm import queries

    path, rows = small_embeddings
    got = queries.queries()["op12_whitening"](spark, path).collect()
    want = brute_whitening([(i, [100_000 + a for a in x]) for i, v, _ in rows if (x := whole(v, 1024))])
    assert {(r.vec_id, r.component) for r in got} == set(want)
    for r in got:
        n, d, w, e = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, d) and np.isclose(abs(r.whitened), w, rtol=1e-9) and np.isclose(r.explained, e)


# 13
def brute_negatives(rows, scale=256, positives=5, negatives=10):
    x = {i: (whole(v, scale), y) for i, v, y in rows if i is not None and y is not None and whole(v, scale)}
    out = set()
    for a in (i for i in x if i % 100 == 0):
        score = {i: sum(p * q for p, q in zip(x[a][0], v)) for i, (v, _) in x.items() if i != a and len(v) == len(x[a][0])}
        same = sorted((-s, i) for i, s in score.items() if x[i][1] == x[a][1])[:positives]
        for s, p in ((-s, p) for s, p in same):
            window = sorted((-t, i) for i, t in score.items() if x[i][1] != x[a][1] and 30 * s <= 100 * t <= 90 * s)[:negatives]
            out |= {(a, p, k + 1, i, s, -t) for k, (t, i) in enumerate(window)}
    return out


def test_hard_negatives(spark):
    from gristmill.llm import hard_negatives as H

    g = np.random.default_rng(4)
    rows = [(k, (g.normal(size=8) * g.choice([0.2, 1, 4])).tolist(), int(g.integers(0, 4))) for k in range(900)]
    rows += [(1000 + k, [0.5] * 8, k % 3) for k in range(600)] + [(1700 + k, [0.0] * 8, 1) for k in range(30)]
    rows += [(i, v, 1) for i, v in ODD] + [(None, [1.0] * 8, 1), (3000, [1.0] * 8, None), (3100, [9.0] * 8, 77), rows[300], rows[5]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"norm": F.lit("own"), "bucket": F.lit(1), "label_of_row": F.lit(2)})
    want = brute_negatives(rows)
    for size in ({"bucket_rows": 16, "lane_buckets": 4, "anchor_rows": 5}, {}):
        got = [tuple(r) for r in H.mine(df, lambda i: i % 100 == 0, **size).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert H.mine(df.limit(0), lambda i: i % 100 == 0).count() == 0


def test_bounds_leave_buckets_out(monkeypatch):
    import pyarrow as pa

    from gristmill.llm import hard_negatives as H

    g = np.random.default_rng(6)
    v = g.normal(size=(640, 4)) * np.linspace(100, 1, 640)[:, None]
    v = np.floor(v[np.argsort(-np.linalg.norm(v, axis=1))])
    lane = pa.table({"vec_id": np.arange(640), "label": np.zeros(640, int), "bucket": np.arange(640) // 32, "v": pa.array([x.tobytes() for x in v])})
    asked = pa.table({"anchor_id": [-1], "label": [0], "v": pa.array([v[3].tobytes()]), "windows": pa.array([[{"window": 0, "low": -(2**63), "high": 2**63 - 1}]])})
    met, own = [], H.products
    monkeypatch.setattr(H, "products", lambda a, b: met.append(len(b)) or own(a, b))
    got = H._search_lane(asked, lane, 4, 5, True)
    assert sum(met) < 640 and got["other_id"].to_pylist() == sorted(range(640), key=lambda i: (-(v[3] @ v[i]), i))[:5]


def test_op13(spark, small_embeddings):
    from gristmill.llm import queries

    path, rows = small_embeddings
    got = {(r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in queries.queries()["op13_hard_negatives"](spark, path).collect()}
    moved = [(i, v, None if y is None else (y + 1) % 10 if i % 7 == 0 else y) for i, v, y in rows]
    assert got == brute_negatives(moved)


# 8, 13: whatever the size of the components
def test_exact_products():
    from gristmill.llm import _vectors as V

    g = np.random.default_rng(1)
    for top in (2.0**10, 2.0**29, 2.0**40, 2.0**61, 2.0**90):
        a, b = np.floor(g.normal(size=(5, 7)) * top), np.floor(g.normal(size=(6, 7)) * 2.0 ** g.integers(0, 12, (6, 1)))
        b[0] = 0
        score, key = V.products(a, b)
        for i in range(5):
            for j in range(6):
                exact = sum(int(x) * int(y) for x, y in zip(a[i], b[j]))
                assert score[i, j] == max(-V.MOST, min(V.MOST, exact))
                assert (key is None or key[i, j] == 0) == (abs(exact) <= V.MOST)


def test_pivot_search_of_large_components(spark):
    from gristmill.llm import pivot_search as S

    g = np.random.default_rng(7)
    rows = [(k, g.normal(size=4).tolist()) for k in range(300)] + [(300, [5e15, 1.0, -2.0, 0.5]), (301, [-5e15, 2.0, 0.0, 0.0]), (302, [1e200, 0.0, 1.0, 0.0]), (400, [1e160, 1.0, 1.0, 1.0])]
    rows += [(100, [9.0, 9.0, 9.0, 9.0]), (100, [8.0, 9.0, 9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in S.search(df, lambda i: i % 100 == 0, block_rows=32, pivots=4, annuli=2).collect()}
    x = {}
    for i, v in rows:
        v = np.floor(1024 * np.array(v))
        x[i] = min(x.get(i, v), v, key=lambda v: v.astype("<f8").tobytes())
    ints = {i: [int(a) for a in v] for i, v in x.items()}
    for q in (i for i in x if i % 100 == 0):
        best = sorted((-sum(a * b for a, b in zip(ints[q], ints[v])), v) for v in x if v != q)[:10]
        assert [got[q, k + 1] for k in range(10)] == [(v, max(-(2**63) + 1, min(2**63 - 1, -s))) for s, v in best]


# 11
SPOKEN = {"aa": "the of and house tree water river stone".split(), "bb": "der die und haus baum wasser fluss stein".split(), "cc": "où été élève forêt château rivière pierre maison".split()}


def spoken(g, lang, n):
    return " ".join(g.choice(SPOKEN[lang], n))


@pytest.fixture(scope="session")
def languages(spark):
    g = np.random.default_rng(2)
    rows = [(k, spoken(g, lang := "aab"[k % 3] * 2 if k % 10 else "cc", int(g.integers(3, 60))), lang) for k in range(400)]
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 % ...\n", None), (1003, "THE House, and the RIVER!", None), (1004, "x" * 5000, None), (None, "der die und", "bb")]
    rows += [(1100, spoken(g, "aa", 60) + " " + spoken(g, "bb", 40), None), (1101, spoken(g, "aa", 400000), None), rows[3], rows[3]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"letters": F.lit("own"), "score": F.lit(1), "lang_pred": F.lit("own")})


def test_language_mix(languages, monkeypatch):
    from gristmill.llm import language_mix as L

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4, F.lit(0)) == 2
    model = L.learn(languages.where(~held))
    assert model.languages == ["aa", "bb", "cc"]
    got = L.predict(model, languages, ["doc_id", F.col("lang").alias("own"), held.alias("held"), F.col("text").alias("whole")]).collect()
    assert len(got) == languages.count()
    assert all(r.lang_pred == r.own for r in got if r.own and r.doc_id != 1000 and r.doc_id != 1001)
    at = {r.doc_id: r for r in got}
    assert {at[i].lang_pred for i in (1000, 1001, 1002)} == {"und"} and {at[i].score for i in (1000, 1001, 1002)} == {0.0}
    assert at[1003].lang_pred == "aa" and 0 <= at[1004].score <= 1
    assert set(at[1100].mixture) == {"aa", "bb"} and abs(at[1100].mixture["aa"] - 0.6) < 0.05 and set(at[1101].mixture) == {"aa"}
    assert all(0 <= r.score <= 1 and abs(sum(r.mixture.values()) - bool(r.mixture)) < 1e-6 for r in got)
    empty = L.learn(languages.limit(0))
    assert {r.lang_pred for r in L.predict(empty, languages, ["doc_id"]).collect()} == {"und"}
    assert L.predict(model, languages.limit(0), ["doc_id"]).count() == 0


def test_pieces_change_nothing(languages, monkeypatch):
    import pyarrow as pa

    from gristmill.llm import language_mix as L

    model = L.learn(languages)
    texts = pa.array([r.x for r in languages.select(L.letters(F.col("text")).alias("x")).collect() if r.x is None or len(r.x) < 10**5])
    one = model.mixtures(texts, 2.0, 20)
    monkeypatch.setattr(L, "PIECE", 64)
    assert np.abs(model.mixtures(texts, 2.0, 20) - one).max() < 0.05  # the grams over a cut start anew


def test_gram_counts(languages):
    from gristmill.llm import language_mix as L

    rows = [(r.lang, r.x) for r in languages.select("lang", L.letters(F.col("text")).alias("x")).where("lang is not null and x is not null").collect()]
    got = {(r.lang, r.cell): r.n for r in L.counts(languages.select("lang", L.letters(F.col("text")).alias("letters")).where("lang is not null and letters is not null"), 12).collect()}
    assert sum(got.values()) == sum(len(x.encode()) + 1 for _, x in rows)


def test_op11(spark, languages, tmp_path):
    from gristmill.llm import queries

    languages.select("doc_id", "text", "lang").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.queries()["op11_language_mix"](spark, str(tmp_path)).collect()
    crc = lambda i: zlib.crc32(b"" if i is None else str(i).encode())
    assert all(r.held_out == (crc(r.doc_id) % 4 == 2) for r in got) and len(got) == languages.count()
