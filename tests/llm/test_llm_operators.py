"""Each operator against a brute-force version, on rows that hold the odd cases, and on an empty table."""

import bisect
import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(docs):
    return [(r.doc_id, r.text or "", r.source) for r in docs.select("doc_id", "text", "source").collect()]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


# 3
def brute_quality(t):
    w = WORDS.findall(t)
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    c = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    rep = {k for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep)


def test_host_quality(docs, empty):
    from gristmill.llm import host_quality as H

    got = H.judge(docs).select("doc_id", "text", "source", "_quality.*", F.col("quality").alias("own")).collect()
    assert len(got) == docs.count() and {r.own for r in got} == {"own"}
    fails = collections.defaultdict(list)
    for r in got:
        m = brute_quality(r.text or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m
        assert r.base_failed == (m[0] < 20 or 100 * m[4] > 30 * m[0])
        if r.source:
            fails[r.source].append(r.base_failed)
    rates = [np.mean(x) for x in fails.values()]
    mean, var = np.mean(rates), np.var(rates)
    k = max(1, mean * (1 - mean) / var - 1)
    for r in got:
        if r.source:
            assert math.isclose(r.host_rate, (sum(fails[r.source]) + mean * k) / (len(fails[r.source]) + k))
        assert r.kept == (not r.base_failed and not (r.source and r.host_rate > 0.5))
    assert H.judge(empty).count() == 0


def test_bad_host(spark):
    from gristmill.llm import host_quality as H

    good, bad = " ".join(f"w{k}" for k in range(30)), "too short"
    rows = [(k, bad if k % 10 else good, "bad") for k in range(100)] + [(200 + k, good, f"good{k % 5}") for k in range(100)] + [(400, bad, "once")]
    got = H.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"), keep=["doc_id", "source"]).select("source", "quality.*").collect()
    assert not any(r.kept for r in got if r.source == "bad") and all(r.kept for r in got if r.source.startswith("good"))


# 4
def brute_lines(rows, percent=80, least=1):
    first, order = {}, []
    for i, t in sorted(set(rows), key=lambda r: (-1 if r[0] is None else r[0])):
        for n, x in enumerate(t.split("\n")):
            w = WORDS.findall(x.lower())
            if len(w) >= least and x.lower() not in first:
                first[x.lower()] = (i, n)
                order.append((i, n, frozenset(w)))
    gone = set()
    for b, (i, n, w) in enumerate(order):
        for _, _, v in order[:b]:
            c = len(w & v)
            if 100 * c >= percent * (len(w) + len(v) - c):
                gone.add((i, n))
                break
    kept = {p for p in first.values()} - gone
    return {i: "\n".join(x for n, x in enumerate(t.split("\n")) if len(WORDS.findall(x)) < least or (i, n) in kept) for i, t in rows}


def test_line_dedup(docs, empty):
    from gristmill.llm import line_dedup as L

    plain = docs.where("text is null or not (text rlike '[\\\\u0085\\\\u00a0\\\\x1c]')")
    want = brute_lines([(i, t) for i, t, _ in rows_of(plain)])
    got = L.dedup_lines(plain).select("doc_id", "text", "n_removed").collect()
    assert len(got) == plain.count()
    for r in got:
        assert (r.text or "") == want[r.doc_id], r.doc_id
    assert sum(r.n_removed for r in got) > 0
    assert L.dedup_lines(empty).count() == 0


def test_line_variants(spark):
    """Many variants of one line, and a chain in which only neighbours match."""
    from gristmill.llm import line_dedup as L

    base = [f"t{k}" for k in range(20)]
    rows = [(k, " ".join([*base[: k % 20], f"v{k}", *base[k % 20 + 1 :]])) for k in range(120)]
    chain = [f"c{k}" for k in range(40)]
    rows += [(500 + k, " ".join(chain[k : k + 20])) for k in range(0, 20, 2)]
    got = {r.doc_id: r.text for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_lines(rows)


def test_lines_of_shared_ids(spark):
    """Texts of one id, or of none, are documents of their own; equal rows are one."""
    from gristmill.llm import line_dedup as L

    rows = [(None, "alpha beta"), (None, "alpha beta\ndelta eps zeta"), (7, "x y z\nalpha beta"), (7, "q\nx y z"), (7, "x y z\nalpha beta"), (8, "q\nQ\nother line here"), (8, None)]
    got = L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and sum(r.text is None for r in got) == 1
    texts = [(r.doc_id, r.text) for r in got if r.text is not None]
    assert len(set(texts)) <= len(texts) - 1 or any(t == "" for _, t in texts)
    lines = [x for _, t in set(texts) for x in t.split("\n") if x]
    assert sorted(lines) == ["alpha beta", "delta eps zeta", "other line here", "q", "x y z"]
    assert all("alpha beta" not in t for i, t in texts if i is not None) and all("q" not in t.split("\n") for i, t in texts if i == 8)


# 5
def test_write_shards(spark, tmp_path):
    """Repeated ids and rows, and columns called like those that are added: every row is written once."""
    from gristmill.llm import range_shards as S

    rows = [(k % 7 if k % 5 else None, f"text {k % 11} " * (k % 4), k, k % 3) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard long, slot long")
    S.write_shards(docs, f"file://{tmp_path}/out", 4, ranges_per_shard=8)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert collections.Counter(tuple(r) for r in back.select(docs.columns).collect()) == collections.Counter(rows)
    assert {c.lower() for c in back.columns} == {*docs.columns, "_shard", "_slot"}
    got = back.groupBy("_shard").agg(F.count("*").alias("n"), F.countDistinct("_slot").alias("slots"), F.max("_slot").alias("last")).collect()
    assert len(got) == 4 and all(r.n == r.slots == r.last + 1 for r in got)


def test_range_shards(docs, empty):
    from gristmill.llm import range_shards as S

    got = S.assign(docs, 4, ranges_per_shard=8).collect()
    want = sorted(((i is not None, i), len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t, _ in rows_of(docs.fillna({"doc_id": -1})))
    assert sorted(((r.doc_id if r.doc_id is not None else -1), r.size, r.text_crc32) for r in got) == [(i[1], s, c) for i, s, c in want]
    slots = collections.defaultdict(list)
    total = collections.Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        total[r.shard] += r.size
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    biggest = max(r.size for r in got)
    assert max(total.values()) - min(total[k] for k in range(4)) <= 2 * biggest
    assert S.assign(empty).count() == 0


def test_hot_texts(spark):
    from gristmill.llm import range_shards as S

    rows = [(k, "same text " * 20 if k % 3 else f"text {k} " * 20) for k in range(3000)]
    got = S.assign(spark.createDataFrame(rows, "doc_id long, text string"), 8, ranges_per_shard=16).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    assert len(got) == 8 and max(r.b for r in got) - min(r.b for r in got) <= 500


# 6
def test_poisson_mix(docs, empty, spark):
    from gristmill.llm import poisson_mix as M

    out = M.mix(docs, weights={"src0": 0.0, "src1": 1.0, "src2": 1.0, None: 0.5}).select("doc_id", "source").collect()
    assert "src0" not in {r.source for r in out} and len(out) > 20
    assert M.mix(docs, marks=False).columns == docs.columns
    assert M.mix(empty).count() == 0
    many = spark.range(30000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 30 == 1, "c").otherwise("b").alias("source"))
    counts = {r.source: r.n for r in M.mix(many, weights={"a": 2, "b": 1, "c": 1}).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(counts["a"] / 15000 - 1) < 0.05 and abs(counts["b"] / 7500 - 1) < 0.05 and abs(counts["c"] / 7500 - 1) < 0.1
    again = [r.doc_id for r in M.mix(many).select("doc_id").collect()]
    assert again == [r.doc_id for r in M.mix(many.repartition(7)).select("doc_id").collect()]


@pytest.mark.parametrize("rate", [0.3, 12.5, 64.0, 64.5, 720.0, 5000.0, 100000.0])
def test_poisson_mix_rates(spark, rate):
    """Tables against the formula, draws against a loop over the parts of a rate, totals against the mean."""
    from gristmill.llm import poisson_mix as M

    few = spark.createDataFrame([(k, "a") for k in range(8)], "doc_id long, source string")
    found, upto = M.rates(few, "source", None, 0.5, rate).first(), 0.0
    cdf, part = found.cdf, found.rate / found.draws
    assert found.draws == math.ceil(found.rate / M.MOST) and len(cdf) < 200
    for k, c in enumerate(cdf):
        upto += math.exp(k * math.log(part) - part - math.lgamma(k + 1))
        assert abs(c - upto) < 1e-9
    assert cdf[-1] == 1

    def draw(name):
        return bisect.bisect_right(cdf, int(hashlib.md5(name.encode()).hexdigest()[:12], 16) / (1 << 48))

    want = {k: sum(draw(f"17:{k}:{j}" if j else f"17:{k}") for j in range(found.draws)) for k in range(8)}
    got = {r.doc_id: r.n for r in M.mix(few, size=rate).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == {k: n for k, n in want.items() if n} and abs(sum(got.values()) - 8 * rate) < 6 * math.sqrt(8 * rate)


# 7
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(t):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(v - 9 * (v > 9) for i, c in enumerate(reversed(d)) for v in [int(c) * (1 + i % 2)]) % 10 == 0
            if not (kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (14 <= len(d) <= 19 and luhn) or kind == "phone" and not 10 <= len(d) <= 15):
                out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_base_spans(spark, docs):
    import random

    from gristmill.llm import disclosure as D

    r = random.Random(5)
    texts = ["a@b.c_d@e.f x@y a@b@c.d", "1.2.3.4.5.6.7.8 999.1.1.1 01.002.3.255", "4111 1111 1111 1111 4111-1111-1111-1111-", "+1 (555) 123-4567. +12 +1234567890123456"]
    texts += ["".join(r.choice("a1.@-+ 2()é4_\n") for _ in range(r.randint(1, 200))) for _ in range(300)] + ["".join(r.choice("1234 -0") for _ in range(r.randint(1, 60))) for _ in range(300)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", D.listed(D.base_spans(F.col("t"))).alias("s")).collect()
    assert all(x.s == brute_spans(x.t) for x in got)


def test_disclosure(spark, docs, empty):
    from gristmill.llm import disclosure as D

    filler = [f"f{k}" for k in range(50)]
    rows = [(k, f"{' '.join(filler[k % 30 : k % 30 + 15])} the captain xylo writes from {'x' * (k + 1)} boss@ship.org each day the {k}") for k in range(8)]
    rows += [(100 + k, f"the day {' '.join(filler)} the each writes from captain {k}") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = D.find(df, reach=30).collect()
    terms = {rows[r.id][1][t.start : t.end] for r in found if r.id < 8 for t in r.terms}
    assert "xylo" in terms and not terms & {"the", "from", "each"}
    assert not any(r.terms or r.base for r in found if r.id >= 100)
    clean = D.sanitise(df, reach=30).where("doc_id = 1").first().sanitised
    assert "boss@ship.org" not in clean and "[EMAIL]" in clean and "xylo" not in clean
    out = D.sanitise(docs)
    assert out.count() == docs.count() and out.columns[-1] == "_sanitised"
    assert D.find(empty).count() == 0


def brute_disclosure(rows, reach, prior, generalise_at):
    """Terms (id, start, end, disclosure) by loops over (id, text)."""
    import regex

    word = regex.compile(r"[\p{L}\p{N}]+")
    near, counts = [], collections.Counter()
    for i, t in rows:
        counts.update(w.lower() for w in word.findall(t))
        base = [(int(a), k, int(b)) for k, a, b in (x.split(":") for x in brute_spans(t).split(",") if x)]
        for a, kind, b in base:
            match = t[a:b].lower()
            wide = {"email": match.split("@")[-1], "ip": ".".join(match.split(".")[:3])}.get(kind, re.sub("[^0-9]", "", match)[:6])
            for m in word.finditer(t):
                x, y = m.span()
                outside = y <= a and x >= a - reach or x >= b and y <= b + reach
                if outside and not any(c < y and d > x for c, _, d in base):
                    near += [(i, t, entity, m[0].lower(), x, y) for entity in (f"{kind}:{match}", f"group:{kind}:{wide}")]
    both, texts, of_entity = collections.Counter(), collections.defaultdict(set), collections.Counter()
    for _, t, e, w, _, _ in near:
        both[e, w] += 1
        texts[e, w].add(t)
        of_entity[e] += 1
    n, out = sum(counts.values()), {}
    for i, _, e, w, x, y in near:
        k = len(texts[e, w])
        d = (1 - math.log(max(counts[w] / both[e, w], 1)) / math.log(max(n / of_entity[e], 2))) * k / (k + prior)
        if d >= generalise_at:
            out[i, x, y] = max(d, out.get((i, x, y), 0))
    return out


def test_disclosure_formula(spark):
    """Random letters around two entities, names that go with one of them, and copies of a text."""
    import random

    from gristmill.llm import disclosure as D

    g, rows = random.Random(8), []
    for k in range(120):
        body = [g.choice(("ann", "bob", "the", "a", "of", "sea", "été", "x9")) for _ in range(g.randint(3, 30))]
        if k % 3 == 0:
            who, name = g.choice((("boss@ship.org", "Captain"), ("10.0.0.7", "server")))
            at = g.randrange(len(body))
            body[at:at] = [name if g.random() < 0.9 else "who", who]
        rows.append((k, g.choice((" ", ", ", "  ")).join(body)))
    rows += [(200, rows[0][1]), (201, rows[0][1])]
    rows += [(300, "only here quaint@words.org stands rarely"), (301, "all of the others")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for prior in (1, 3):
        got = {}
        for r in D.find(df, reach=25, generalise_at=0.3, prior=prior).collect():
            got |= {(r.id, t.start, t.end): t.disclosure for t in r.terms}
        want = brute_disclosure(rows, 25, prior, 0.3)
        assert set(got) == set(want) and len(want) > 20
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
        assert any(k[0] == 300 for k in want) == (prior == 1)


def test_disclosure_needs_evidence(spark):
    """A word beside an entity of one text stays, however rare; names that go with an entity or its domain in many texts go."""
    import random

    from gristmill.llm import disclosure as D

    lone = spark.createDataFrame([(1, "contact zorblax at a@b.co now please"), (2, "other words are here")], "doc_id long, text string")
    assert {r.sanitised for r in D.sanitise(lone).collect()} == {"contact zorblax at [EMAIL] now please", "other words are here"}

    g, rows = random.Random(3), []
    common = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)]

    def words(n):  # one in five is of this place alone
        return [f"rare{g.randrange(10**9)}" if g.random() < 0.2 else g.choice(common) for _ in range(n)]

    for k in range(600):
        who = k % 60
        body = words(40) + [f"Name{chr(97 + who % 26)}{chr(97 + who // 26)}", f"u{who}@firm{who // 6}.org", f"{70000 + who // 6}"] + words(40)
        rows.append((k, " ".join(body)))
    rows += [(1000 + k, " ".join(words(80))) for k in range(600)]
    found, hit, said = D.find(spark.createDataFrame(rows, "doc_id long, text string")).collect(), 0, 0
    texts = dict(rows)
    for r in found:
        terms = [texts[r.id][t.start : t.end] for t in r.terms]
        said, hit = said + len(terms), hit + sum(t.startswith("Name") or t.startswith("700") for t in terms)
    assert hit / 1200 == 1 and hit / said > 0.95
    clean = D.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 7").first().sanitised
    assert "[NAME] [EMAIL]" in clean and "70001" not in clean
    wider = spark.createDataFrame([("4711",), ("x9",), ("Été",), ("sea",)], "t string").select(D._wider(F.col("t")).alias("t"))
    assert [r.t for r in wider.collect()] == ["4000", "[CODE]", "[NAME]", "[TERM]"]


# 8
def test_pivot_search(spark):
    from gristmill.llm import pivot_search as S

    g = np.random.default_rng(2)
    vectors = [(k, g.normal(size=8).tolist()) for k in range(900)]
    vectors += [(1000 + k, [0.5] * 8) for k in range(700)] + [(2000, None), (2100, []), (2200, [float("nan")] * 8), (2300, [1.0] * 7 + [None]), (2400, [1.0, 2.0]), (2500, [3.0, 1.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("cell", F.lit("own"))
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in S.search(df, lambda i: i % 100 == 0, block_rows=64, pivots=6, annuli=4).collect()}
    x = {i: np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int) for i, v in vectors if i is not None and v and None not in v and np.isfinite(v).all()}
    want = {}
    for q in (i for i in x if i % 100 == 0):
        s = sorted(((-int(x[q] @ x[v]), v) for v in x if v != q and len(x[v]) == len(x[q])))[:10]
        want |= {(q, k + 1): (v, -s_) for k, (s_, v) in enumerate(s)}
    assert got == want
    assert S.search(df.limit(0), lambda i: i % 100 == 0).count() == 0


# 9
def brute_classes(rows, size):
    sets = {}
    for i, t in rows:
        w = WORDS.findall(lower(t))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    ids = sorted(i for i in sets if i is not None)
    label = {i: i for i in ids}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in ids:
        for b in ids:
            c = len(sets[a] & sets[b])
            if a < b and c and 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("size", [4, 5])
def test_superminhash(docs, size):
    from gristmill.llm import superminhash as S

    want = brute_classes([(i, t) for i, t, _ in rows_of(docs)], size)
    got = S.classes(docs, shingle=size).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def test_near_copies(spark, empty):
    """A group whose members are mostly linked through its original alone, and a chain."""
    from gristmill.llm import superminhash as S

    base = [f"b{k}" for k in range(150)]
    rows = [(1, " ".join(base))]
    for k in range(60):
        w = list(base)
        for j in range(1 + k % 8):
            w[(17 * k + 19 * j) % 150] = f"n{k}_{j}"
        rows.append((10 + k, " ".join(w)))
    chain = [f"c{k}" for k in range(400)]
    rows += [(200 + k, " ".join(chain[8 * k : 8 * k + 120])) for k in range(20)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in S.classes(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()}
    assert got == brute_classes(rows, 4)
    assert S.classes(empty).count() == 0


def test_near_copies_without_reference(spark, monkeypatch):
    """Two documents that share two buckets, each of which has another centre that meets them once."""
    from gristmill.llm import superminhash as S

    words = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-1], "new"])), (3, "a b c d e f"), (4, "g h i j k l"), (5, "m n o p q r"), (6, "s t u v w x")]
    bands = {1: [1, 2], 2: [1, 2], 3: [1, 3, 4], 4: [2, 5, 6], 5: [3, 4], 6: [5, 6]}
    signed = [(i, len(t.split()) - 3, i, i, bands[i]) for i, t in rows]
    monkeypatch.setattr(S, "_signed", lambda docs, *_: docs.sparkSession.createDataFrame(signed, "id long, n long, f1 long, f2 long, bands array<long>"))
    got = {r.doc_id: r.component_id for r in S.classes(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}


def test_signatures():
    """Equal registers estimate Jaccard, with less variance than independent hashes."""
    from gristmill.llm import superminhash as S

    g = np.random.default_rng(1)
    errors = []
    for _ in range(60):
        x = g.integers(0, 2**63, 120, dtype=np.uint64)
        h = np.concatenate([np.sort(x[:100]), np.sort(x[20:])])
        r = S.signatures(h, np.array([0, 100, 200]), 128)
        errors.append((r[0] == r[1]).mean() - 80 / 120)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < math.sqrt(80 / 120 * 40 / 120 / 128)
    tiny = S.signatures(np.array([5, 9], np.uint64), np.array([0, 1, 2, 2]), 128)
    assert (tiny[:2] < np.uint64(2**63)).all() and (tiny[2] == np.uint64(2**63)).all()


# 10
def tiktoken_encoding():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(docs, empty):
    from gristmill.llm import byte_bpe as B

    enc = tiktoken_encoding()
    out = B.encode(docs, digests=True)
    got = out.select("doc_id", "text", F.col("ids").alias("own"), "_ids", "_n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert len(got) == docs.count()
    for r in got:
        want = enc.encode_ordinary(r.text or "")
        assert r._ids == want and r._n_tokens == len(want) and r.own == "own"
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    back = B.decode(out.select("text", F.col("_ids").alias("i")), "i").collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back)
    assert B.encode(empty).count() == 0


# 2
def test_range_coder(docs, empty, spark, tmp_path):
    from tokenizers import Tokenizer

    from gristmill.llm import range_coder as C

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    one = docs.dropDuplicates(["doc_id"])
    C.write_ids(one, f"file://{tmp_path}/ids")
    got = C.read_ids(spark, f"file://{tmp_path}/ids").orderBy("start").collect()
    at = 0
    rows = sorted(rows_of(one), key=lambda r: (r[0] is not None, r[0] or 0))
    for r, (i, text, _) in zip(got, rows, strict=True):
        want = t.encode(text, add_special_tokens=False).ids + [1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (i, at, len(want), want)
        assert r.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        at += len(want)
    C.write_ids(empty, f"file://{tmp_path}/none")
    assert C.read_ids(spark, f"file://{tmp_path}/none").count() == 0


def test_coder_round_trip():
    from gristmill.llm import range_coder as C

    g = np.random.default_rng(4)
    for ids in (np.zeros(0, np.int64), np.array([49407]), np.zeros(5000, np.int64), g.integers(0, 49408, 5000), np.tile(g.integers(0, 49408, 300), 20), g.integers(0, 200_000, 3000), np.minimum(49407, g.zipf(1.3, 20000))):
        payload = C.pack(ids)
        assert np.array_equal(C.unpack(payload, len(ids)), ids)
    assert len(payload) < 2 * len(ids)
    for at in (24, 40, len(payload) // 4, len(payload) // 2):
        broken = bytearray(payload)
        broken[at] ^= 4
        with pytest.raises(ValueError):
            C.unpack(bytes(broken), len(ids))


def test_coder_beats_order_0_and_zlib():
    import public_tokenizers
    import pyarrow.compute as pc
    import pyarrow.parquet as pq
    from gristmill.llm import range_coder as C

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        tokens = C._Tokens(f.read())
    texts = pc.fill_null(pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].combine_chunks(), "")
    ids = tokens.encode(texts)[0].astype(np.int64)
    payload = C.pack(ids)
    assert np.array_equal(C.unpack(payload, len(ids)), ids)
    share = np.bincount(ids)[np.unique(ids)] / len(ids)
    assert 8 * len(payload) / len(ids) < 0.95 * -(share * np.log2(share)).sum()
    assert len(payload) < 0.85 * len(zlib.compress(ids.astype("<u2").tobytes(), 6))


def test_coder_takes_little_time():
    """Coding and reading back take some five times the CPU of zlib (an earlier model took over 15), in fewer bits."""
    import time

    import public_tokenizers
    import pyarrow.compute as pc
    import pyarrow.parquet as pq
    from gristmill.llm import range_coder as C

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        tokens = C._Tokens(f.read())
    texts = pc.fill_null(pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].combine_chunks(), "")
    ids, took = tokens.encode(texts)[0].astype(np.int64), []
    for _ in range(3):
        times = [time.process_time()]
        for step in (lambda: zlib.compress(ids.astype("<u2").tobytes(), 6), lambda: C.unpack(C.pack(ids), len(ids))):
            step()
            times.append(time.process_time())
        took.append(np.diff(times))
    plain, coded = np.min(took, axis=0)
    assert coded < 10 * plain
    share = np.bincount(ids)[np.unique(ids)] / len(ids)
    assert 8 * len(C.pack(ids)) / len(ids) < 0.85 * -(share * np.log2(share)).sum()


def test_coder_of_many_ids():
    """Pairs that are too many to count by place, and an id with more followers than its list holds."""
    from gristmill.llm import range_coder as C

    g = np.random.default_rng(8)
    wide = np.zeros(60_000, np.int64)
    wide[1::2] = np.repeat(np.arange(1, 6001), 5)
    for ids in (wide, np.concatenate([wide, g.integers(0, 100_000, 20_000)]), np.repeat(g.integers(0, 50, 400), 30)):
        assert np.array_equal(C.unpack(C.pack(ids), len(ids)), ids)


def test_tokens_of_parts():
    import public_tokenizers
    import pyarrow as pa
    import random
    from gristmill.llm import range_coder as C
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        tokens = C._Tokens(f.read())
    assert tokens.plain is not None
    r = random.Random(3)
    parts = ["The", "the", "don't", "'s", "ß", "É", "été", "e\u0301", "x\u0338", ".", ",", "!?", "...", "1", "22", "\n", "\r\n", "\t", " ", "  ", "\x0b", "\u00a0", "日本", "🎉", "µ", "×", "Ω", "ſ", "İ", "\0", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "Aÿ;", "-", "mail"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(12))) for _ in range(3000)]
    marks = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
    texts += ["".join(r.choice(["mail", "Été", "x", *marks, *marks]) for _ in range(r.randrange(6))) for _ in range(3000)]
    texts += [f"word{m}{n}" for m in marks for n in marks]
    texts.append("a <|endoftext|> b")
    ids, many = tokens.encode(pa.array(texts))
    at = np.cumsum(many)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert 49407 in library.encode(texts[-1], add_special_tokens=False).ids
    for text, a, b in zip(texts, at - many, at):
        assert ids[a:b].tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


# 1
def brute_tree(rows, depth=2, divergence=2.0):
    docs = [(i, WORDS.findall(lower(t)) + [None]) for i, t in rows]
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 5 == 1
    train = [d for i, d in docs if not held(i)]
    c = collections.Counter(w for d in train for w in d)
    n, v = sum(c.values()), len(c)
    after = [None] + [collections.defaultdict(collections.Counter) for _ in range(depth)]
    for d in train:
        q = ["<s>", *d]
        for k in range(1, depth + 1):
            for i in range(k, len(q)):
                after[k][tuple(q[i - k : i])][q[i]] += 1
    kept = set()

    def prob(hist, w, most):
        p = (c[w] + 0.5) / (n + 0.5 * (v + 1))
        for k in range(1, min(most, len(hist)) + 1):
            s = tuple(hist[-k:])
            if s in kept:
                f = after[k][s]
                p = (f[w] + len(f) * p) / (sum(f.values()) + len(f))
        return p

    for k in range(1, depth + 1):
        new = set()
        for s, f in after[k].items():
            m = sum(f.values())
            if m >= 2:
                gain = 0
                for w, x in f.items():
                    p = 2 ** (-min(255, round(-8 * math.log2(prob(list(s), w, k - 1)))) / 8)
                    rest = len(f) - (x == 1)
                    gain += x * math.log(max((x - 1 + rest * p) / (m - 1 + rest), 1e-300) / p)
                if gain >= divergence:
                    new.add(s)
        kept |= new
    for i, d in docs:
        q = ["<s>", *d]
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in d)
        yield i, held(i), len(d), sum(c[w] > 0 for w in d), n, base, sum(math.log10(prob(q[max(0, j - depth) : j], q[j], depth)) for j in range(1, len(q)))


def test_suffix_tree(docs, empty):
    from gristmill.llm import suffix_tree as T

    key = lambda r: (r[0] is not None, r[0] or 0, r[2])
    want = sorted(brute_tree([(i, t) for i, t, _ in rows_of(docs)]), key=key)
    got = sorted((tuple(r) for r in T.score(docs, slice_bytes=4000, part_bytes=4000).collect()), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5]
        assert math.isclose(a[5], b[5], rel_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-6)
    assert sum(r[6] for r in got if r[1]) > sum(r[5] for r in got if r[1])  # held out, it tells more than single words
    assert T.score(empty).count() == 0


# The thin queries that SQL cannot express, on the smallest tables
SF = "/root/testdata/sf0.001"


def query_rows(spark, name):
    import pyarrow.parquet as pq

    import __spark_entry__ as entry

    docs = [(r["doc_id"], r["text"] or "") for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    return docs, {r.doc_id: r for r in entry.queries()[name](spark, SF).collect()}


def test_op1_rows(spark):
    docs, got = query_rows(spark, "op1_suffix_tree")
    tokens = {i: [*WORDS.findall(lower(t)), None] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in docs}
    c = collections.Counter(w for i, _ in docs if not held[i] for w in tokens[i])
    n = sum(c.values())
    assert set(got) == set(tokens)
    for i, r in got.items():
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (len(c) + 1))) for w in tokens[i])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(tokens[i]), sum(c[w] > 0 for w in tokens[i]), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score <= 0


def test_op2_rows(spark):
    from tokenizers import Tokenizer

    docs, got = query_rows(spark, "op2_range_coder")
    tokenizer, start = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0
    for i, t in sorted(docs):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(got) == len(docs)


def test_op5_rows(spark):
    docs, got = query_rows(spark, "op5_range_shards")
    size, slots = collections.Counter(), collections.defaultdict(set)
    for i, t in docs:
        r = got[i]
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t.encode()) + 1, zlib.crc32(t.encode()), "bytes", None)
        size[r.shard] += r.size
        slots[r.shard].add(r.slot)
    assert sum(map(len, slots.values())) == len(docs) and all(x == set(range(len(x))) for x in slots.values())
    assert set(size) == set(range(16)) and max(size.values()) - min(size.values()) <= 2 * max(len(t.encode()) + 1 for _, t in docs)


def test_op7_rows(spark):
    docs, got = query_rows(spark, "op7_disclosure")
    for i, t in docs:
        text, r = brute_spans(t), got[i]
        spans = [x for x in text.split(",") if x]
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(f"{k}:") for x in spans) for k in PATTERNS]
        found = [x for x in r.spans.split(",") if x]
        assert set(spans) <= set(found) and r.n_spans == len(found)


def test_op10_rows(spark):
    docs, got = query_rows(spark, "op10_byte_bpe")
    enc = tiktoken_encoding()
    for i, t in docs:
        ids = enc.encode_ordinary(t)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_line_dedup_leaves_little(spark, docs, monkeypatch):
    """Postings are exchanged in parts and tables go when no later step reads them; the number of parts changes nothing."""
    from gristmill.llm import line_dedup as L
    from gristmill.llm._stage import Scratch

    made, of = [], {}

    class Watched(Scratch):
        def keep(self, df, name="t"):
            made.append((name, super().keep(df, name)))
            return made[-1][1]

        def drop(self, df):
            made[:] = [(n, d) for n, d in made if d is not df]
            super().drop(df)

    monkeypatch.setattr(L, "Scratch", Watched)
    for parts in (1, 2, 3):
        made.clear()
        monkeypatch.setattr(L, "_PARTS", parts)
        of[parts] = sorted((r.doc_id or 0, r.text or "", r.n_removed) for r in L.dedup_lines(docs.select("doc_id", "text")).collect())
        left = {n for n, _ in made}
        assert not left & {"lines", "posts", "flagged", "pairs", "wanted", "sets"}
    assert of[1] == of[2] == of[3] and any(n for *_, n in of[1])
    words = L._postings(docs.selectExpr("doc_id AS id", "0L AS v", "doc_id AS lid", "text AS t"), F.array(F.lit(0)), 80)
    assert words._jdf.queryExecution().executedPlan().toString().split("\n\n")[0].count("Window") == 1


def test_line_dedup_moves_texts_once(spark, docs, monkeypatch):
    """Texts are not exchanged again for a few wanted lines, and where they are, the result is the same."""
    from gristmill.llm import line_dedup as L

    source = docs.selectExpr("doc_id AS id", "0L AS v", "text AS body")
    wanted = docs.where("doc_id in (10, 11)").selectExpr("doc_id AS id", "0L AS v", "0 AS line", "doc_id AS lid")
    plan = L._lines(source, wanted)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    of = {}
    for most in (L._NEAR, 0):
        monkeypatch.setattr(L, "_NEAR", most)
        of[most] = sorted((r.doc_id or 0, r.text or "", r.n_removed) for r in L.dedup_lines(docs.select("doc_id", "text")).collect())
    first, second = of.values()
    assert first == second and any(n for *_, n in first)


def test_line_grams_are_selective(spark):
    """Lines that share one rare word and differ else have no posting in common, and lines that match always have: a
    fifth of the words is taken out of a line, or put in, wherever it is in the order of rarity."""
    import random

    from gristmill.llm import line_dedup as L

    rnd = random.Random(11)
    lines = [["seldomseenword", *(f"w{rnd.randrange(10**6)}" for _ in range(29))] for _ in range(40)]
    held = lambda x: spark.createDataFrame([(k, 0, k, " ".join(w)) for k, w in enumerate(x)], "id long, v long, lid long, t string")
    ranks = F.split(F.lit(",".join(["0"] * (1 << 16))), ",").cast("array<int>")
    assert L._postings(held(lines), ranks, 80).count() == 0
    pairs = []
    for n in (1, 2, 4, 5, 9, 10, 13, 25, 40) * 6:
        line = [f"x{rnd.randrange(10**9)}" for _ in range(n)]
        pairs += [line, rnd.sample(line, n - n // 5)]
        line = [f"y{rnd.randrange(10**9)}" for _ in range(n)]
        pairs += [line, line + [f"z{rnd.randrange(10**9)}" for _ in range(n // 4)]]
    met = {r.lid for r in L._postings(held(pairs), ranks, 80).where("other = lid - 1").collect()}
    assert met == set(range(1, len(pairs), 2))


def test_byte_bpe_keeps_little():
    """A worker's tables hold the result of a word once, also where it is a unit of its own, and texts come in small parts."""
    import sys

    import pyarrow as pa

    from gristmill.llm import byte_bpe as B

    texts = [" ".join(f"{chr(97 + k % 26)}x{k}y" + "," * (k % 10 == 0) for k in range(a, a + 1000)) for a in range(0, 20_000, 1000)]
    codec = B.Codec(*B._read(None, None))
    ids, at, body, body_at = codec.encode(pa.array(texts))
    enc = tiktoken_encoding()
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == enc.encode_ordinary(t) and body[body_at[k] : body_at[k + 1]].tobytes() == t.encode()
    held = {}
    for table in (codec.words.new, codec.units.new):
        for key, value in table.items():
            held |= {id(x): x for x in (key, value, *(value if isinstance(value, tuple) else ()))}
    assert sum(map(sys.getsizeof, held.values())) < 220 * len(codec.units.new)
    codec.rest()
    batch = pa.RecordBatch.from_pydict({"body": ["x" * 9_000] * 1_000})
    parts = [p.nbytes for p in B._parts(batch, "body")]
    assert sum(parts) >= 9_000_000 and max(parts) < 1_200_000


def test_line_dedup_makes_no_pairs(spark, monkeypatch):
    """Lines of one family that the first comparisons leave: no step has a row for each pair of them, and every match is found,
    also one that is neither a gram's earliest line nor the one before."""
    from gristmill.llm import line_dedup as L
    from gristmill.llm._stage import Scratch

    # Three families in turn that share the words of the prefix and no others: a third document makes those frequent.
    shared, own = [f"shared{k}" for k in range(12)], [[f"family{j}x{k}" for k in range(15)] for j in range(3)]
    rows = [(k, " ".join([*shared, *own[k % 3], f"own{k}"])) for k in range(300)]
    rows.append((999, " ".join([w for x in own for w in x] * 1000)))
    made = []

    class Watched(Scratch):
        def keep(self, df, name="t"):
            made.append((name, df := super().keep(df, name)))
            made[-1] = (name, df.count())
            return df

    monkeypatch.setattr(L, "Scratch", Watched)
    got = {r.doc_id: r.text for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_lines(rows)
    assert max(n for _, n in made) <= 15 * len(rows)
    assert dict(made)["hits"] > 0
