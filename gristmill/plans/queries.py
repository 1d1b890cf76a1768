"""Registered queries: each operator over the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import diagnostics as D
from ..functions import quality as Q
from ..functions import tokens as T
from ..functions import urls as U
from ..functions import versions as V
from ..operators import graphs as G
from ..operators import manifests as H
from ..operators import matching as M
from ..operators import relations as R
from ..operators import scoring as S
from ..operators import tags as TG
from ..sources.known_index import index_of
from ..sources.session import kept
from ..sources.tables import cache_file, fresh_entries, list_argument, table
from .registry import ORACLES, QUERIES, query  # noqa: F401

def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.plain(F.col("text")).alias("words"))


def _known(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.plain(F.col("text")).alias("words"))


# Text matching.
_SIM = r"""
dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS w FROM documents),
kw AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS w FROM benchmark),
df AS (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, unnest(w) AS t FROM dw) GROUP BY ALL),
kf AS (SELECT item_id, t, count(*) AS n FROM (SELECT item_id, unnest(w) AS t FROM kw) GROUP BY ALL),
kn AS (SELECT item_id, count(*) AS k FROM kf GROUP BY 1),
sim AS (SELECT doc_id, item_id, count(*) / k AS similarity FROM df JOIN kf ON df.t = kf.t AND df.n >= kf.n JOIN kn USING (item_id) GROUP BY doc_id, item_id, k HAVING count(*) / k >= 0.75)
"""
_GRAM = (
    _SIM
    + r""",
dg AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 10], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, len(w) - 9)) AS i FROM dw WHERE len(w) > 10)),
kg AS (SELECT item_id, i AS si, array_to_string(w[i + 1:i + 10], ' ') AS g FROM (SELECT item_id, w, unnest(range(0, len(w) - 9)) AS i FROM kw WHERE len(w) > 10)),
hit AS (SELECT doc_id, item_id, i, si FROM dg JOIN kg USING (g) JOIN sim USING (doc_id, item_id)),
isl AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, i - si ORDER BY i) AS isl FROM hit),
run AS (SELECT doc_id, item_id, min(i) AS start, max(i) + 10 AS "end", min(si) AS src_start, max(si) + 10 AS src_end FROM isl GROUP BY doc_id, item_id, i - si, isl)
"""
)


@query(r"SELECT t AS token, count(*) AS docs, sum(n)::BIGINT AS n FROM (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS t FROM documents) GROUP BY ALL) GROUP BY 1")
def token_frequency(spark, sf_dir):
    return M.frequency(_docs(spark, sf_dir), "doc_id").groupBy("token").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n"))


@query("WITH " + _SIM + "SELECT doc_id, item_id, round(similarity, 9) AS similarity FROM sim")
def token_similarity(spark, sf_dir):
    found = M.similar(_docs(spark, sf_dir), _known(spark, sf_dir), "doc_id", "item_id")
    return found.select("doc_id", "item_id", F.round("similarity", 9).alias("similarity"))


def _pairs(spark, sf_dir):
    """Words and pairs, written once, as each is read by several joins."""
    docs, known = kept(_docs(spark, sf_dir)), kept(_known(spark, sf_dir))
    return docs, known, kept(M.similar(docs, known, "doc_id", "item_id"))


def _runs(spark, sf_dir):
    docs, known, pairs = _pairs(spark, sf_dir)
    return docs, known, kept(M.diagonal_runs(M.gram_hits(docs, known, pairs, "doc_id", "item_id", 10), "doc_id", "item_id"))


def _sizes(docs, known, runs):
    a = docs.select("doc_id", F.size("words").alias("in_n"))
    b = known.select("item_id", F.size("words").alias("known_n"))
    return runs.select("doc_id", "item_id").distinct().join(a, "doc_id").join(b, "item_id")


@query("WITH " + _GRAM + "SELECT doc_id, item_id, count(*) AS hits FROM hit GROUP BY ALL")
def ngram_join(spark, sf_dir):
    docs, known, pairs = _pairs(spark, sf_dir)
    return M.gram_hits(docs, known, pairs, "doc_id", "item_id", 10).groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("hits"))


@query("WITH " + _GRAM + 'SELECT doc_id, item_id, start::INT AS start, "end"::INT AS "end", src_start::INT AS src_start, src_end::INT AS src_end, ("end" - start)::INT AS claimed FROM run')
def diagonal_runs(spark, sf_dir):
    return _runs(spark, sf_dir)[2]


@query(
    "WITH "
    + _GRAM
    + r""",
sz AS (SELECT DISTINCT doc_id, item_id, len(dw.w) AS n, least(len(dw.w), len(kw.w)) AS l FROM run JOIN dw USING (doc_id) JOIN kw USING (item_id)),
cov AS (SELECT DISTINCT doc_id, item_id, unnest(range(start, "end")) AS x FROM run),
pos AS (SELECT doc_id, item_id, n, l, floor(l * 0.9)::INT AS need, unnest(range(0, n)) AS x FROM sz),
win AS (SELECT p.doc_id, p.item_id, p.x, any_value(n) AS n FROM pos p JOIN cov c ON c.doc_id = p.doc_id AND c.item_id = p.item_id AND c.x >= p.x AND c.x < p.x + l GROUP BY p.doc_id, p.item_id, p.x, need HAVING count(*) >= need),
wi AS (SELECT *, x - row_number() OVER (PARTITION BY doc_id, item_id ORDER BY x) AS isl FROM win)
SELECT doc_id, item_id, min(x)::INT AS start, least(max(x) + 10, any_value(n))::INT AS "end" FROM wi GROUP BY doc_id, item_id, isl"""
)
def density_windows(spark, sf_dir):
    docs, known, runs = _runs(spark, sf_dir)
    return M.dense_windows(runs, _sizes(docs, known, runs), "doc_id", "item_id", 0.9, 10)


@query(
    "WITH "
    + _GRAM
    + r""",
ev AS (SELECT doc_id, start, "end" FROM run UNION ALL SELECT doc_id, len(w), len(w) FROM dw WHERE doc_id IN (SELECT doc_id FROM run)),
gp AS (SELECT doc_id, start - coalesce(max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gap FROM ev)
SELECT doc_id, greatest(0, max(gap))::INT AS longest_gap FROM gp GROUP BY 1"""
)
def longest_gap(spark, sf_dir):
    docs, _, runs = _runs(spark, sf_dir)
    sizes = docs.join(runs.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.size("words").alias("n"))
    return M.longest_gap(runs, sizes, "doc_id", "n")


@query()
def fused_claims(spark, sf_dir):
    docs, known, runs = _runs(spark, sf_dir)
    sizes = _sizes(docs, known, runs)
    return M.claims(runs, M.dense_windows(runs, sizes, "doc_id", "item_id", 0.9, 10), sizes, "doc_id", "item_id", 0.9)


@query()
def detected_texts(spark, sf_dir):
    from .detect import detect

    known = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("content"), "_metadata")
    return detect(table(spark, sf_dir, "documents"), index_of(known, T.granularity(0.9)), "doc_id", "text", threshold=0.9)


@query("SELECT l_partkey, l_suppkey AS known, max(l_discount) AS confidence, min(l_linenumber)::INT AS start, max(l_linenumber + l_quantity::INT)::INT AS \"end\", count(*) AS n FROM lineitem GROUP BY ALL")
def widened_matches(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_suppkey").alias("known"), F.col("l_discount").alias("confidence"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + F.col("l_quantity").cast("int")).alias("end"), F.lit(3).alias("claimed"), F.lit(9).alias("known_n"), F.struct("l_orderkey", "l_linenumber").alias("ord"))
    n = m.groupBy("l_partkey", "known").agg(F.count(F.lit(1)).alias("n"))
    return M.best_of_each(m, "l_partkey", "known").join(n, ["l_partkey", "known"]).select("l_partkey", "known", "confidence", "start", "end", "n")


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_quantity / 50 DESC, l_linenumber)::INT AS rank FROM lineitem")
def ranked_matches(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("confidence"), F.col("l_quantity").alias("claimed"), F.lit(50).alias("known_n"))
    return M.ranked(m, "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "rank")


@query("SELECT l_orderkey, round(greatest(0.0, (200 - sum(l_quantity)) / 200), 9) AS unclaimed FROM lineitem GROUP BY 1")
def unclaimed_share(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").alias("claimed"))
    sizes = m.select("l_orderkey").distinct().withColumn("n", F.lit(200))
    return M.unclaimed(m, sizes, "l_orderkey", "n").select("l_orderkey", F.round("unclaimed", 9).alias("unclaimed"))


# Texts and links.
@query(r"""SELECT doc_id, round(CASE WHEN s > 0 THEN h / s ELSE 0 END, 9) AS ratio FROM (SELECT doc_id, length(regexp_replace(coalesce(text, ''), '[\x00-\x20]', '', 'g')) AS s, length(regexp_replace(coalesce(text, ''), '[\x00-\x7F]', '', 'g')) AS h FROM documents)""")
def non_ascii_ratio(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.round(Q.non_ascii_ratio(F.coalesce("text", F.lit(""))), 9).alias("ratio"))


@query(r"""SELECT item_id, CASE WHEN n = 0 THEN 'empty' WHEN n < 50 THEN 'short' WHEN n > 180 THEN 'long' WHEN h > 0.1 * s THEN 'non-ascii' ELSE 'ok' END AS kind FROM (SELECT item_id, length(trim(coalesce(text, ''))) AS n, length(regexp_replace(text, '[\x00-\x20]', '', 'g')) AS s, length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) AS h FROM benchmark)""")
def description_length(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", Q.description_class(F.col("text")).alias("kind"))


_LINKS = r"""lk AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1)) AS url FROM pages UNION ALL SELECT page_id, url FROM pages),
sc AS (SELECT page_id, url, regexp_matches(url, '[\s<>"{}|\\^`]') OR regexp_matches(url, '^[0-9][A-Za-z0-9+.-]*:') OR regexp_matches(url, '^:') AS bad, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme FROM lk)"""


def _links(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    anchors = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1))).alias("url"))
    return anchors.unionByName(pages.select("page_id", "url"))


@query("WITH " + _LINKS + "SELECT page_id, CASE WHEN bad THEN 'unparsed' WHEN scheme NOT IN ('', 'https', 'mailto') THEN 'insecure' ELSE 'secure' END AS kind, count(*) AS n FROM sc GROUP BY ALL")
def link_classes(spark, sf_dir):
    return _links(spark, sf_dir).select("page_id", Q.link_class(F.col("url")).alias("kind")).groupBy("page_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("WITH " + _LINKS + "SELECT page_id, url, CASE WHEN bad OR scheme NOT IN ('http', 'https') THEN 'invalid' WHEN scheme <> 'https' THEN 'insecure' WHEN page_id % 3 = 0 THEN 'missing' END AS problem, count(*) AS n FROM sc GROUP BY ALL")
def url_problems(spark, sf_dir):
    found = _links(spark, sf_dir).select("page_id", "url", Q.url_status(F.col("url"), F.col("page_id") % 3 != 0).alias("problem"))
    return found.groupBy("page_id", "url", "problem").agg(F.count(F.lit(1)).alias("n"))


@query("WITH " + _LINKS + "SELECT page_id, url, CASE WHEN bad OR scheme NOT IN ('http', 'https') THEN 'rejected: invalid' WHEN page_id % 3 = 0 THEN 'accepted: missing' WHEN scheme = 'http' THEN 'rejected: insecure' ELSE 'ok' END AS verdict FROM sc WHERE url IN (SELECT url FROM pages)")
def link_verdicts(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    both = _links(spark, sf_dir).join(p.select("url").distinct(), "url", "left_semi")
    return both.select("page_id", "url", Q.link_verdict(F.col("url"), F.col("page_id") % 3 != 0).alias("verdict"))


#: Addresses of each form; {} is a number.
_REPOSITORIES = (
    ("https://github.com/o{}/r.git", "github", "github.com", "o{}/r", None, None),
    ("http://www.github.com/o{}/r/tree/main/pkg/x?a=1#z", "github", "github.com", "o{}/r", "main", "pkg/x"),
    ("https://gitlab.com/o{}/r/-/blob/dev/x.md", "gitlab", "gitlab.com", "o{}/r", "dev", "x.md"),
    ("https://git.example.com/a/o{}/r.git/sub", "unknown", "git.example.com", "a/o{}/r", None, "sub"),
    ("https://github.com/o{}/../r", None, None, None, None, None),
    ("ftp://github.com/o{}/r", None, None, None, None, None),
    ("https://github.com/o{}", None, None, None, None, None),
)
_REPOSITORY_ROWS = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in r) + ")" for r in _REPOSITORIES)


@query(
    f"SELECT page_id, replace(u, '{{}}', page_id::VARCHAR) AS url, p AS provider, h AS host, replace(r, '{{}}', page_id::VARCHAR) AS repository, b AS branch, t AS path, 'https://' || h || '/' || replace(r, '{{}}', page_id::VARCHAR) AS clone FROM pages, (VALUES {_REPOSITORY_ROWS}) v(u, p, h, r, b, t)"
    r" UNION ALL SELECT page_id, url, CASE WHEN ok THEN 'unknown' END, CASE WHEN ok THEN host END, CASE WHEN ok THEN s[1] || '/' || s[2] END, NULL, CASE WHEN ok AND len(s) > 2 THEN array_to_string(s[3:], '/') END, CASE WHEN ok THEN 'https://' || host || '/' || s[1] || '/' || s[2] END"
    r" FROM (SELECT *, len(s) >= 2 AS ok FROM (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, list_filter(string_split(regexp_extract(url, '^https?://[^/?#]+/([^?#]*)', 1), '/'), lambda x: x <> '') AS s FROM pages))"
)
def repository_urls(spark, sf_dir):
    """Every page's address, and addresses of every form of a repository."""
    p = table(spark, sf_dir, "pages")
    made = p.select("page_id", F.explode(F.array(*[F.replace(F.lit(u), F.lit("{}"), F.col("page_id").cast("string")) for u, *_ in _REPOSITORIES])).alias("url"))
    r = made.unionByName(p.select("page_id", "url")).select("page_id", "url", U.repository(F.col("url")).alias("r"))
    return r.select("page_id", "url", "r.provider", "r.host", "r.repository", "r.branch", "r.path", U.clone_url(F.col("r")).alias("clone"))


@query("WITH " + _LINKS + r"SELECT page_id, url, CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:') OR url LIKE '#%' THEN url ELSE 'https://github.com/a/b/' || CASE WHEN regexp_matches(lower(url), '\.(png|jpe?g|gif|svg|webp|bmp|ico)$') THEN 'raw' ELSE 'blob' END || '/main' || CASE WHEN url LIKE '/%' THEN url ELSE '/pkg/' || url END END AS target FROM sc")
def resolved_links(spark, sf_dir):
    links = _links(spark, sf_dir)
    return links.select("page_id", "url", U.resolved(F.lit("https://github.com/a/b/tree/main/pkg"), F.col("url"), F.lit("README.md")).alias("target"))


@query()
def exact_tokens(spark, sf_dir):
    t = T.tokenised(table(spark, sf_dir, "benchmark").select("item_id", "text"), "text")
    return t.select("item_id", F.posexplode("tokens").alias("pos", "t")).select("item_id", "pos", "t.value", "t.start", "t.end")


# Diagnostics.
_LINE = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'WARNING' WHEN 'view' THEN 'INFO' ELSE 'HINT' END"


def _lines(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    severity = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "click", "WARNING").when(F.col("event_type") == "view", "INFO").otherwise("HINT")
    return e.select(F.concat_ws("|", severity, F.upper("event_type"), F.lit("CODE"), F.concat(F.lit("lib/f"), F.col("user_id") % 7, F.lit(".dart")), (F.col("user_id") % 50).cast("string"), (F.col("event_id") % 3).cast("string"), (F.col("event_id") % 5).cast("string"), F.concat(F.lit("text "), F.col("user_id") % 2)).alias("line"))


_PROBLEMS = f"SELECT {_LINE} AS severity, upper(event_type) AS error_type, 'CODE' AS error_code, 'lib/f' || (user_id % 7) || '.dart' AS file, (user_id % 50)::INT AS line, (event_id % 3)::INT AS col, 'text ' || (user_id % 2) AS description, min(event_id % 5)::INT AS length FROM events GROUP BY ALL"


@query(_PROBLEMS)
def problem_parse(spark, sf_dir):
    return D.problems(_lines(spark, sf_dir))


@query(f"SELECT *, row_number() OVER (ORDER BY CASE severity WHEN 'ERROR' THEN 0 WHEN 'WARNING' THEN 1 WHEN 'INFO' THEN 2 ELSE 3 END, severity, error_type, error_code, file, line, col, description)::INT AS rank FROM ({_PROBLEMS})")
def problem_order(spark, sf_dir):
    return D.ordered(D.problems(_lines(spark, sf_dir)))


@query(f"SELECT file, CASE WHEN e > 0 THEN 0 WHEN w > 0 THEN 30 WHEN o > 0 THEN 40 ELSE 50 END AS granted, 50 AS max, CASE WHEN e = 0 AND w = 0 AND o > 0 THEN 'partial' WHEN e = 0 AND w = 0 THEN 'passed' ELSE 'failed' END AS status FROM (SELECT file, count(*) FILTER (severity = 'ERROR') AS e, count(*) FILTER (severity = 'WARNING') AS w, count(*) FILTER (severity NOT IN ('ERROR', 'WARNING')) AS o FROM ({_PROBLEMS}) GROUP BY 1)")
def static_score(spark, sf_dir):
    p = D.problems(_lines(spark, sf_dir))
    s = F.col("severity")
    by = p.groupBy("file").agg(F.count_if(s == "ERROR").alias("e"), F.count_if(s == "WARNING").alias("w"), F.count_if(~s.isin("ERROR", "WARNING")).alias("o"))
    return by.select("file", S.static_analysis(F.col("e"), F.col("w"), F.col("o")).alias("s")).select("file", "s.*")


@query("WITH l AS (SELECT user_id, event_id, event_type, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS seen FROM events) SELECT user_id, event_id, event_type FROM l WHERE seen <= 2")
def top_issues(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return R.first_issues(e, "user_id", "event_id", F.col("event_type") == "error", 2)


@query("SELECT user_id, event_id, event_type = 'click' AND sum((event_type = 'click')::INT) OVER (PARTITION BY user_id ORDER BY event_id) <= 3 AS accepted FROM events")
def capped_successes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return R.capped_successes(e, "user_id", "event_id", F.col("event_type") == "click", 3).select("user_id", "event_id", "accepted")


@query("WITH h AS (SELECT user_id, event_id, event_type, sum((event_type = 'view')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS entry FROM events) SELECT user_id, entry::BIGINT AS entry, count(*) AS n FROM h WHERE entry > 0 AND event_type IN ('view', 'click') GROUP BY ALL")
def log_entries(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    line = F.when(F.col("event_type") == "view", "FINE: x").when(F.col("event_type") == "click", "    | more").otherwise("noise")
    found = D.log_entries(e.select("user_id", "event_id", line.alias("line")), "user_id", "event_id")
    return found.select("user_id", "entry", F.size("content").cast("long").alias("n"))


# Scores.
_SUBS = "SELECT o_custkey, o_orderpriority AS section, (o_orderkey % 11)::INT AS granted, 10 AS max, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'P' THEN 'partial' ELSE 'passed' END AS status FROM orders"


def _subsections(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "partial").otherwise("passed")
    return o.select("o_custkey", F.col("o_orderpriority").alias("section"), (F.col("o_orderkey") % 11).cast("int").alias("granted"), F.lit(10).alias("max"), status.alias("status"))


_SECTIONS = f"SELECT o_custkey, section, sum(granted)::BIGINT AS granted, sum(max)::BIGINT AS max, ['failed', 'partial', 'passed'][min(CASE status WHEN 'failed' THEN 1 WHEN 'partial' THEN 2 ELSE 3 END)] AS status FROM ({_SUBS}) GROUP BY ALL"


@query(_SECTIONS)
def section_score(spark, sf_dir):
    return S.sections(_subsections(spark, sf_dir), ["o_custkey", "section"])


@query(f"SELECT o_custkey, sum(granted)::BIGINT AS granted, sum(max)::BIGINT AS max, CASE WHEN sum(max) - sum(granted) >= 50 THEN 127 ELSE 0 END AS code FROM ({_SECTIONS}) GROUP BY 1")
def report_total(spark, sf_dir):
    t = S.totals(S.sections(_subsections(spark, sf_dir), ["o_custkey", "section"]), "o_custkey")
    return t.withColumn("code", S.exit_code(t, 50))


@query("SELECT s_suppkey, CASE WHEN n = 0 THEN 0 WHEN web AND NOT wasm OR old THEN 10 ELSE 20 END AS granted, 20 AS max, CASE WHEN n = 0 THEN 'failed' WHEN web AND NOT wasm OR old THEN 'partial' ELSE 'passed' END AS status FROM (SELECT s_suppkey, s_nationkey % 4 AS n, s_suppkey % 2 = 0 AS web, s_suppkey % 3 = 0 AS wasm, s_acctbal < 0 AS old FROM supplier)")
def platform_score(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    points = S.platforms(F.col("s_nationkey") % 4, F.col("s_suppkey") % 2 == 0, F.col("s_suppkey") % 3 == 0, F.col("s_acctbal") < 0)
    return s.select("s_suppkey", points.alias("p")).select("s_suppkey", "p.*")


# Coverage and comparison.
@query(
    "WITH k AS (SELECT d.source, d.doc_id, l.doc_id IS NOT NULL AS has FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id),"
    " m AS (SELECT source, list(doc_id ORDER BY doc_id)[:5] AS missing FROM k WHERE NOT has GROUP BY 1)"
    " SELECT source, count(*) AS total, count(*) FILTER (has) AS documented, array_to_string(any_value(missing), ',') AS missing, round(count(*) FILTER (has) / count(*), 9) AS ratio, CASE WHEN count(*) FILTER (has) / count(*) >= 0.2 THEN 10 ELSE 0 END AS points FROM k LEFT JOIN m USING (source) GROUP BY 1"
)
def doc_coverage(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "doc_id")
    c = R.coverage(d, table(spark, sf_dir, "labels"), "source", "doc_id", "doc_id")
    return c.withColumns({"missing": F.array_join(F.col("missing").cast("array<string>"), ","), "ratio": F.round("ratio", 9)})


@query("SELECT n.n_name AS name, r.r_name AS parent FROM nation n LEFT JOIN region r ON r.r_regionkey = n.n_regionkey")
def enclosing_names(spark, sf_dir):
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("ord"), F.col("r_name").alias("name"), F.concat(F.lit("r"), "r_regionkey").alias("href"), F.lit(None).cast("string").alias("parent_href"))
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).alias("ord"), F.col("n_name").alias("name"), F.concat(F.lit("n"), "n_nationkey").alias("href"), F.concat(F.lit("r"), "n_regionkey").alias("parent_href"))
    return R.with_parents(r.unionByName(n)).where(F.col("ord") >= 100).select("name", "parent")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AND c_nationkey IN (SELECT s_nationkey FROM supplier)")
def undocumented_members(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("c_nationkey")).distinct()
    return R.undocumented(c, o, "c_custkey").join(s, "c_nationkey", "left_semi").select("c_custkey")


_DELTA = "WITH b AS (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-06-01' GROUP BY 1), a AS (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-06-01' GROUP BY 1) "


def _deltas(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    cut = F.lit("1998-06-01").cast("timestamp_ntz")
    by = lambda df: df.groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"))
    return R.deltas(by(l.where(F.col("l_shipdate").cast("timestamp_ntz") < cut)), by(l.where(F.col("l_shipdate").cast("timestamp_ntz") >= cut)), "l_partkey", "q")


@query(_DELTA + "SELECT l_partkey, a.q - b.q AS delta FROM a JOIN b USING (l_partkey)")
def score_deltas(spark, sf_dir):
    return _deltas(spark, sf_dir)


@query(_DELTA + "SELECT count(*) FILTER (a.q = b.q) AS unchanged, count(*) FILTER (a.q > b.q) AS increased, count(*) FILTER (a.q < b.q) AS decreased FROM a JOIN b USING (l_partkey)")
def batch_compare(spark, sf_dir):
    return R.buckets(_deltas(spark, sf_dir), "l_partkey")


@query("SELECT l_orderkey, array_to_string(list_concat(list_transform(list_filter(a, lambda x: NOT list_contains(b, x)), lambda x: '-' || x), list_transform(list_filter(b, lambda x: NOT list_contains(a, x)), lambda x: '+' || x)), ' ') AS diff FROM (SELECT l_orderkey, list(x ORDER BY l_linenumber, x) AS a, list(y ORDER BY l_linenumber, y) AS b FROM (SELECT l_orderkey, l_linenumber, l_returnflag || (l_partkey % 3) AS x, l_returnflag || (l_suppkey % 3) AS y FROM lineitem) GROUP BY 1)")
def id_diff(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat("l_returnflag", F.col("l_partkey") % 3).alias("x"), F.concat("l_returnflag", F.col("l_suppkey") % 3).alias("y"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", c))), lambda s: s[c])
    by = l.groupBy("l_orderkey").agg(ordered("x").alias("a"), ordered("y").alias("b"))
    return by.select("l_orderkey", F.array_join(R.marked_diff(F.col("a"), F.col("b")), " ").alias("diff"))


@query("WITH c AS (SELECT o_custkey, o_orderpriority AS change, o_orderkey FROM orders) SELECT change, count(*) AS n, array_to_string(list(o_orderkey ORDER BY o_orderkey)[:5], ',') AS members FROM c GROUP BY 1")
def frequent_changes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("change"), "o_orderkey")
    return R.frequent_changes(o, "o_orderkey", "change").withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


@query("SELECT DISTINCT l_partkey AS key FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def common_keys(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "key")
    return R.symbol_changes(l.where("l_returnflag = 'R'"), l.where("l_returnflag = 'A'"), "key")


@query("SELECT c_custkey, array_to_string(list_sort(list_filter([CASE WHEN c_custkey % 2 = 0 THEN 'dart' ELSE 'flutter' END, 'dart'], lambda x: x <> CASE WHEN c_nationkey % 2 = 0 THEN 'dart' ELSE 'none' END)), ',') AS extra FROM customer WHERE c_custkey % 2 = 1 UNION ALL SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN '' ELSE 'dart' END FROM customer WHERE c_custkey % 2 = 0")
def set_difference(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    declared = F.array(F.when(F.col("c_custkey") % 2 == 0, "dart").otherwise("flutter"))
    allowed = F.array(F.when(F.col("c_nationkey") % 2 == 0, "dart").otherwise("none"))
    return c.select("c_custkey", F.array_join(F.array_sort(H.beyond_allowed(declared, allowed)), ",").alias("extra"))


# Versions and history.
@query("SELECT p_partkey, CASE WHEN bool_or(fresh = 0) THEN 0 ELSE 1 END AS status, count(*) AS findings FROM (SELECT p_partkey, CASE WHEN epoch(TIMESTAMP '1998-08-02') - epoch(l_shipdate) < 30 * 86400 THEN 1 ELSE 0 END AS fresh FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_linenumber > 1) GROUP BY 1")
def outdated_grace(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("package"), F.lit("^1.0.0").alias("constraint"), F.lit("1.0.0").alias("upgradable"))
    l = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("package"), F.concat("l_linenumber", F.lit(".0.0")).alias("version"), F.col("l_shipdate").alias("published"), F.lit(False).alias("needs_new_sdk"))
    n = l.where("version <> '1.0.0'").groupBy("package").agg(F.count(F.lit(1)).alias("findings"))
    found = R.outdated(p, l, F.lit("1998-08-02").cast("timestamp"))
    return found.join(n, "package").select(F.col("package").cast("long").alias("p_partkey"), "status", "findings")


@query("SELECT o_orderkey, floor((epoch(TIMESTAMP '1998-08-02') - epoch(o_orderdate)) / 86400)::BIGINT AS days FROM orders")
def age_in_days(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", V.age_days(F.col("o_orderdate"), F.lit("1998-08-02").cast("timestamp")).alias("days"))


@query("SELECT p_partkey, c AS constraint_text, CASE c WHEN '>=40.0.0 <60.0.0' THEN p_size BETWEEN 40 AND 59 WHEN '^2.0.0' THEN p_size = 2 WHEN '>10.5.0 <=20.5.0' THEN p_size BETWEEN 11 AND 20 WHEN '^0.5.0' THEN p_size = 0 WHEN 'any' THEN true ELSE p_size = 7 END AS allowed FROM part, (VALUES ('>=40.0.0 <60.0.0'), ('^2.0.0'), ('>10.5.0 <=20.5.0'), ('^0.5.0'), ('any'), ('7.5.0')) v(c)")
def constraint_allows(spark, sf_dir):
    """Every part's size as a version, against constraints of each form."""
    c = F.explode(F.array(*map(F.lit, (">=40.0.0 <60.0.0", "^2.0.0", ">10.5.0 <=20.5.0", "^0.5.0", "any", "7.5.0")))).alias("constraint_text")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", c)
    return p.select("p_partkey", "constraint_text", V.allows(V.bounds(F.col("constraint_text")), V.key(F.concat(F.col("p_size"), F.lit(".5.0")))).alias("allowed"))


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size % 3, p_size % 12, p_partkey % 2 DESC, p_partkey)::INT AS rank FROM part")
def version_order(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    v = F.concat(F.col("p_size") % 3, F.lit("."), F.col("p_size") % 12, F.lit(".0"), F.when(F.col("p_partkey") % 2 == 1, "-dev.1").otherwise(""))
    order = Window.partitionBy("p_brand").orderBy(V.key(v), "p_partkey")
    return p.select("p_partkey", F.row_number().over(order).alias("rank"))


@query("SELECT o_custkey, min(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END)::INT AS status, arg_min(o_orderkey, (CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def worst_of_each(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return R.worst(o.select("o_custkey", rank.alias("status"), "o_orderkey"), "o_custkey", "status", "o_orderkey")


# Graphs. Regions hold nations, nations suppliers, suppliers parts and parts their brand: every row of lineitem is an edge.
_EDGES = """e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier
UNION SELECT 's' || l_suppkey, 'p' || l_partkey FROM lineitem UNION SELECT 'p' || p_partkey, p_brand FROM part)"""
_LIBS = "CASE k % 5 WHEN 0 THEN 'io' WHEN 1 THEN 'html' WHEN 2 THEN 'ui' ELSE 'core' END"
_ROOTED = f"""{_EDGES}, t AS (SELECT 'p' || p_partkey AS root FROM part UNION SELECT 's' || s_suppkey FROM supplier),
r AS (SELECT root, root AS node, [root] AS path FROM t UNION ALL SELECT root, dst, list_append(path, dst) FROM r JOIN e ON e.src = r.node),
i AS (SELECT node, {_LIBS} AS lib FROM (SELECT 'p' || p_partkey AS node, p_size AS k FROM part UNION SELECT p_brand, regexp_extract(p_brand, '[0-9]+')::INT FROM part)),
o AS (SELECT * FROM (VALUES {", ".join(f"('{r}', '{x}')" for r, libs in G.RUNTIMES.items() for x in libs if x in ("io", "html", "ui", "core"))}) v(runtime, lib)),
v AS (SELECT root, runtime, path, lib FROM r JOIN i USING (node), (SELECT DISTINCT runtime FROM o) y WHERE NOT EXISTS (SELECT 1 FROM o x WHERE x.runtime = y.runtime AND x.lib = i.lib))"""


def _edges(spark, sf_dir):
    t = lambda name, src, dst: table(spark, sf_dir, name).select(src.alias("src"), dst.alias("dst"))
    named = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    rows = t("nation", named("r", "n_regionkey"), named("n", "n_nationkey")).union(t("supplier", named("n", "s_nationkey"), named("s", "s_suppkey")))
    return rows.union(t("lineitem", named("s", "l_suppkey"), named("p", "l_partkey"))).union(t("part", named("p", "p_partkey"), F.col("p_brand"))).distinct()


def _libraries(spark, sf_dir):
    """Roots, what they reach, and the library that each node imports."""
    p = table(spark, sf_dir, "part")
    parts = p.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("root"))
    roots = parts.union(table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))))
    k = F.col("k") % 5
    lib = F.when(k == 0, "io").when(k == 1, "html").when(k == 2, "ui").otherwise("core")
    sizes = p.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node"), F.col("p_size").alias("k"))
    brands = p.select(F.col("p_brand").alias("node"), F.regexp_extract("p_brand", "[0-9]+", 0).cast("int").alias("k")).distinct()
    return roots, G.reach(_edges(spark, sf_dir), roots), sizes.union(brands).select("node", lib.alias("lib"))


@query(f"WITH RECURSIVE {_EDGES}, r AS (SELECT DISTINCT src AS root, src AS node, [src] AS path FROM e WHERE src LIKE 'r%' UNION ALL SELECT root, dst, list_append(path, dst) FROM r JOIN e ON e.src = r.node) SELECT root, node, len(min(path))::INT - 1 AS steps, array_to_string(min(path), '>') AS path FROM r GROUP BY ALL")
def reachability(spark, sf_dir):
    e = _edges(spark, sf_dir)
    found = G.reach(e, e.where(F.col("src").startswith("r")).select(F.col("src").alias("root")).distinct())
    return found.select("root", "node", (F.size("path") - 1).alias("steps"), F.array_join("path", ">").alias("path"))


@query(f"WITH RECURSIVE {_ROOTED}, f AS (SELECT root, runtime, arg_min(path, (len(path), path, lib)) AS path, arg_min(lib, (len(path), path, lib)) AS lib FROM v GROUP BY ALL) SELECT root, runtime, array_to_string(path, '>') AS path, lib FROM f")
def runtime_violations(spark, sf_dir):
    _, reached, imports = _libraries(spark, sf_dir)
    runtimes = G.runtime_table(spark)
    bad = TG.runtime_violations(reached, imports, runtimes, runtimes.select("runtime").distinct())
    return bad.select("root", "runtime", F.array_join("path", ">").alias("path"), "lib")


@query(
    f"WITH RECURSIVE {_ROOTED}, p AS (SELECT * FROM (VALUES {', '.join(f'({n}, {chr(39)}{p}{chr(39)}, {chr(39)}{r}{chr(39)})' for n, (p, *rs) in enumerate(G.PLATFORMS) for r in rs if r)}) x(ord, platform, runtime))"
    " SELECT DISTINCT root, platform, ord FROM t, p WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.root = t.root AND v.runtime = p.runtime)"
)
def platform_tags(spark, sf_dir):
    roots, reached, imports = _libraries(spark, sf_dir)
    runtimes = G.runtime_table(spark)
    bad = TG.runtime_violations(reached, imports, runtimes, runtimes.select("runtime").distinct())
    return G.platform_tags(roots, bad, spark)


# The path that a depth-first search meets first, on the graph that each runtime sees: a part imports its brand where the runtime
# has `io`, else its type; the others are imported in the order in which lineitem, supplier and nation name them.
_FIRST = f"""o AS (SELECT * FROM (VALUES {", ".join(f"('{r}', '{x}')" for r, libs in G.RUNTIMES.items() for x in libs if x in ("io", "html", "ui", "core"))}) v(runtime, lib)),
y AS (SELECT runtime, bool_or(lib = 'io') AS io FROM o GROUP BY 1),
e AS (SELECT src, dst, min(ord) AS ord FROM (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, n_nationkey AS ord FROM nation
  UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, s_suppkey FROM supplier UNION ALL SELECT 's' || l_suppkey, 'p' || l_partkey, (l_orderkey * 64 + l_linenumber) * 10000000 + l_partkey FROM lineitem) GROUP BY ALL),
c AS (SELECT runtime, src, dst, ord FROM e, y UNION ALL SELECT runtime, 'p' || p_partkey, CASE WHEN io THEN p_brand ELSE p_type END, 0 FROM part, y),
w AS (SELECT runtime, 'r' || r_regionkey AS root, 'r' || r_regionkey AS node, []::BIGINT[] AS label, ['r' || r_regionkey] AS path FROM region, y
  UNION ALL SELECT runtime, 'n' || n_nationkey, 'n' || n_nationkey, [], ['n' || n_nationkey] FROM nation, y
  UNION ALL SELECT w.runtime, root, dst, list_append(label, -ord), list_append(path, dst) FROM w JOIN c ON c.runtime = w.runtime AND c.src = w.node),
i AS (SELECT node, {_LIBS} AS lib FROM (SELECT 'p' || p_partkey AS node, p_size AS k FROM part UNION SELECT p_brand, regexp_extract(p_brand, '[0-9]+')::INT FROM part UNION SELECT p_type, length(p_type) FROM part))"""


@query(f"WITH RECURSIVE {_FIRST} SELECT runtime, root, array_to_string(arg_min(path, label), '>') AS path, arg_min(lib, label) AS why FROM w JOIN i USING (node) WHERE NOT EXISTS (SELECT 1 FROM o x WHERE x.runtime = w.runtime AND x.lib = i.lib) GROUP BY ALL")
def first_import_paths(spark, sf_dir):
    named = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    imports = lambda name, src, dst, ord_: table(spark, sf_dir, name).select(src.alias("node"), dst.alias("dst"), F.expr(ord_).cast("long").alias("ord"))
    plain = imports("nation", named("r", "n_regionkey"), named("n", "n_nationkey"), "n_nationkey").union(imports("supplier", named("n", "s_nationkey"), named("s", "s_suppkey"), "s_suppkey"))
    plain = plain.union(imports("lineitem", named("s", "l_suppkey"), named("p", "l_partkey"), "(l_orderkey * 64 + l_linenumber) * 10000000 + l_partkey"))
    part, p = named("p", "p_partkey"), table(spark, sf_dir, "part")
    targets = F.explode(F.array(F.struct(F.col("p_brand").alias("dst"), F.lit(0).alias("rank"), F.lit("io").alias("lib")), F.struct(F.col("p_type").alias("dst"), F.lit(1).alias("rank"), F.lit(None).cast("string").alias("lib"))))
    conditional = p.select(part.alias("src"), F.lit(0).cast("long").alias("slot"), targets.alias("x")).select("src", "slot", "x.*")
    runtimes = G.runtime_table(spark)

    def successors(nodes):
        near = nodes.select(F.col("node").alias("src")).distinct()
        chosen = G.chosen_edges(conditional.join(near, "src", "left_semi"), runtimes).select("runtime", F.col("src").alias("node"), "dst", F.col("slot").alias("ord"))
        return plain.join(nodes, "node").select("runtime", "node", "dst", "ord").union(chosen)

    roots = table(spark, sf_dir, "region").select(named("r", "r_regionkey").alias("root")).union(table(spark, sf_dir, "nation").select(named("n", "n_nationkey"))).crossJoin(runtimes.select("runtime").distinct())  # a fixed number of runtimes
    below = p.select(F.col("p_brand").alias("node"), F.regexp_extract("p_brand", "[0-9]+", 0).cast("int").alias("k")).union(p.select("p_type", F.length("p_type"))).distinct()
    k = F.col("k") % 5
    libs = p.select(part.alias("node"), F.col("p_size").alias("k")).union(below).select("node", F.when(k == 0, "io").when(k == 1, "html").when(k == 2, "ui").otherwise("core").alias("lib"))
    lacking = runtimes.select("runtime").distinct().join(libs.select("lib").distinct()).join(runtimes, ["runtime", "lib"], "left_anti")
    wanted = libs.join(F.broadcast(kept(lacking)), "lib").select("runtime", "node", F.col("lib").alias("why"))  # a few libraries by a few runtimes
    found = G.first_found(successors, roots, wanted, ["runtime"])
    return found.select("runtime", "root", F.array_join("path", ">").alias("path"), "why")


# Lines out of chunks: a text as a tool would write it, in pieces of 512 bytes, put together by the operator of streams.
@query(r"SELECT doc_id, count(*) AS n_lines, md5(string_agg(md5(line), '' ORDER BY n)) AS digest FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS n FROM (SELECT doc_id, list_filter(string_split_regex(text, '[\r\n]+'), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL)) GROUP BY 1")
def assembled_lines(spark, sf_dir):
    from ..streaming.chunks import assembled

    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("body")).where("body is not null")
    count = F.greatest(F.lit(1), F.ceil(F.length("body") / 512)).cast("int")
    cut = d.select("doc_id", "body", count.alias("n"), F.explode(F.sequence(F.lit(0), count - 1)).alias("seq"))
    chunks = cut.select("doc_id", "seq", F.expr("substring(body, seq * 512 + 1, 512)").alias("data"), (F.col("seq") == F.col("n") - 1).alias("last"))
    lines = assembled(chunks, "doc_id", most_bytes=1 << 30, most_early=1 << 20)
    each = F.sort_array(F.collect_list(F.struct("n", F.md5("line").alias("m"))))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.md5(F.array_join(F.transform(each, lambda x: x["m"]), "")).alias("digest"))


# Checks of pages as table functions: the issues of each page LATERAL, and of those the first five of a page.
@query(
    r"""WITH g AS (SELECT page_id, 'insecure' AS code, regexp_extract_all(html, 'http://[A-Za-z0-9./_-]+') AS d FROM pages
UNION ALL SELECT page_id, 'bare_image', list_filter(regexp_extract_all(html, '<img[^>]*>'), lambda x: NOT contains(x, ' alt=')) FROM pages
UNION ALL SELECT page_id, 'long_line', list_transform(list_filter(string_split(html, chr(10)), lambda x: length(x) > 120), lambda x: length(x)::VARCHAR) FROM pages),
i AS (SELECT page_id, code, unnest(range(1, len(d) + 1)) AS nth, unnest(d) AS detail FROM g),
n AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY code, nth) AS place FROM i)
SELECT page_id, place::INT AS place, code, nth::INT AS nth, detail FROM n WHERE place <= 5
UNION ALL SELECT page_id, 6, 'more', count(*)::INT - 5, NULL FROM n GROUP BY 1 HAVING count(*) > 5"""
)
def page_issues(spark, sf_dir):
    from ..functions import generators

    generators.register(spark, generators.PAGE_CHECKS, "page_checks")
    issues = spark.sql("SELECT p.page_id AS key, i.code, i.nth, i.detail FROM {pages} p, LATERAL page_checks(p.html) i", pages=table(spark, sf_dir, "pages").select("page_id", "html"))
    return spark.sql("SELECT key AS page_id, place, code, nth, detail FROM page_checks_shown(TABLE({issues}) PARTITION BY key ORDER BY (code, nth))", issues=issues)


# Lists, codes and caches.
@query("SELECT doc_id, CASE WHEN length(t) < 64 THEN t ELSE left(t, 24) || '[...]' || right(t, 24) END AS cut FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def truncated_texts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", Q.elided(F.coalesce("text", F.lit(""))).alias("cut"))


@query("SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'delete' WHEN 'N' THEN 'match' ELSE 'insert' END AS type, l_linenumber::INT AS start, l_quantity::INT AS length, CASE WHEN l_returnflag = 'A' THEN l_linestatus END AS content FROM lineitem")
def coded_operations(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", "delete").when(F.col("l_returnflag") == "N", "match").otherwise("insert")
    one = F.struct(kind.alias("type"), F.col("l_linenumber").alias("start"), F.col("l_quantity").cast("int").alias("length"), F.when(F.col("l_returnflag") == "A", F.col("l_linestatus")).alias("content"))
    flat = l.select("l_orderkey", "l_linenumber", Q.ops_flat(F.array(one)).alias("f"))
    return flat.select("l_orderkey", "l_linenumber", F.explode(Q.ops_nested(F.col("f"))).alias("o")).select("l_orderkey", "l_linenumber", "o.*")


@query("SELECT user_id AS key, arg_max(value, (ts, event_id)) AS value FROM events WHERE ts + INTERVAL 4 HOUR >= TIMESTAMP '2024-01-02' GROUP BY 1")
def fresh_cache(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "value", F.col("ts").cast("timestamp").alias("t"), "event_id")
    last = e.groupBy("key", F.col("t").alias("ts")).agg(F.max_by("value", "event_id").alias("value"))
    return fresh_entries(last, F.lit("2024-01-02").cast("timestamp")).select("key", "value")


@query("SELECT page_id, 'url/' || left(regexp_replace(lower(url), '[^a-z0-9]', '', 'g'), 40) || '-' || sha256(url) AS name FROM pages")
def cache_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", cache_file(F.lit("url"), F.col("url")).alias("name"))


@query("SELECT name, ord, count(*) AS n FROM (SELECT trim(unnest(string_split(replace(v, chr(10), ','), ','))) AS name, unnest(range(0, len(string_split(replace(v, chr(10), ','), ','))))::INT AS ord FROM (SELECT c_mktsegment || ', ,' || c_name || chr(10) || ' ' || c_nationkey AS v FROM customer)) WHERE name <> '' GROUP BY ALL")
def listed_names(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.concat("c_mktsegment", F.lit(", ,"), "c_name", F.lit("\n "), F.col("c_nationkey").cast("string")).alias("v"))
    return list_argument(c, "v").groupBy("name", "ord").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'example/README.md' WHEN p_partkey % 4 = 1 THEN 'example/main.dart' ELSE 'example/p' || p_partkey || '.dart' END AS path FROM part WHERE p_partkey % 4 <> 3")
def example_file(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("p"), "p_partkey").alias("name"))
    rows = F.array(*[F.struct(F.lit(k).alias("rank"), F.replace(F.lit(x), F.lit("{}"), F.col("name")).alias("path")) for k, x in enumerate(Q.EXAMPLE_PATHS)])
    candidates = p.select("p_partkey", F.explode(rows).alias("c")).select("p_partkey", "c.path", "c.rank")
    main, own = F.lit("example/main.dart"), F.concat(F.lit("example/"), "name", F.lit(".dart"))
    there = F.when(F.col("p_partkey") % 4 == 0, F.array(main, F.lit("example/README.md"))).when(F.col("p_partkey") % 4 == 1, F.array(own, main)).when(F.col("p_partkey") % 4 == 2, F.array(own)).otherwise(F.array(F.lit("lib/x.dart")))
    return R.first_existing(p.select("p_partkey", F.explode(there).alias("path")), candidates, "p_partkey")


@query("SELECT n_name, n_regionkey % 3 = 0 AS target, n_nationkey % 2 = 0 AS library FROM nation")
def path_predicates(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    path = F.when(F.col("n_regionkey") % 3 == 0, F.concat(F.lit("lib/"), "n_name")).otherwise(F.concat(F.lit("test/lib/"), "n_name"))
    href = F.when(F.col("n_nationkey") % 2 == 0, F.concat("n_name", F.lit("/"))).otherwise(F.concat("n_name", F.lit("/x.html")))
    return n.select("n_name", Q.is_analysis_target(path).alias("target"), Q.is_library_href(href).alias("library"))


_CUT_LINES = "list_transform(ls[1:10], lambda x: CASE WHEN length(x) > 200 THEN left(x, 195) || '[...]' ELSE x END)"


@query(f"SELECT doc_id, array_to_string(CASE WHEN len(ls) > 10 THEN list_append({_CUT_LINES}, '[' || (len(ls) - 10) || ' more lines]') ELSE {_CUT_LINES} END, chr(10)) AS output FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)")
def trimmed_outputs(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", Q.trimmed_output(F.coalesce("text", F.lit(""))).alias("output"))


# Packages.
@query("WITH h AS (SELECT l_orderkey, lower(l_returnflag) AS id FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL) SELECT o.l_orderkey, CASE WHEN count(h.id) = 0 THEN 'license:unknown' ELSE string_agg('license:' || h.id, ',' ORDER BY h.id) || CASE WHEN bool_and(h.id IN ('a', 'n')) THEN ',license:open' ELSE '' END END AS tags FROM (SELECT DISTINCT l_orderkey FROM lineitem) o LEFT JOIN h USING (l_orderkey) GROUP BY 1")
def licence_tags(spark, sf_dir):
    from ..operators.manifests import licence_tags as tags

    l = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_linestatus") == "O", F.col("l_returnflag")).alias("id"))
    return tags(l, "l_orderkey", "id", spark.createDataFrame([("A",), ("N",)], "id string")).withColumn("tags", F.array_join("tags", ","))


@query("SELECT o_custkey AS repo, count(*) FILTER (o_orderpriority = '1-URGENT') AS n, CASE count(*) FILTER (o_orderpriority = '1-URGENT') WHEN 1 THEN 'found' WHEN 0 THEN 'missing' ELSE 'ambiguous' END AS verdict FROM orders GROUP BY 1")
def unique_manifest(spark, sf_dir):
    from ..operators.manifests import only_named

    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("repo"), F.col("o_orderpriority").alias("name"), F.col("o_orderkey").cast("string").alias("path"))
    found = only_named(o, o.select("repo").distinct().withColumn("name", F.lit("1-URGENT")))
    n = o.groupBy("repo").agg(F.count_if(F.col("name") == "1-URGENT").alias("n"))
    return found.join(n, "repo").select("repo", "n", "verdict")


@query("SELECT c_custkey AS package, 'x' || c_nationkey AS name FROM customer WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal > 9000)")
def missing_executables(spark, sf_dir):
    from ..operators.manifests import missing_executables as missing

    c = table(spark, sf_dir, "customer")
    declared = c.select(F.col("c_custkey").alias("package"), F.concat(F.lit("x"), "c_nationkey").alias("name"), F.lit(" ").alias("file"))
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("c_nationkey")).distinct()
    files = c.join(s, "c_nationkey").select(F.col("c_custkey").alias("package"), F.concat(F.lit("bin/x"), "c_nationkey", F.lit(".dart")).alias("path"))
    return missing(declared, files).select("package", "name")


@query("WITH " + _LINKS + "SELECT page_id, 'insecure' AS kind, count(*) AS n, count(*) || ' insecure link' || CASE WHEN count(*) = 1 THEN '' ELSE 's' END AS text FROM sc WHERE NOT bad AND scheme NOT IN ('', 'https', 'mailto') GROUP BY 1 UNION ALL SELECT page_id, 'unparsed', count(*), count(*) || ' unparsable link' || CASE WHEN count(*) = 1 THEN '' ELSE 's' END FROM sc WHERE bad GROUP BY 1")
def link_issues(spark, sf_dir):
    from ..operators.manifests import link_issues as issues

    links = _links(spark, sf_dir).withColumn("ord", F.col("url"))
    return issues(links, "page_id").select("page_id", "kind", "n", "text")


@query("SELECT user_id, event_id, arg_max(event_type, event_id) FILTER (event_type <> 'error') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events")
def previous_equal(spark, sf_dir):
    from ..operators.manifests import previous_equal as previous

    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "error", "insert").otherwise("equal").alias("op"), F.col("event_type").alias("text"))
    return previous(e, "user_id", "event_id", "op", "text").select("user_id", "event_id", "before")


@query("SELECT o_custkey, min(CASE WHEN o_orderstatus = 'P' THEN o_orderkey END) AS failed_at FROM orders GROUP BY 1")
def first_failure(spark, sf_dir):
    from ..operators.manifests import first_failure as first

    o = table(spark, sf_dir, "orders").withColumn("ok", F.col("o_orderstatus") != "P")
    return first(o, "o_custkey", "o_orderkey", "ok")


@query("SELECT o_custkey, CASE WHEN o_orderkey % 9 = 0 THEN 'unreadable' WHEN o_orderkey % 8 = 0 THEN 'empty' WHEN o_orderkey % 7 = 0 THEN 'malformed' WHEN o_orderkey % 6 = 0 THEN 'other name' WHEN o_orderkey % 5 = 0 THEN 'no URL' WHEN o_orderkey % 4 = 0 THEN 'bad URL' WHEN o_orderkey % 3 = 0 THEN 'other URL' WHEN o_orderkey % 2 = 0 THEN 'no version' END AS verdict, count(*) AS n FROM orders GROUP BY ALL")
def manifest_verdicts(spark, sf_dir):
    from ..operators.manifests import manifest_verdict

    o = table(spark, sf_dir, "orders")
    every = lambda k: F.col("o_orderkey") % k == 0
    url = F.when(every(5), "").when(every(4), "nothing").when(every(3), "https://github.com/a/c").otherwise("https://github.com/a/b.git")
    v = manifest_verdict(~every(9), F.when(every(8), " ").otherwise("x"), ~every(7), F.when(every(6), "b").otherwise("a"), F.lit("a"), url, F.when(~every(2), "1.0.0"), F.lit(None).cast("string"), F.lit("https://github.com/a/b"))
    return o.select("o_custkey", v.alias("verdict")).groupBy("o_custkey", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'https://github.com/x/p' || p_partkey ELSE 'https://gitlab.com/x/p' || p_partkey END AS repository, CASE WHEN p_size % 2 = 0 THEN 'https://github.com/x/p' || p_partkey || '/issues' ELSE 'https://gitlab.com/x/p' || p_partkey || '/-/issues' END AS tracker FROM part")
def shown_links(spark, sf_dir):
    from ..operators.manifests import shown_links as shown

    p = table(spark, sf_dir, "part")
    home = F.concat(F.when(F.col("p_size") % 2 == 0, "https://github.com/x/p").otherwise("https://gitlab.com/x/p"), F.col("p_partkey").cast("string"))
    none = F.lit(None).cast("string")
    return p.select("p_partkey", shown(home, none, none, F.lit(True)).alias("s")).select("p_partkey", "s.repository", "s.tracker")


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 2 ELSE 0 END + CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END AS issues FROM supplier")
def screenshot_issues(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    path = F.when(F.col("s_acctbal") < 0, "../a:b.png").otherwise("a.png")
    text = F.when(F.col("s_suppkey") % 2 == 0, "").otherwise("a view")
    size = F.when(F.col("s_suppkey") % 3 == 0, 5 << 20).otherwise(100)
    return s.select("s_suppkey", F.size(Q.screenshot_issues(text, path, F.lit(True), size)).alias("issues"))


@query("SELECT n_nationkey, n_nationkey % 2 = 0 AS swift_package, n_nationkey % 3 = 0 AS kotlin_ready FROM nation")
def plugin_tags(spark, sf_dir):
    from ..operators.manifests import plugin_tags as tags

    n = table(spark, sf_dir, "nation").select("n_nationkey")
    old = F.when(F.col("n_nationkey") % 3 == 0, "plugins {\n  id 'com.android.library'\n}").otherwise("apply plugin: 'kotlin-android'")
    swift = F.when(F.col("n_nationkey") % 2 == 0, "ios/x/Package.swift").otherwise("ios/x/other.swift")
    files = n.select("n_nationkey", F.explode(F.array(F.struct(F.lit("android/build.gradle").alias("path"), old.alias("content")), F.struct(swift.alias("path"), F.lit("").alias("content")))).alias("f"))
    return tags(files.select("n_nationkey", "f.*"), "n_nationkey", "path", "content")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'flutter,fuchsia' WHEN c_custkey % 3 = 1 THEN 'flutter' ELSE '' END AS sdks FROM customer")
def manifest_sdks(spark, sf_dir):
    from ..functions import semi as J

    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey") % 3
    env = F.when(k < 2, F.create_map(F.lit("sdk"), F.lit("^3.0.0"), F.lit("flutter"), F.lit("any"))).otherwise(F.create_map(F.lit("sdk"), F.lit("^3.0.0")))
    deps = F.create_map(F.lit("a"), F.lit(None).cast("string"), F.lit("b"), F.when(k == 0, "fuchsia"))
    return c.select("c_custkey", F.array_join(J.dependent_sdks(env, deps, F.create_map().cast("map<string,string>")), ",").alias("sdks"))


@query()
def yaml_to_json(spark, sf_dir):
    from ..functions import semi as J

    p = table(spark, sf_dir, "part")
    text = F.concat(F.lit("b: "), F.col("p_size").cast("string"), F.lit("\na:\n  - x\n  - {k: "), F.col("p_partkey").cast("string"), F.lit("}\n"))
    return p.select("p_partkey", J.yaml_json(text).alias("json"))
