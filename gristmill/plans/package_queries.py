"""Registered queries of reports, tags, manifests, processes and rendering, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import diagnostics as D
from ..functions import markdown as MD
from ..functions import render as N
from ..functions import rules as L
from ..functions import versions as V
from ..functions.ordering import numbered
from ..operators import graphs as G
from ..operators import manifests as H
from ..operators import matching as M
from ..operators import relations as R
from ..operators import scoring as S
from ..operators import tags as TG
from ..sources.paged import selected
from ..sources.session import scratch_path
from ..sources.tables import table, version_listing
from . import report as P
from .registry import query

def _text(spark, sf_dir):
    return table(spark, sf_dir, "documents").withColumn("t", F.coalesce("text", F.lit("")))


def _kth(k, *values):
    """The k-th of some texts; null counts as a text that is not there."""
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), k.cast("int"))


def _sql_kth(k, *values):
    quoted = ["NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values]
    return f"[{', '.join(quoted)}][({k}) + 1]"


# Diagnostics and processes.
_FORMS = r"""WITH l AS (SELECT event_id, user_id, event_type, event_id % 8 AS k FROM events)
SELECT event_id, CASE WHEN k IN (0, 2) THEN 'ignored' WHEN k = 1 THEN 'part' WHEN k = 3 THEN 'too_many' WHEN k = 4 THEN 'unexpected' ELSE 'diagnostic' END AS form,
CASE WHEN k IN (1, 3) THEN 'ERROR' WHEN k > 4 THEN upper(event_type) END AS severity, CASE k WHEN 1 THEN 'UNKNOWN' WHEN 3 THEN 'TOO_MANY_LINES' ELSE CASE WHEN k > 4 THEN 'code_' || (user_id % 9) END END AS error_code,
CASE k WHEN 1 THEN 'lib/f' || (user_id % 7) || '.dart' WHEN 3 THEN 'pubspec.yaml' ELSE CASE WHEN k > 4 THEN 'C:\lib\f' || (user_id % 7) || '|x.dart' END END AS file,
CASE WHEN k IN (1, 3) THEN 0 WHEN k > 4 THEN (event_id % 90)::INT END AS line, CASE WHEN k IN (1, 3) THEN 0 WHEN k > 4 THEN (user_id % 50)::INT END AS length,
CASE k WHEN 1 THEN 'is a part and cannot be analyzed.' WHEN 3 THEN 'Analysis returned too many issues.' ELSE CASE WHEN k > 4 THEN 'about | ' || event_type END END AS description FROM l"""


@query(_FORMS)
def problem_forms(spark, sf_dir):
    """Lines of every form that the analyser writes."""
    e = table(spark, sf_dir, "events")
    n = lambda c, m: (F.col(c) % m).cast("string")
    k = F.col("event_id") % 8
    plain = F.concat(F.upper("event_type"), F.lit("|LINT|code_"), n("user_id", 9), F.lit(r"|C:\\lib\\f"), n("user_id", 7), F.lit(r"\|x.dart|"), n("event_id", 90), F.lit("|1|"), n("user_id", 50), F.lit("|about | "), "event_type")
    line = F.when(k == 0, "").when(k == 1, F.concat(F.lit("lib/f"), n("user_id", 7), F.lit(".dart is a part and cannot be analyzed."))).when(k == 2, "Please pass in a library that contains this part.")
    line = line.when(k == 3, F.concat(F.lit("STDERR exceeded "), F.col("event_id").cast("string"), F.lit(" lines."))).when(k == 4, F.concat(F.lit("what is "), F.col("event_id").cast("string"))).otherwise(plain)
    r = e.select("event_id", line.alias("l")).select("event_id", D.line_form(F.col("l")).alias("form"), D.problem(F.col("l")).alias("p"))
    return r.select("event_id", "form", "p.severity", "p.error_code", "p.file", "p.line", "p.length", "p.description")


@query("""WITH l AS (SELECT user_id, event_id, CASE event_type WHEN 'view' THEN 'Formatted lib/a.dart' WHEN 'signup' THEN 'Changed /pkg/' || CASE WHEN event_id % 2 = 0 THEN 'lib' ELSE 'example' END || '/f' || event_id || '.dart'
WHEN 'click' THEN 'line 3, column 4 of /pkg/example/x.dart: odd' WHEN 'purchase' THEN '  12 | code' ELSE CASE WHEN event_id % 23 = 0 THEN 'line 1, column 2 of /pkg/lib/y.dart: worse' ELSE '' END END AS t FROM events),
g AS (SELECT user_id, list(t ORDER BY event_id) AS ls FROM l GROUP BY 1),
c AS (SELECT user_id, ls, list_sort(list_transform(list_filter(ls, lambda x: starts_with(x, 'Changed /pkg/lib/')), lambda x: x[14:])) AS files, len(list_filter(ls, lambda x: starts_with(x, 'line 1,'))) AS odd FROM g),
d AS (SELECT *, (user_id % 2 = 1 AND len(files) > 0) OR odd = 0 AS settled FROM c)
SELECT user_id, CASE WHEN settled THEN array_to_string(files, ',') END AS files, CASE WHEN NOT settled THEN array_to_string(ls[1:20], chr(10)) END AS error FROM d""")
def formatter_runs(spark, sf_dir):
    e, i = table(spark, sf_dir, "events"), F.col("event_id").cast("string")
    t = F.col("event_type")
    changed = F.concat(F.lit("Changed /pkg/"), F.when(F.col("event_id") % 2 == 0, "lib").otherwise("example"), F.lit("/f"), i, F.lit(".dart"))
    line = F.when(t == "view", "Formatted lib/a.dart").when(t == "signup", changed).when(t == "click", "line 3, column 4 of /pkg/example/x.dart: odd").when(t == "purchase", "  12 | code").when(F.col("event_id") % 23 == 0, "line 1, column 2 of /pkg/lib/y.dart: worse").otherwise("")
    by = e.select("user_id", "event_id", line.alias("l")).groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "l"))), lambda x: x["l"]), "\n").alias("output"))
    r = by.select("user_id", D.formatted(F.col("output"), (F.col("user_id") % 2).cast("int"), F.lit("/pkg")).alias("r"))
    return r.select("user_id", F.array_join("r.files", ",").alias("files"), F.col("r.error").alias("error"))


@query("""WITH e AS (SELECT user_id, event_id, ' - `c' || (event_id % 5) || '` - `lib/' || props || ':' || (event_id % 90) || ':7` - at ' || event_id AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'error')
SELECT user_id, count(*) AS errors, string_agg(t, chr(10) ORDER BY n) FILTER (n <= 3) AS shown FROM e GROUP BY 1""")
def downgrade_errors(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    p = e.select("user_id", "event_id", F.col("event_type").alias("severity"), F.concat(F.lit("c"), (F.col("event_id") % 5).cast("string")).alias("error_code"), F.concat(F.lit("lib/"), "props").alias("file"), (F.col("event_id") % 90).cast("int").alias("line"), F.lit(7).alias("col"), F.concat(F.lit("at "), F.col("event_id").cast("string")).alias("description"))
    return D.first_errors(p, "user_id", "event_id").select("user_id", "errors", F.array_join("shown", "\n").alias("shown"))


_SECONDS = ("90", "", None, " 7 ", "-3")


@query(f"""SELECT event_id, value > 900 OR user_id % 5 <> 0 OR event_type = 'error' OR event_id % 11 = 0 AS failed, CASE WHEN user_id % 3 > 0 THEN greatest(user_id % 50 - event_id % 60, 1) END AS budget,
nullif({_sql_kth("event_id % 5", "90", "", None, "7", "-3")}, '')::BIGINT AS pause, CASE WHEN event_id % 2 = 0 THEN '3.' || (user_id % 9) ELSE '2.' || event_id % 9 END AS version, event_type = 'error' AS stops FROM events""")
def process_outcomes(spark, sf_dir):
    e, c = table(spark, sf_dir, "events"), F.col
    json_text = F.when(c("event_id") % 2 == 0, F.concat(F.lit('{"frameworkVersion": "3.'), (c("user_id") % 9).cast("string"), F.lit('"}')))
    return e.select(
        "event_id",
        L.was_error(c("value") > 900, (c("user_id") % 5).cast("int"), c("event_type") == "error", c("event_id") % 11 == 0).alias("failed"),
        L.remaining_seconds(F.when(c("user_id") % 3 > 0, c("user_id") % 50), c("event_id") % 60).alias("budget"),
        L.seconds(_kth(c("event_id") % 5, *_SECONDS)).cast("interval second").cast("long").alias("pause"),
        L.kit_version(json_text, F.concat(F.lit(" 2."), (c("event_id") % 9).cast("string"), F.lit("\n"))).alias("version"),
        D.blocking(c("event_type"), F.lit("LINT")).alias("stops"),
    )


_PATHS = ("a/b.dart", "./a", "a//b", "..", "../x", "a/../b", "a/b/", "a/-b", "$x", "a/ b", ".", "/a")


@query(f"""SELECT p_partkey, {_sql_kth("p_size % 12", *_PATHS)} AS path, {_sql_kth("p_size % 12", *["true" if x in (0, 3, 4, 7, 10) else "false" for x in range(12)])}::BOOLEAN AS plain, regexp_matches(p_name, '^[a-z0-9]+') AS branch,
'gen/100x100/shots/' || p_name || '.webp' AS small, 'gen/190x190/shots/' || p_name || '.png' AS large, CASE WHEN p_size > 25 THEN 100 ELSE 0 END AS width, CASE WHEN p_size > 25 THEN 0 ELSE 100 END AS height FROM part""")
def path_rules(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    path, made = _kth(F.col("p_size") % 12, *_PATHS), L.image_paths(F.concat(F.lit("shots/"), "p_name", F.lit(".jpeg")))
    size = L.thumbnail_size(F.col("p_size"), F.lit(25), 100)
    return p.select("p_partkey", path.alias("path"), L.is_plain_path(path).alias("plain"), L.is_branch(F.col("p_name")).alias("branch"), made["webp_100"].alias("small"), made["png_190"].alias("large"), size["width"].alias("width"), size["height"].alias("height"))


_OUTPUTS = """CASE doc_id % 4 WHEN 0 THEN ' {"b": 1, "a": [2]} ' WHEN 1 THEN coalesce(text, '') WHEN 2 THEN '[1, 2]' ELSE '{"x": {"y": 1}, "' || coalesce(lang, '') || '": null}' END"""


@query(f"""WITH o AS (SELECT doc_id, coalesce(lang, '') AS lang, string_split(trim({_OUTPUTS}), chr(10)) AS ls FROM documents), c AS (SELECT *, list_transform(ls[1:10], lambda x: CASE WHEN length(x) > 200 THEN left(x, 195) || '[...]' ELSE x END) AS cut FROM o)
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'a,b' WHEN 3 THEN array_to_string(list_sort(['x', lang]), ',') END AS keys, CASE WHEN doc_id % 4 IN (1, 2) THEN 'Unable to parse output as JSON:' || chr(10) || chr(10) || '```' || chr(10) || array_to_string(CASE WHEN len(ls) > 10 THEN list_append(cut, '[' || (len(ls) - 10) || ' more lines]') ELSE cut END, chr(10)) || chr(10) || '```' || chr(10) END AS error FROM c""")
def json_outputs(spark, sf_dir):
    d, k = _text(spark, sf_dir), F.col("doc_id") % 4
    out = F.when(k == 0, ' {"b": 1, "a": [2]} ').when(k == 1, F.col("t")).when(k == 2, "[1, 2]").otherwise(F.concat(F.lit('{"x": {"y": 1}, "'), F.coalesce("lang", F.lit("")), F.lit('": null}')))
    r = d.select("doc_id", L.json_object(out).alias("r"))
    return r.select("doc_id", F.array_join("r.keys", ",").alias("keys"), F.col("r.error").alias("error"))


@query("""SELECT s_suppkey, '{"name":"' || s_name || '"' || CASE WHEN s_suppkey % 3 > 0 THEN ',"version":"' || (s_suppkey % 3) || '.0.0"' ELSE '' END || ',"tags":["n' || s_nationkey || '","x"]' || CASE WHEN s_suppkey % 2 = 0 THEN ',"report":{"granted":' || s_nationkey || ',"max":160}' ELSE '' END || '}' AS json,
s_name AS name, CASE WHEN s_suppkey % 3 > 0 THEN (s_suppkey % 3) || '.0.0' END AS version, 2 AS tags, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey END AS granted FROM supplier""")
def summary_round_trip(spark, sf_dir):
    """Objects as JSON without their nulls, and read back."""
    s, kind = table(spark, sf_dir, "supplier"), "name string, version string, tags array<string>, report struct<granted:int,max:int>"
    version = F.when(F.col("s_suppkey") % 3 > 0, F.concat((F.col("s_suppkey") % 3).cast("string"), F.lit(".0.0")))
    whole = F.struct(F.col("s_name").alias("name"), version.alias("version"), F.array(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")), F.lit("x")).alias("tags"), F.when(F.col("s_suppkey") % 2 == 0, F.struct(F.col("s_nationkey").alias("granted"), F.lit(160).alias("max"))).alias("report"))
    r = s.select("s_suppkey", F.to_json(whole).alias("json")).withColumn("o", F.from_json("json", kind))
    return r.select("s_suppkey", "json", "o.name", "o.version", F.size("o.tags").alias("tags"), F.col("o.report.granted").alias("granted"))


# Reports.
_FOUND = """f AS (SELECT doc_id, t <> '' AS readable, (length(t) < 50)::INT + (lang IS NULL)::INT AS mi, (length(t) - length(replace(t, 'http://', ''))) // 7 AS ru, length(t) - length(replace(t, '@', '')) AS ai,
(length(t) - length(replace(t, '###', ''))) // 3 AS rm, (NOT contains(t, '1'))::INT AS cl, contains(lower(t), 'licen') AS lf, contains(lower(t), 'mit') AS lo, ratio, contains(t, 'er') AS ex, (length(t) - length(replace(t, '***', ''))) // 3 AS sp,
length(t) % 7 AS pl, contains(t, 'we') AS web, contains(t, 'was') AS wasm, contains(t, '%%%') AS ob, (length(t) - length(replace(t, '$$$', ''))) // 3 AS er, (length(t) - length(replace(t, '&&&', ''))) // 3 AS wa, (length(t) - length(replace(t, '.' || chr(10), ''))) // 2 AS ot,
contains(t, 'a') AS al, CASE length(t) % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 END AS wo, contains(t, 'stupid') AS di, contains(t, 'e') AS hs, contains(t, 'th') AS ka, (length(t) - length(replace(t, '***', ''))) // 3 AS de
FROM (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents) LEFT JOIN (SELECT doc_id, avg(quality) AS ratio FROM labels GROUP BY 1) USING (doc_id)),
s AS (SELECT doc_id, 1 AS ord, CASE WHEN mi + ru > 0 THEN 0 ELSE 10 END AS granted, 10 AS max, CASE WHEN mi + ru > 0 THEN 1 WHEN ai > 0 THEN 2 ELSE 3 END AS st FROM f WHERE readable
UNION ALL SELECT doc_id, 1, CASE WHEN rm = 0 THEN 5 ELSE 0 END, 5, CASE WHEN rm = 0 THEN 3 ELSE 1 END FROM f WHERE readable
UNION ALL SELECT doc_id, 1, CASE WHEN cl = 0 THEN 5 ELSE 0 END, 5, CASE WHEN cl = 0 THEN 3 ELSE 1 END FROM f WHERE readable
UNION ALL SELECT doc_id, 1, CASE WHEN lf AND lo THEN 10 WHEN lf THEN 5 ELSE 0 END, 10, CASE WHEN lf AND lo THEN 3 WHEN lf THEN 2 ELSE 1 END FROM f WHERE readable
UNION ALL SELECT doc_id, 2, CASE WHEN ratio >= 0.2 THEN 10 ELSE 0 END, 10, CASE WHEN ratio >= 0.2 THEN 3 ELSE 2 END FROM f WHERE readable AND ratio IS NOT NULL
UNION ALL SELECT doc_id, 2, CASE WHEN ex AND sp = 0 THEN 10 ELSE 0 END, 10, CASE WHEN ex AND sp = 0 THEN 3 ELSE 1 END FROM f WHERE readable
UNION ALL SELECT doc_id, 3, CASE WHEN pl = 0 THEN 0 WHEN web AND NOT wasm OR ob THEN 10 ELSE 20 END, 20, CASE WHEN pl = 0 THEN 1 WHEN web AND NOT wasm OR ob THEN 2 ELSE 3 END FROM f WHERE readable
UNION ALL SELECT doc_id, 4, CASE WHEN er > 0 THEN 0 WHEN wa > 0 THEN 30 WHEN ot > 0 THEN 40 ELSE 50 END, 50, CASE WHEN er > 0 OR wa > 0 THEN 1 WHEN ot > 0 THEN 2 ELSE 3 END FROM f WHERE readable
UNION ALL SELECT doc_id, 5, CASE WHEN NOT al OR di OR coalesce(wo, 9) = 0 THEN 0 ELSE 10 END, 10, CASE WHEN NOT al OR di OR coalesce(wo, 9) = 0 THEN 1 WHEN wo IN (1, 2) THEN 2 ELSE 3 END FROM f WHERE readable
UNION ALL SELECT doc_id, 5, CASE WHEN hs AND al AND ka THEN 10 ELSE 0 END, 10, CASE WHEN hs AND al AND ka THEN 3 ELSE 1 END FROM f WHERE readable
UNION ALL SELECT doc_id, 5, CASE WHEN de = 0 THEN 20 ELSE 0 END, 20, CASE WHEN de = 0 THEN 3 ELSE 1 END FROM f WHERE readable
UNION ALL SELECT doc_id, 1, 0, 100, 1 FROM f WHERE NOT readable)"""


def _findings(spark, sf_dir):
    """Findings read off the texts, so that every rule meets every outcome."""
    l = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.avg("quality").alias("documented_ratio"))
    t, has = F.col("t"), lambda x: F.col("t").contains(x)
    times = lambda x: ((F.length(t) - F.length(F.replace(t, F.lit(x), F.lit("")))) / len(x)).cast("long")
    yes = lambda c: c.cast("long")
    left = F.length(t) % 5
    facts = {
        "readable": t != "", "manifest_issues": yes(F.length(t) < 50) + yes(F.col("lang").isNull()), "rejected_urls": times("http://"), "accepted_issues": times("@"), "readme_issues": times("###"), "changelog_issues": yes(~has("1")),
        "licence_found": F.lower(t).contains("licen"), "licence_open": F.lower(t).contains("mit"), "example": has("er"), "screenshot_problems": times("***"), "platforms": (F.length(t) % 7).cast("long"), "web": has("we"), "wasm": has("was"), "old_build": has("%%%"),
        "errors": times("$$$"), "warnings": times("&&&"), "others": times(".\n"), "allows_current": has("a"), "worst_update": F.when(left <= 2, left), "discontinued": has("stupid"), "has_sdk": has("e"), "kit_allowed": has("th"), "downgrade_errors": times("***"),
    }
    return _text(spark, sf_dir).join(l, "doc_id", "left").select("doc_id", "documented_ratio", *[v.alias(k) for k, v in facts.items()])


@query(f"""WITH {_FOUND} SELECT doc_id, ord, ['convention', 'documentation', 'platform', 'analysis', 'dependency'][ord] AS section, CASE WHEN sum(max) = 100 AND ord = 1 THEN 'Failed to parse the manifest' ELSE ['Follow Dart file conventions', 'Provide documentation', 'Platform support', 'Pass static analysis', 'Support up-to-date dependencies'][ord] END AS title,
sum(granted)::BIGINT AS granted, sum(max)::BIGINT AS max, ['failed', 'partial', 'passed'][min(st)] AS status FROM s GROUP BY doc_id, ord""")
def package_report(spark, sf_dir):
    return P.sections(_findings(spark, sf_dir), "doc_id")


@query(f"WITH {_FOUND}, t AS (SELECT doc_id, sum(granted)::BIGINT AS granted, sum(max)::BIGINT AS max FROM s GROUP BY 1) SELECT *, CASE WHEN max - granted >= 60 THEN 127 ELSE 0 END AS code FROM t")
def package_points(spark, sf_dir):
    t = P.totals(_findings(spark, sf_dir), "doc_id")
    return t.withColumn("code", S.exit_code(t, 60))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 > 0 AND doc_id % 4 > 0 THEN '* ' || coalesce(source, 'none') ELSE '<details>' || chr(10) || '<summary>' || chr(10) || coalesce(source, 'none') || chr(10) || '</summary>' || chr(10) || chr(10) ||
CASE WHEN doc_id % 3 = 0 THEN '`lib/' || doc_id || '.dart:' || (doc_id % 10 + 1) || ':' || (doc_id % 7 + 1) || '`' || chr(10) || chr(10) || '```' || chr(10) || CASE WHEN length(t) > 1024 THEN left(t, 1020) || chr(10) || '[...]' ELSE t END || chr(10) || '```' || chr(10) || chr(10) ELSE '' END ||
CASE WHEN doc_id % 4 = 0 THEN 'try again' || chr(10) ELSE '' END || '</details>' END AS issue FROM (SELECT *, coalesce(text, '') AS t FROM documents)""")
def rendered_issues(spark, sf_dir):
    d, i = _text(spark, sf_dir), F.col("doc_id")
    span = F.when(i % 3 == 0, N.span_markdown(F.concat(F.lit("lib/"), i.cast("string"), F.lit(".dart")), (i % 10).cast("int"), (i % 7).cast("int"), F.col("t")))
    return d.select("doc_id", N.issue_markdown(F.coalesce("source", F.lit("none")), span, F.when(i % 4 == 0, "try again")).alias("issue"))


@query("""WITH d AS (SELECT doc_id, replace(coalesce(text, ''), '.' || chr(10), '.' || chr(13) || chr(10)) AS t, (doc_id % 5 + 1)::INT AS line, (doc_id % 40 + 1)::INT AS col, (doc_id % 700)::INT AS n FROM documents),
l AS (SELECT *, string_split(t, chr(10)) AS ls FROM d), b AS (SELECT *, coalesce(list_sum(list_transform(ls[1:line - 1], lambda x: length(x) + 1)), 0) AS before FROM l),
p AS (SELECT *, before + col - 1 AS start, line <= len(ls) AND col - 1 <= length(ls[line]) + CASE WHEN line < len(ls) THEN 1 ELSE 0 END AS inside FROM b),
m AS (SELECT *, start + length(substr(t, start::BIGINT + 1)) - length(ltrim(substr(t, start::BIGINT + 1), chr(13))) AS moved FROM p WHERE inside), c AS (SELECT *, rtrim(substr(t, moved::BIGINT + 1, least(n, 512, length(t) - moved)::BIGINT), chr(13)) AS shown FROM m)
SELECT doc_id, moved::INT AS start, length(shown)::INT AS length, shown AS text FROM c WHERE n > 0 AND length(shown) > 0""")
def source_spans(spark, sf_dir):
    d, i = _text(spark, sf_dir), F.col("doc_id")
    text = F.replace("t", F.lit(".\n"), F.lit(".\r\n"))
    r = d.select("doc_id", N.source_span(text, (i % 5 + 1).cast("int"), (i % 40 + 1).cast("int"), (i % 700).cast("int")).alias("s"))
    return r.where("s is not null").select("doc_id", "s.start", "s.length", "s.text")


@query("""SELECT c_custkey, '### ' || CASE c_custkey % 3 WHEN 0 THEN '[*]' WHEN 1 THEN '[~]' ELSE '[x]' END || ' ' || c_nationkey || '/30 points: ' || c_mktsegment || chr(10) || chr(10) || CASE WHEN c_custkey % 2 = 0 THEN 'body' || chr(10) ELSE '' END || CASE WHEN c_nationkey > 2 THEN 'Found ' || c_nationkey || ' issues. Showing the first 2:' || chr(10) || chr(10) ELSE '' END || '* one' || chr(10) || chr(10) || 'two' || chr(10) AS part,
CASE WHEN c_nationkey = 1 THEN 'failed' WHEN c_nationkey > 0 THEN CASE c_custkey % 3 WHEN 0 THEN 'passed' WHEN 1 THEN 'partial' ELSE 'failed' END END AS least, 'Found ' || c_nationkey || ' link' || CASE WHEN c_nationkey = 1 THEN '' ELSE 's' END || '.' || CASE WHEN c_nationkey > 2 THEN ' Showing the first 2.' ELSE '' END AS said FROM customer""")
def rendered_sections(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), F.col("c_nationkey")
    status = _kth(F.col("c_custkey") % 3, "passed", "partial", "failed")
    part = N.subsection_markdown(S.marker(status), n, F.lit(30), F.col("c_mktsegment"), F.when(F.col("c_custkey") % 2 == 0, "body").otherwise(""), F.array(F.lit("* one"), F.lit("two\n")), n)
    least = S.lower_status(S.status_rank(status), S.status_rank(F.when(n == 1, "failed").when(n > 0, "passed")))
    return c.select("c_custkey", part.alias("part"), S.status_name(least).alias("least"), S.issue_text(F.lit("link"), n, F.least(n, F.lit(2))).alias("said"))


# Manifests.
_MANIFESTS = (
    '{"name": "x"}', '{"platforms": {"web": {}, "android": null, "fuchsia": null}}', '{"flutter": {"plugin": {"platforms": {"ios": {}, "web": {"fileName": "w.dart"}}}}}',
    '{"flutter": {"plugin": {"pluginClass": "X"}}}', '{"flutter": {"plugin": {}}}', '{"platforms": {}, "flutter": {"plugin": {"platforms": {"ios": {}}}}}',
    '{"platforms": "android", "flutter": {"uses": true}}', '{"flutter": {"plugin": {"platforms": {"web": {}}, "androidPackage": 3}}}', "no JSON", '{"platforms": {"linux": {}, "macos": {}, "windows": {}}}',
)
_DECLARED = (None, "android,web", "ios,web", "android,ios", "", "", None, "web", None, "linux,macos,windows")


def _manifest():
    return _kth(F.col("p_partkey") % 10, *_MANIFESTS)


@query(f"""SELECT p_partkey, {_sql_kth("p_partkey % 10", *_DECLARED)} AS declared, p_partkey % 10 IN (2, 3, 4, 5, 7) AS plugin, p_partkey % 10 IN (3, 7) AS old_form, CASE p_partkey % 10 WHEN 2 THEN 'package:p' || p_partkey || '/w.dart' WHEN 7 THEN 'package:p' || p_partkey || '/p' || p_partkey || '_web.dart' END AS web,
p_size % 4 = 0 OR p_partkey % 10 NOT IN (0, 6, 8) AS speaks, CASE WHEN p_size % 4 > 0 THEN 'p' || p_partkey END AS package FROM part""")
def manifest_platforms(spark, sf_dir):
    p, name = table(spark, sf_dir, "part"), F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    uri = F.concat(F.when(F.col("p_size") % 4 == 0, "dart:io").otherwise(F.concat(F.lit("package:"), name, F.lit("/a.dart"))))
    d = L.declared_platforms(_manifest())
    return p.select("p_partkey", F.array_join(d, ",").alias("declared"), L.is_plugin(_manifest()).alias("plugin"), L.old_plugin_format(_manifest()).alias("old_form"), L.web_plugin_library(name, _manifest()).alias("web"), L.has_declared_platforms(uri, d).alias("speaks"), L.package_of(uri).alias("package"))


@query("""WITH e AS (SELECT p_partkey, unnest(['a', 'b', 'c', 'd']) AS name, unnest([CASE WHEN p_size % 2 = 0 THEN 'a.dart' END, 'bin/x0.dart', CASE WHEN p_size % 3 = 0 THEN 'y.dart' END, CASE WHEN p_size > 30 THEN 'd.dart' END]) AS there FROM part WHERE p_size % 5 > 0)
SELECT p_partkey, name, CASE name WHEN 'a' THEN 'a.dart' WHEN 'b' THEN 'tool.dart' WHEN 'c' THEN 'y.dart' ELSE 'd.dart' END AS file FROM e WHERE name = 'b' OR there IS NULL""")
def absent_executables(spark, sf_dir):
    """Declared programs without a file of their own in bin."""
    p = table(spark, sf_dir, "part")
    text = F.when(F.col("p_size") % 5 > 0, '{"executables": {" a ": null, "b": " tool ", "c": "y.dart", "d": ""}}').otherwise('{"executables": [1]}')
    declared = p.select("p_partkey", F.explode(L.executables(text)).alias("name", "file")).select("p_partkey", "name", L.executable_file(F.col("name"), F.col("file")).alias("file"))
    there = lambda ok, path: F.when(ok, path)
    paths = F.array_compact(F.array(there(F.col("p_size") % 2 == 0, "bin/a.dart"), F.lit("bin/sub/tool.dart"), F.lit("lib/tool.dart"), there(F.col("p_size") % 3 == 0, "bin/y.dart"), there(F.col("p_size") > 30, "bin/d.dart")))
    files = p.select("p_partkey", F.explode(paths).alias("path")).where(L.in_bin(F.col("path"))).select("p_partkey", F.substring("path", 5, 1 << 20).alias("file"))
    return declared.join(files, ["p_partkey", "file"], "left_anti").select("p_partkey", "name", "file")


_CONSTRAINTS = (">=2.12.0 <3.0.0", ">=2.0.0 <2.12.0", "^3.0.0", ">=1.20.0 <2.0.0", None, ">=2.1.0 <3.0.0", "any", ">=2.19.0 <=3.0.0")


@query(f"""WITH k AS (SELECT p_partkey, p_size % 8 AS k FROM part) SELECT p_partkey, k IN (0, 1, 2, 3, 5, 7) AS has, k IN (0, 5, 7) AS before_3, k IN (0, 1, 5, 7) AS allows_2, k IN (0, 2, 7) AS null_safe, k = 1 AS warns,
{_sql_kth("k", ">=2.12.0 <4.0.0", *_CONSTRAINTS[1:])} AS widened, {_sql_kth("k", ">=2.12.0", ">=2.0.0", ">=3.0.0", ">=1.20.0", None, ">=2.1.0", "any", ">=2.19.0")} AS open_ended FROM k""")
def sdk_constraints(spark, sf_dir):
    c = _kth(F.col("p_size") % 8, *_CONSTRAINTS)
    p = table(spark, sf_dir, "part").select("p_partkey", c.alias("c")).withColumn("f", V.sdk_flags(F.col("c")))
    return p.select("p_partkey", "f.has", "f.before_3", "f.allows_2", "f.null_safe", L.warns_of_old_constraint(F.col("f.allows_2"), F.col("f.before_3")).alias("warns"), V.widened(F.col("c")).alias("widened"), V.without_top(F.col("c")).alias("open_ended"))


_LINK = """SELECT page_id, page_id % 17 AS package, CASE WHEN page_id % 5 IN (0, 1) THEN NULL WHEN page_id % 5 = 2 THEN NULL ELSE url END AS url,
CASE WHEN page_id % 5 = 2 THEN 'not a text' WHEN page_id % 5 IN (0, 1) THEN CASE WHEN page_id % 2 = 0 THEN 'missing entry' END WHEN page_id % 3 = 0 THEN 'missing' WHEN url LIKE 'http:%' THEN 'insecure' END AS issue,
page_id % 5 > 2 AND (page_id % 3 = 0 OR url LIKE 'https:%') AS accepted FROM pages"""


def _manifest_links(spark, sf_dir):
    p, i = table(spark, sf_dir, "pages"), F.col("page_id")
    kind, url = F.when(i % 5 == 0, None).when(i % 5 == 2, "LIST").otherwise("STRING"), F.when(i % 5 > 2, F.col("url")).when(i % 5 == 1, "").when(i % 5 == 2, "[1]")
    return p.select("page_id", L.manifest_link(kind, url, i % 2 == 0, i % 3 != 0).alias("l"))


@query(f"SELECT page_id, url, issue, accepted, url IS NOT NULL AND accepted AND issue IS NULL AS verified, CASE WHEN accepted THEN url END AS shown FROM ({_LINK})")
def manifest_links(spark, sf_dir):
    return _manifest_links(spark, sf_dir).select("page_id", "l.url", "l.issue", "l.accepted", L.is_verified(F.col("l")).alias("verified"), L.accepted_url(F.col("l")).alias("shown"))


@query(f"SELECT package, coalesce(string_agg(issue, ',' ORDER BY page_id), '') AS issues, bool_or(issue IS NOT NULL AND NOT accepted) AS rejected FROM ({_LINK}) GROUP BY 1")
def package_links(spark, sf_dir):
    by = _manifest_links(spark, sf_dir).groupBy((F.col("page_id") % 17).alias("package")).agg(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "l"))), lambda x: x["l"]).alias("links"))
    return by.select("package", L.links_verdict(F.col("links")).alias("v")).select("package", F.array_join("v.issues", ",").alias("issues"), "v.rejected")


@query("""SELECT p.page_id, host, n AS pages_of_host FROM (SELECT page_id, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host FROM pages) p JOIN (SELECT regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host, count(*) AS n FROM pages GROUP BY 1) h USING (host)""")
def host_lookups(spark, sf_dir):
    """What is known of a host is looked up once for each host, whatever the rows repeat."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/?#:]+)", 1).alias("host"))
    known = p.groupBy("host").agg(F.count(F.lit(1)).alias("pages_of_host"))
    return L.looked_up(p, known.unionByName(known), ["host"])


@query("""SELECT n_regionkey, string_agg(name || '=' || href, ',' ORDER BY name) AS urls FROM (SELECT n_regionkey, left(n_name, 1) AS name, arg_max(n_name || '/', n_nationkey) AS href FROM nation WHERE n_nationkey % 3 > 0 AND n_nationkey % 7 > 0 GROUP BY ALL) GROUP BY 1""")
def library_urls(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    e = n.select("n_regionkey", "n_nationkey", (F.col("n_nationkey") % 3 > 0).alias("is_library"), F.concat(F.substring("n_name", 1, 1), F.lit(".a.b")).alias("qualified"), F.when(F.col("n_nationkey") % 7 > 0, F.concat("n_name", F.lit("/"))).alias("href"))
    return L.library_urls(e, "n_regionkey", "n_nationkey").select("n_regionkey", F.array_join(F.transform(F.map_entries("urls"), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",").alias("urls"))


@query("""SELECT p_brand, '|Package|Constraint|Compatible|Latest|Notes|' || chr(10) || '|:-|:-|:-|:-|:-|' || chr(10) || string_agg('|[`p' || p_partkey || '`]|' || CASE WHEN p_size % 3 = 0 THEN '`^' || p_size || '`' ELSE '-' END || '|' || CASE WHEN p_size % 2 = 0 THEN p_size || '.0' ELSE '-' END || '|' || CASE WHEN p_size > 40 THEN '**' || p_size || '.1**' ELSE p_size || '.1' END || '|' || CASE WHEN p_type = 'ECONOMY' THEN '**Discontinued**' ELSE '' END || '|', chr(10) ORDER BY p_partkey) AS direct,
count(*) AS n FROM part WHERE p_partkey % 7 > 0 AND p_size % 5 > 0 GROUP BY 1""")
def dependency_tables(spark, sf_dir):
    """Direct dependencies that are not the SDK's own, as a table for each brand."""
    p = table(spark, sf_dir, "part").withColumn("package", F.col("p_partkey"))
    locks = p.select("package", F.when(F.col("p_partkey") % 7 == 0, "sdk").otherwise("hosted").alias("source"))
    direct, _ = R.split_direct(L.without_sdk_packages(p, locks), p.where("p_size % 5 > 0").select("package"))
    s = F.col("p_size").cast("string")
    row = F.struct("p_partkey", F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("package"), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("^"), s)).alias("constraint"), F.when(F.col("p_size") % 2 == 0, F.concat(s, F.lit(".0"))).alias("compatible"), F.concat(s, F.lit(".1")).alias("latest"), (F.col("p_type") == "ECONOMY").alias("discontinued"), (F.col("p_size") > 40).alias("outdated"))
    by = direct.groupBy("p_brand").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return by.select("p_brand", N.dependency_table(F.col("rows")).alias("direct"), F.size("rows").cast("long").alias("n"))


@query("""SELECT p_partkey, l_linenumber || '.0.0' AS version, CASE WHEN l_linenumber % 3 = 0 THEN TIMESTAMP '1970-01-01' ELSE date_trunc('second', l_shipdate) END AS published FROM part JOIN lineitem ON l_partkey = p_partkey WHERE p_partkey % 5 > 0""")
def version_listings(spark, sf_dir):
    """Listings as a repository answers them; every fifth has a version without a name."""
    l = table(spark, sf_dir, "lineitem")
    date = F.when(F.col("l_linenumber") % 3 > 0, F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss"))
    version = F.when((F.col("l_partkey") % 5 > 0) | (F.col("l_linenumber") > 1), F.concat(F.col("l_linenumber").cast("string"), F.lit(".0.0")))
    rows = l.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.collect_list(F.struct(version.alias("version"), date.alias("published"))).alias("versions"), F.max(version.isNull()).alias("odd"))
    answers = rows.where("odd or p_partkey % 5 > 0").select("p_partkey", F.to_json(F.struct("versions")).alias("body"))
    return version_listing(answers, "p_partkey").withColumn("published", F.col("published").cast("timestamp_ntz"))


_OWN = "CASE WHEN page_id % 3 = 0 OR url LIKE 'https:%' THEN url END"


@query(f"SELECT page_id, {_OWN} AS homepage, CASE WHEN page_id % 2 = 0 THEN {_OWN} END AS repository, coalesce((page_id % 4 = 0)::INT + 1, 0) * ({_OWN} IS NOT NULL)::INT AS funding, (page_id % 160)::INT AS granted FROM pages")
def analysis_results(spark, sf_dir):
    p, i = table(spark, sf_dir, "pages"), F.col("page_id")
    link = lambda url: L.manifest_link(F.when(url.isNotNull(), "STRING"), url, F.lit(False), i % 3 != 0)
    own, none = link(F.col("url")), link(F.lit(None).cast("string"))
    r = p.select("page_id", L.analysis_result(own, link(F.when(i % 2 == 0, F.col("url"))), none, none, F.when(i % 4 == 0, F.array(own, own)).otherwise(F.array(own, none)), (i % 160).cast("int"), F.lit(160)).alias("r"))
    return r.select("page_id", "r.homepage", "r.repository", F.coalesce(F.size("r.funding"), F.lit(0)).alias("funding"), "r.granted").withColumn("funding", F.greatest("funding", F.lit(0)))


@query("""SELECT doc_id, contains(coalesce(text, ''), left(doc_id::VARCHAR, 1) || '.') AS has FROM documents""")
def changelog_versions(spark, sf_dir):
    d = _text(spark, sf_dir)
    version = F.concat(F.substring(F.col("doc_id").cast("string"), 1, 1), F.lit(".-dev+3"))
    return d.select("doc_id", H.changelog_has(F.col("t"), version).alias("has"))


@query(r"""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '<(?:a|img)\s[^>]*?(?:href|src)="[^"]*"')) AS m, unnest(range(0, len(regexp_extract_all(html, '<(?:a|img)\s[^>]*?(?:href|src)="[^"]*"')))) AS k FROM pages)
SELECT page_id, CASE WHEN starts_with(m, '<img') THEN 'image' ELSE 'link' END AS kind, replace(regexp_extract(m, '(?:href|src)="([^"]*)"', 1), '&amp;', '&') AS url, (row_number() OVER (PARTITION BY page_id, starts_with(m, '<img') ORDER BY min(k)) - 1)::INT AS ord FROM h GROUP BY page_id, starts_with(m, '<img'), m""")
def page_content(spark, sf_dir):
    """Images and links of whole pages, each once, in order."""
    found = table(spark, sf_dir, "pages").select("page_id", MD.extracted(F.col("html")).alias("c"))
    rows = lambda kind: found.select("page_id", F.lit(kind).alias("kind"), F.posexplode(f"c.{kind}s").alias("ord", "url"))
    return rows("image").unionByName(rows("link")).select("page_id", "kind", "url", "ord")


@query("""SELECT f.doc_id, coalesce('lang-' || lang, 'unknown') AS id FROM documents f LEFT JOIN (SELECT doc_id AS d, lang AS l FROM documents WHERE contains(text, '555') OR contains(text, 'license')) h ON d = f.doc_id WHERE l IS NOT NULL UNION ALL
SELECT doc_id, 'unknown' FROM documents WHERE NOT coalesce((contains(text, '555') OR contains(text, 'license')) AND lang IS NOT NULL, false)""")
def unknown_files(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    hits = d.where((F.col("text").contains("555") | F.col("text").contains("license")) & F.col("lang").isNotNull()).select("doc_id", F.concat(F.lit("lang-"), "lang").alias("id"))
    return M.with_unknown(hits, d, "doc_id", "id")


# Tags.
_TAGS = {"platform:ios": 2, "platform:android": 3, "platform:web": 5, "platform:windows": 7, "platform:macos": 4, "platform:linux": 6, "sdk:dart": 9, "sdk:flutter": 8}


@query(f"""SELECT c_custkey, {" || ', ' || ".join(f"CASE WHEN c_custkey % {_TAGS[t]} = 0 THEN '**{n}**' ELSE '{n}' END" for t, n in N.PLATFORM_NAMES.items())} AS shown,
CASE WHEN c_custkey % 9 = 0 OR c_custkey % 8 = 0 THEN 0 ELSE 1 + (CASE WHEN ({" OR ".join(f"c_custkey % {k} = 0" for t, k in _TAGS.items() if t.startswith("platform"))}) AND c_nationkey % 2 = 0 THEN 0 ELSE 1 END) END AS sdk,
1 + {" + ".join(f"(c_custkey % {k} <> 0)::INT" for t, k in _TAGS.items() if t.startswith("platform"))} AS unsupported, {" + ".join(f"(c_custkey % {k} = 0)::INT" for k in _TAGS.values())} AS trusted FROM customer""")
def explained_platforms(spark, sf_dir):
    c, i = table(spark, sf_dir, "customer"), F.col("c_custkey")
    tags = F.array_compact(F.array(*[F.when(i % k == 0, t) for t, k in _TAGS.items()]))
    notes = F.array(*[F.struct(F.lit(t).cast("string").alias("tag"), F.lit("x").alias("text")) for t in (*_TAGS, None, "runtime:native-aot", "is:other")])
    r = c.select("c_custkey", N.platform_list(tags).alias("shown"), N.explanations_shown(tags, notes, F.col("c_nationkey") % 2 == 0).alias("e"))
    return r.select("c_custkey", "shown", *[F.size(f"e.{k}").alias(k) for k in ("sdk", "unsupported", "trusted")])


@query("""WITH r AS (SELECT user_id, event_id, list_filter(['a', 'b' || event_id % 3], lambda x: event_id % 4 > 0) AS tags, list_filter(['n' || event_id % 5, 'm'], lambda x: event_id % 3 = 0) AS notes FROM events),
t AS (SELECT user_id, string_agg(DISTINCT t, ',' ORDER BY t) AS tags FROM (SELECT user_id, unnest(tags) AS t FROM r) GROUP BY 1), n AS (SELECT user_id, e, min((event_id, k)) AS place FROM (SELECT user_id, event_id, unnest(notes) AS e, unnest(range(0, len(notes))) AS k FROM r) GROUP BY ALL)
SELECT u.user_id, coalesce(any_value(t.tags), '') AS tags, coalesce(string_agg(e, ',' ORDER BY place), '') AS notes, count(e) = 0 AND any_value(t.tags) IS NOT NULL AS good FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN t USING (user_id) LEFT JOIN n USING (user_id) GROUP BY 1""")
def merged_tags(spark, sf_dir):
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    none = F.array().cast("array<string>")
    tags = F.when(i % 4 > 0, F.array(F.lit("a"), F.concat(F.lit("b"), (i % 3).cast("string")))).otherwise(none)
    notes = F.when(i % 3 == 0, F.array(F.concat(F.lit("n"), (i % 5).cast("string")), F.lit("m"))).otherwise(none)
    m = TG.merged(e.select("user_id", i.alias("ord"), tags.alias("tags"), notes.alias("explanations")), ["user_id"])
    return m.select("user_id", F.array_join("tags", ",").alias("tags"), F.array_join("explanations", ",").alias("notes"), TG.succeeded(F.col("tags"), F.col("explanations")).alias("good"))


# Packages p<key> hold one library each, which imports that of p<key / 10>, and one of the SDK by the part's size.
_PLATFORM_ROWS = [(k, p, r[-1]) for k, (p, *r) in enumerate(G.PLATFORMS)]
_LIBRARY = "CASE p_size % 4 WHEN 0 THEN 'io' WHEN 1 THEN 'html' WHEN 2 THEN 'ui' ELSE 'core' END"
_CHAIN = f"""d AS (SELECT p_partkey AS k, {_LIBRARY} AS lib, {_sql_kth("p_partkey % 10", *_DECLARED)} AS decl FROM part),
c AS (SELECT k AS root, k, 1 AS n, 'package:p' || k || '/a.dart' AS path, 'p' || k AS deps FROM d UNION ALL SELECT root, c.k // 10, n + 1, path || '>package:p' || (c.k // 10) || '/a.dart', deps || '>p' || (c.k // 10) FROM c WHERE c.k >= 10)"""


def _packages(spark, sf_dir):
    """(package, root, manifest, lib, key) and the import edges between roots."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    uri = lambda c: F.concat(F.lit("package:p"), c.cast("string"), F.lit("/a.dart"))
    own = p.select(F.concat(F.lit("p"), k.cast("string")).alias("package"), uri(k).alias("root"), _manifest().alias("manifest"), _kth(F.col("p_size") % 4, "io", "html", "ui", "core").alias("lib"), k.alias("key"))
    up = F.floor(k / 10).cast("long")
    return own, p.where(k >= 10).select(uri(k).alias("src"), uri(up).alias("dst"))


_RUNTIMES = "o AS (SELECT * FROM (VALUES " + ", ".join(f"('{r}', '{x}')" for r, libs in (G.RUNTIMES | G.BROAD_RUNTIMES).items() for x in libs if x in ("io", "html", "ui", "core")) + ") v(runtime, lib))"


@query(f"""WITH RECURSIVE {_CHAIN}, {_RUNTIMES}, w AS (SELECT * FROM (VALUES {", ".join(f"('{p}', '{r}')" for _, p, r in _PLATFORM_ROWS)}) v(platform, runtime)),
x AS (SELECT root, n, path, platform, runtime, decl, lib, decl IS NOT NULL AND NOT list_contains(string_split(decl, ','), platform) AS bad_d, NOT EXISTS (SELECT 1 FROM o WHERE o.runtime = w.runtime AND o.lib = d.lib) AS bad_r, bool_or(decl IS NOT NULL) OVER (PARTITION BY root, platform ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS beyond FROM c JOIN d USING (k), w),
f AS (SELECT root, platform, arg_min(path, n) FILTER (bad_d) AS dp, arg_min(path, n) FILTER (bad_r) AS rp, bool_or((bad_d OR bad_r) AND NOT coalesce(beyond, false)) AS pruned FROM x GROUP BY ALL)
SELECT 'p' || root AS package, platform, CASE WHEN dp IS NOT NULL THEN 'declared ' || dp WHEN rp IS NOT NULL THEN 'imported ' || rp END AS reason, NOT pruned AS tagged FROM f""")
def platform_verdicts(spark, sf_dir):
    """Why a platform does not hold for a package, and whether it is tagged all the same, as packages that declare their
    platforms are trusted."""
    own, edges = _packages(spark, sf_dir)
    platforms = spark.createDataFrame([(p, r) for _, p, r in _PLATFORM_ROWS], "platform string, runtime string")
    roots, said = own.select("root"), TG.declared(own)
    libraries, targets = own.select("package", "root", F.lit(0).alias("ord")), own.select("package").crossJoin(F.broadcast(platforms.select("platform")))  # six platforms
    imports, enabled = own.select(F.col("root").alias("node"), "lib"), G.runtime_table(spark)

    def verdicts(trusted):
        reached = TG.reached_libraries(edges, roots, trusted)
        shown = F.array_join("path", ">")
        declared = TG.declared_violations(reached, said, platforms.select("platform")).select("root", "platform", F.concat(F.lit("declared "), shown).alias("reason"))
        bad = TG.runtime_violations(reached, imports, enabled, platforms.select("runtime").distinct()).join(F.broadcast(platforms), "runtime").select("root", "platform", F.concat(F.lit("imported "), shown).alias("reason"))
        none = declared.withColumnRenamed("root", "package").limit(0)
        return TG.first_violation(libraries, none, declared, bad, ["platform"], targets)

    trusted = TG.leaves(own.select(F.col("root").alias("node")), said)
    pruned = verdicts(trusted).select("package", "platform", F.lit(False).alias("holds"))
    return targets.join(verdicts(None), ["package", "platform"], "left").join(pruned, ["package", "platform"], "left").select("package", "platform", "reason", F.coalesce("holds", F.lit(True)).alias("tagged"))


@query(f"""WITH RECURSIVE {_CHAIN}, {_RUNTIMES}, w AS (SELECT * FROM (VALUES ('dart', ['dart']), ('flutter', ['dart', 'flutter'])) v(sdk, allowed)), n AS (SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 1 THEN ['flutter'] WHEN 2 THEN ['fuchsia', 'flutter'] ELSE [] END AS sdks FROM part),
b AS (SELECT root, sdk, deps, n, array_to_string(list_sort(list_filter(list_distinct(list_append(sdks, 'dart')), lambda x: NOT list_contains(allowed, x))), ', ') AS beyond FROM c JOIN n USING (k), w), f AS (SELECT root, sdk, arg_min(deps, n) AS deps, arg_min(beyond, n) AS beyond FROM b WHERE beyond <> '' GROUP BY ALL),
i AS (SELECT root, sdk, arg_min(path, n) AS path FROM c JOIN d USING (k), w WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.runtime = w.sdk AND o.lib = d.lib) GROUP BY ALL)
SELECT 'p' || p.k AS package, w.sdk, CASE WHEN f.deps IS NOT NULL THEN 'Because:' || chr(10) || '* `' || replace(f.deps, '>', '` that depends on:' || chr(10) || '* `') || '` that is a package requiring ' || beyond || '.' WHEN i.path IS NOT NULL THEN 'Because:' || chr(10) || '* `' || replace(i.path, '>', '` that imports:' || chr(10) || '* `') || '`' END AS reason
FROM d p CROSS JOIN w LEFT JOIN f ON f.root = p.k AND f.sdk = w.sdk LEFT JOIN i ON i.root = p.k AND i.sdk = w.sdk""")
def sdk_verdicts(spark, sf_dir):
    own, edges = _packages(spark, sf_dir)
    allowed = spark.createDataFrame([("dart", ["dart"]), ("flutter", ["dart", "flutter"])], "sdk string, allowed array<string>")
    sdks = spark.createDataFrame([("dart", "dart"), ("flutter", "flutter")], "sdk string, runtime string")
    name = lambda c: F.regexp_extract(c, "^package:([^/]+)", 1)
    depends = edges.select(name("src").alias("src"), name("dst").alias("dst"))
    needs = F.when(F.col("key") % 6 == 1, F.array(F.lit("flutter"))).when(F.col("key") % 6 == 2, F.array(F.lit("fuchsia"), F.lit("flutter"))).otherwise(F.array().cast("array<string>"))
    declared = TG.sdk_violations(G.reach(depends, own.select(F.col("package").alias("root"))), own.select(F.col("package").alias("node"), needs.alias("sdks")), allowed)
    reached = TG.reached_libraries(edges, own.select("root"))
    runtimes = G.runtime_table(spark, G.BROAD_RUNTIMES).where("runtime in ('dart', 'flutter')")
    bad = TG.runtime_violations(reached, own.select(F.col("root").alias("node"), "lib"), runtimes, sdks.select("runtime"))
    return TG.sdk_verdicts(own, declared, own.select("package", "root", F.lit(0).alias("ord")), bad, sdks)


@query(f"""WITH RECURSIVE {_CHAIN}, {_RUNTIMES}, b AS (SELECT DISTINCT root FROM c JOIN d USING (k) WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.runtime = 'wasm' AND o.lib = d.lib))
SELECT 'p' || k AS package, NOT EXISTS (SELECT 1 FROM b WHERE b.root = d.k) AND NOT (k % 10 IN (2, 7) AND k % 4 = 0) AS ready FROM d""")
def wasm_verdicts(spark, sf_dir):
    own, edges = _packages(spark, sf_dir)
    web = TG.web_libraries(own, own.where("key % 4 <> 1").select(L.web_plugin_library(F.col("package"), F.col("manifest")).alias("root")))
    html = web.join(own.select("package", "key"), "package").select(F.col("root").alias("node"), F.when(F.col("key") % 4 == 0, "html").otherwise("core").alias("lib"))
    roots = own.select("root").unionByName(web.select("root"))
    imports = own.select(F.col("root").alias("node"), "lib").unionByName(html)
    runtimes = G.runtime_table(spark).where("runtime = 'wasm'")
    bad = TG.runtime_violations(TG.reached_libraries(edges, roots), imports, runtimes, runtimes.select("runtime").distinct())
    return TG.wasm_ready(own, own.select("package", "root"), web, bad)


@query("""WITH l AS (SELECT doc_id, coalesce(source, '') || '/' || (doc_id // 2) AS package, doc_id % 50 AS age FROM documents)
SELECT package FROM (SELECT package, max(doc_id) AS best FROM l WHERE age <= 40 GROUP BY package ORDER BY best DESC, package LIMIT 2000)""")
def paged_names(spark, sf_dir):
    """The first 2,000 names that are not too old, out of a listing of documents by falling id, saved in pages of 500."""
    d = table(spark, sf_dir, "documents")
    name = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.floor(F.col("doc_id") / 2).cast("string"))
    listed = numbered(d.select("doc_id", name.alias("package")), [F.desc("doc_id"), F.asc("package")], "place")
    entry = F.struct("place", "package")
    page = listed.groupBy(F.floor((F.col("place") - 1) / 500 + 1).cast("int").alias("page")).agg(F.array_sort(F.collect_list(entry)).alias("packages"))  # 500 entries
    path = scratch_path(spark, "pages")
    page.select("page", F.to_json(F.struct(F.transform("packages", lambda x: F.struct(x["package"].alias("package"))).alias("packages"))).alias("value")).write.partitionBy("page").text(path)
    ages = d.select(name.alias("package"), F.col("doc_id").alias("of_doc")).where("of_doc % 50 <= 40").select("package").distinct()
    return selected(spark, path, 2000, lambda names: names.join(ages, "package", "left_semi"))
