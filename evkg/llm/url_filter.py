"""URL filters: rules by host and path, and redirect equivalence.

A rule fits its host and all subdomains if the path starts with the rule's path; of several the longest
wins.  Pages that redirect (meta refresh) or name canonical links are joined with each of their targets; urls that
differ only in scheme, ``www.``, fragment or last slashes are one node.  Distributed connected components over these
edges carry decisions to aliases: a page that no rule fits is blocked if a page of its component is blocked
by a rule and none is allowed by one.  An explicit allow comes first.

Defined results: a null url, or one without ``://``, has empty host and path, no rule, and is allowed; all links
of a page count, relative ones are resolved against its url (folder, ``.`` and ``..``, query or fragment alone); links
of a page without a host, and empty ones, are ignored; null html has no links; repeated rows are judged each; an empty
table gives an empty one; other columns are ignored; long urls and pages are read whole, and each link of a page is
resolved against its whole url, so that work grows with links times the length of the url.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, table
from .graph import connected_components

#: ``(verdict, host, path)``
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_QUERY = r"(?s)^.*?://[^?#]*(\?[^#]*)"
#: Tags that may declare a link, what makes them one, and the link; the attribute order is free.
_LINKS = (
    (r"(?is)<link\b[^>]*>", r"""(?is)\brel\s*=\s*["']?canonical\b""", r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""),
    (r"(?is)<meta\b[^>]*>", r"""(?is)\bhttp-equiv\s*=\s*["']?refresh\b""", r"""(?is)\burl\s*=\s*["']?([^"'\s>;]+)"""),
)


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def key_of(url: Column) -> Column:
    """The node of an absolute url: host without ``www.``, path without last slashes, and query; null without a host."""
    host, query = host_of(url), F.coalesce(F.regexp_extract(url, _QUERY, 1), F.lit(""))
    return F.when(host != "", F.concat(F.regexp_replace(host, "^www\\.", ""), F.regexp_replace(path_of(url), "/+$", ""), query))


def declared(html: Column) -> Column:
    """All links that a page declares, as they stand in it."""
    every = [F.transform(F.filter(F.regexp_extract_all(html, F.lit(tag), F.lit(0)), lambda t: F.rlike(t, F.lit(mark))), lambda t: F.regexp_extract(t, link, 1)) for tag, mark, link in _LINKS]  # noqa: B023
    return F.filter(F.concat(*every), lambda x: x != "")


def resolve(link: Column, url: Column) -> Column:
    """An absolute url of a link on the page ``url``."""
    host, path, query = host_of(url), path_of(url), F.regexp_extract(url, _QUERY, 1)
    root = F.concat(F.lit("http://"), host)
    tail = F.regexp_extract(link, r"(?s)([?#].*)$", 1)
    at = F.regexp_replace(link, r"(?s)[?#].*$", "")
    whole = F.when(F.startswith(at, F.lit("/")), at).otherwise(F.concat(F.regexp_replace(path, "[^/]*$", ""), at))
    whole = F.when(F.startswith(whole, F.lit("/")), whole).otherwise(F.concat(F.lit("/"), whole))
    parts = F.split(F.substring(whole, 2, 2_147_483_647), "/", -1)
    folder = F.element_at(parts, -1).isin(".", "..")
    none = F.array().cast("array<string>")
    kept = F.aggregate(parts, none, lambda a, x: F.when(x == ".", a).when(x == "..", F.when(F.size(a) > 0, F.slice(a, 1, F.size(a) - 1)).otherwise(none)).otherwise(F.concat(a, F.array(x))))
    plain = F.concat(root, F.lit("/"), F.array_join(kept, "/"), F.when(folder & (F.size(kept) > 0), "/").otherwise(""), tail)
    # A scheme ends at the first colon before any slash; ``mailto:`` and the like name no page.
    scheme = F.rlike(link, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:"))
    out = F.when(F.rlike(link, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://")), link).when(scheme, F.lit(None)).when(F.startswith(link, F.lit("//")), F.concat(F.lit("http:"), link))
    return F.when(host != "", out.when(F.startswith(link, F.lit("?")), F.concat(root, path, link)).when(F.startswith(link, F.lit("#")), F.concat(root, path, query, link)).otherwise(plain))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def edges(pages: DataFrame) -> DataFrame:
    """``(a, b)``: nodes of pages and of what they redirect to or call canonical."""
    links = pages.where("html IS NOT NULL").select("url", F.explode(declared(F.col("html"))).alias("to"))
    return links.select(key_of(F.col("url")).alias("a"), key_of(resolve(F.col("to"), F.col("url"))).alias("b"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES) -> DataFrame:
    """``(page_id, host, path, rule, verdict)``, a row for each row of ``pages``."""
    src = pick(pages, page_id=id_col, url=url_col, html=html_col).withColumn("html", F.col("html").cast("string"))
    base = src.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), key_of(F.col("url")).alias("key"))
    # A page without a host is a node by itself, so such pages don't meet in one task.
    alone = F.concat(F.lit("\n"), F.xxhash64("page_id", "path").cast("string"))
    marked = base.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).withColumn("key", F.coalesce("key", alone))
    roots = connected_components(edges(src))
    named = marked.join(roots.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    said = F.col("r.verdict")
    blocked = named.groupBy("root").agg(F.max(said == "block").alias("b"), F.max(said == "allow").alias("a")).where("b AND NOT coalesce(a, false)").select(F.col("root").alias("bad"))
    out = named.join(blocked, F.col("root") == F.col("bad"), "left")
    verdict = F.coalesce(said, F.when(F.col("bad").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"))


_PARSE = r"CASE WHEN contains({u}, '://') THEN regexp_extract({u}, '(?s)^.*?://([^/?#]*)([^?#]*)', {i}) ELSE '' END"
_HOST = "coalesce(translate(" + _PARSE.replace("{i}", "1") + f", '{_UPPER}', '{_LOWER}'), '')"
_PATH = "coalesce(" + _PARSE.replace("{i}", "2") + ", '')"
_KEY = f"CASE WHEN {_HOST} <> '' THEN regexp_replace({_HOST}, '^www\\.', '') || regexp_replace({_PATH}, '/+$', '') || regexp_extract({{u}}, '(?s)^.*?://[^?#]*(\\?[^#]*)', 1) END"


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


_EACH = " UNION ALL ".join(
    f"SELECT url, regexp_extract(t, '{_sql(link)}', 1) AS l FROM (SELECT url, unnest(regexp_extract_all(html, '{_sql(tag)}')) AS t FROM pages) WHERE regexp_matches(t, '{_sql(mark)}')" for tag, mark, link in _LINKS
)
#: DuckDB.  Links are resolved where they are absolute or begin with a slash, as all links of the tables are that there may be;
#: the reachable nodes of each node come from a recursive query.
ORACLE = f"""
WITH RECURSIVE p AS (SELECT page_id, {_HOST.format(u="url")} AS host, {_PATH.format(u="url")} AS path, {_KEY.format(u="url")} AS key FROM pages),
l AS (SELECT {_KEY.format(u="url")} AS a, CASE WHEN l LIKE '//%' THEN 'http:' || l WHEN l LIKE '/%' THEN 'http://' || {_HOST.format(u="url")} || l ELSE l END AS l FROM ({_EACH}) WHERE l <> ''),
e AS (SELECT a, {_KEY.format(u="l")} AS b FROM l),
both_ AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
reach(a, b) AS (SELECT a, b FROM both_ UNION SELECT r.a, x.b FROM reach r JOIN both_ x ON r.b = x.a),
roots AS (SELECT a, least(a, min(b)) AS root FROM reach GROUP BY a),
k AS (SELECT p.*, coalesce(root, key) AS root FROM p LEFT JOIN roots ON a = key),
rules(verdict, h, pre) AS (VALUES {", ".join(str(r) for r in RULES)}),
fit AS (SELECT page_id, host, path, h || pre AS rule, verdict, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(h || pre) DESC) AS n
        FROM (SELECT DISTINCT page_id, host, path FROM k) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre)),
m AS (SELECT k.*, f.rule, f.verdict FROM k LEFT JOIN fit f ON f.page_id = k.page_id AND f.host = k.host AND f.path = k.path AND f.n = 1),
c AS (SELECT root FROM m WHERE root IS NOT NULL GROUP BY root HAVING bool_or(verdict = 'block') AND NOT coalesce(bool_or(verdict = 'allow'), false))
SELECT m.page_id, m.host, m.path, m.rule, coalesce(m.verdict, CASE WHEN c.root IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM m LEFT JOIN c ON c.root = m.root
"""


def query(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
