"""URL filtering with redirect equivalence (operator 10, DataFrame functions only).

``judge`` applies host-and-path rules to URLs, then carries block decisions along
redirect and canonical-link edges: aliases of one resource form a connected
component, and a URL that no rule names takes the decision of its component.

Precedence
    1. a URL's own rule (longest rule text that fits; block wins a tie in length);
    2. an explicit allow anywhere in its component;
    3. a block anywhere in its component;
    4. allow.

Edges come from what pages declare (``page_links``): ``<link rel=canonical>`` and
``<meta http-equiv=refresh>``, resolved against the page's URL or its ``<base>``, quoted
or not, with entities decoded and without fragments; of several tags of a kind the first
that is no comment counts. A crawl that keeps no redirects
loses those between the spellings under which a site answers (http and https, ``www.``,
tracking parameters); for such tables ``spelling=True`` adds an edge from each URL to
its canonical spelling, in place of the redirect that was not recorded.

Edge cases: a null URL, or one without ``://``, has empty host and path, meets no
rule, has no aliases and is allowed. Equal URLs share one node and each keeps its
own row. Columns of the input other than id and URL are not read, so clashing
names do no harm. Empty tables give empty results. Long URLs are ordinary.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, lookup, table

#: (verdict, host, path)
Rule = tuple[str, str, str]
RULES: list[Rule] = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest fitting rule as struct(verdict, rule), or null.

    Rules are few and part of the job's parameters, so they become one expression.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block"))
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in reversed(ordered):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def canonical_url(url: Column) -> Column:
    """A URL's canonical spelling: https, lower-cased host without ``www.`` and ``m.``, no fragment,
    no tracking parameters, no ``.html`` and no closing slash."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"/+$", ""), r"\.html?$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_\w+|ref|fbclid|gclid)="))), "&")
    return F.when(host_of(url) != "", F.concat(F.lit("https://"), host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


#: The entities that stand in link targets.
ENTITIES = {"&amp;": "&", "&#38;": "&", "&#x26;": "&", "&#47;": "/", "&#x2f;": "/", "&#x2F;": "/", "&#58;": ":", "&#x3a;": ":", "&#x3A;": ":"}


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute, quoted or not; empty if there is none."""
    return F.regexp_extract(tag, rf"(?is)[\s\"'/]{name}\s*=\s*[\"']?\s*([^\"'>\s]+)", 1)


def _decoded(target: Column) -> Column:
    for entity, sign in ENTITIES.items():
        target = F.replace(target, F.lit(entity), F.lit(sign))
    return target


def _plain_path(path: Column) -> Column:
    """Without the segments ``.`` and ``..``."""
    def step(done: Column, segment: Column) -> Column:
        kept = F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done)
        return F.when(segment == "..", kept).when(segment == ".", done).otherwise(F.concat(done, F.array(segment)))

    parts = F.split(path, "/")
    folded = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.array(F.lit("")), step)
    ends = F.when(path.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit(""))
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.array_join(folded, "/"), ends)).otherwise(path)


def resolved(target: Column, base: Column) -> Column:
    """The URL that ``target``, a link on the page ``base``, stands for, without its fragment; null if it leads nowhere else."""
    t = F.regexp_replace(target, r"#.*$", "")
    scheme, origin = F.regexp_extract(base, r"^([^:/?#]+):", 1), F.regexp_extract(base, r"(?s)^([^:/?#]+://[^/?#]*)", 1)
    path = F.regexp_extract(t, r"(?s)^([^?]*)", 1)
    query = F.regexp_extract(t, r"(?s)(\?.*)$", 1)
    folder = F.concat(F.regexp_extract(path_of(base), r"(?s)^(.*)/", 1), F.lit("/"))
    out = F.when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), t).when(t.startswith("//"), F.concat(scheme, F.lit(":"), t))
    out = out.when(t.startswith("/"), F.concat(origin, _plain_path(path), query)).when(t.startswith("?"), F.concat(origin, path_of(base), t))
    return F.when((t != "") & (origin != ""), out.otherwise(F.concat(origin, _plain_path(F.concat(folder, path)), query)))


def page_links(pages: DataFrame, url: str = "url", html: str = "html", spelling: bool = False) -> DataFrame:
    """Alias edges (src, dst) of crawled pages: declared ones, and with ``spelling`` those to the canonical spelling."""
    body = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"(?s)<!--.*?-->", "")
    link = F.regexp_extract(body, r"(?is)(<link\b[^>]*\srel\s*=\s*[\"']?canonical\b[^>]*>)", 1)
    meta = F.regexp_extract(body, r"(?is)(<meta\b[^>]*\shttp-equiv\s*=\s*[\"']?refresh\b[^>]*>)", 1)
    refresh = F.regexp_extract(meta, r"(?is)url\s*=\s*[\"']?\s*([^\"'>\s]+)", 1)
    based = _attribute(F.regexp_extract(body, r"(?is)(<base\b[^>]*>)", 1), "href")
    rows = pages.select(
        F.col(url).alias("src"),
        _decoded(based).alias("base"),
        _decoded(_attribute(link, "href")).alias("link"),
        _decoded(refresh).alias("refresh"),
    )
    base = F.when(F.col("base") != "", F.coalesce(resolved(F.col("base"), F.col("src")), "src")).otherwise(F.col("src"))
    targets = [resolved(F.col(c), F.col("base")) for c in ("link", "refresh")] + [canonical_url(F.col("src"))] * spelling
    out = rows.withColumn("base", base).select("src", F.explode(F.array(*targets)).alias("dst"))
    return out.filter(F.col("dst").contains("://") & F.col("src").contains("://") & (F.col("src") != F.col("dst")))


def judge(urls: DataFrame, edges: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``urls``: id, host, path, rule, verdict, component.

    ``edges`` (src, dst) are redirects and canonical links between URLs. Nodes are
    128-bit digests of the URLs. A URL in no edge is its own component.
    """
    node = F.md5(F.col(url_col))
    rows = urls.select(
        F.col(id_col).alias("id"),
        host_of(F.col(url_col)).alias("host"),
        path_of(F.col(url_col)).alias("path"),
        F.when(F.col(url_col).contains("://"), node).alias("node"),
    )
    rows = rows.withColumn("hit", rule_for(F.col("host"), F.col("path"), rules))
    edges = cut(edges.select("src", "dst"), "alias-links")  # read twice, and pages are long
    links = edges.select(F.md5("src").alias("a"), F.md5("dst").alias("b"))
    comp = cut(components(links, "alias-edges"), "alias-components")
    # what the rules say of each node; link targets count even where they have no row
    named = edges.select(F.explode(F.array("src", "dst")).alias("u"))
    named = named.select(F.md5("u").alias("node"), rule_for(host_of(F.col("u")), path_of(F.col("u")), rules)["verdict"].alias("v")).filter(
        F.col("v").isNotNull(),
    )
    said = named.groupBy("node").agg(F.max(F.col("v") == "allow").alias("allows"))
    # a component may hold a third of all nodes
    by_comp = comp.join(said, "node", "left").groupBy("component").agg(F.max("allows").alias("allows"), F.count(F.lit(1)).alias("members"))
    decided = lookup(comp, cut(by_comp, "alias-decisions"), "component", "members", "inner")
    inherited = F.when(F.col("allows"), "allow").when(~F.col("allows"), "block").alias("inherited")
    decided = decided.select("node", "component", inherited)
    seen = rows.filter(F.col("node").isNotNull()).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    per_node = cut(decided.join(seen, "node"), "alias-verdicts")
    out = lookup(rows, per_node, "node", "n")
    return out.select(
        F.col("id").alias(id_col), "host", "path", F.col("hit")["rule"].alias("rule"),
        F.coalesce(F.col("hit")["verdict"], F.col("inherited"), F.lit("allow")).alias("verdict"),
        F.coalesce("component", "node").alias("component"),
    )


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(pages, page_links(pages)).select("page_id", "host", "path", "rule", "verdict")


def _rule_sql(host: str, path: str) -> str:
    ordered = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[0] != "block"))
    whens = " ".join(f"WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}') THEN '{v} {h}{p}'" for v, h, p in ordered)
    return f"CASE {whens} END"


def _host_sql(url: str) -> str:
    return rf"coalesce(translate(regexp_extract({url}, '^.*?://([^/?#]*)', 1, 's'), '{_UPPER}', '{_LOWER}'), '')"


def _path_sql(url: str) -> str:
    return rf"coalesce(regexp_extract({url}, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '')"


_HREF_SQL = r"""[\s"''/]href\s*=\s*["'']?\s*([^"''>\s]+)"""
_REFRESH_SQL = r"""url\s*=\s*["'']?\s*([^"''>\s]+)"""


def _found_sql(tag: str, pattern: str) -> str:
    target = f"regexp_extract({tag}, '{pattern}', 1, 'is')"
    for entity, sign in ENTITIES.items():
        target = f"replace({target}, '{entity}', '{sign}')"
    return target


def _resolved_sql(target: str, base: str) -> str:
    """resolved(), for targets without the segments ``.`` and ``..``."""
    t, origin = f"regexp_replace({target}, '#.*$', '')", f"regexp_extract({base}, '^([^:/?#]+://[^/?#]*)', 1, 's')"
    folder = f"regexp_extract({_path_sql(base)}, '^(.*)/', 1, 's') || '/'"
    return rf"""CASE WHEN {t} = '' OR {origin} = '' THEN NULL WHEN regexp_matches({t}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {t}
      WHEN starts_with({t}, '//') THEN regexp_extract({base}, '^([^:/?#]+):', 1) || ':' || {t} WHEN starts_with({t}, '/') THEN {origin} || {t}
      WHEN starts_with({t}, '?') THEN {origin} || {_path_sql(base)} || {t} ELSE {origin} || {folder} || {t} END"""


ORACLE_SQL = rf"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html, {_host_sql('url')} AS host, {_path_sql('url')} AS path FROM pages
), plain AS (
  SELECT *, regexp_replace(coalesce(html, ''), '<!--.*?-->', '', 'gs') AS body FROM p
), declared AS (
  SELECT *, regexp_extract(body, '(<link\b[^>]*\srel\s*=\s*["'']?canonical\b[^>]*>)', 1, 'is') AS link,
    regexp_extract(body, '(<meta\b[^>]*\shttp-equiv\s*=\s*["'']?refresh\b[^>]*>)', 1, 'is') AS meta,
    regexp_extract(body, '(<base\b[^>]*>)', 1, 'is') AS basis
  FROM plain
), named AS (
  SELECT url, host, {_found_sql('basis', _HREF_SQL)} AS basis, {_found_sql('link', _HREF_SQL)} AS link,
    {_found_sql('meta', _REFRESH_SQL)} AS refresh
  FROM declared
), placed AS (
  SELECT *, CASE WHEN basis <> '' THEN coalesce({_resolved_sql('basis', 'url')}, url) ELSE url END AS base FROM named
), targets AS (
  SELECT url AS src, unnest([{_resolved_sql('link', 'base')}, {_resolved_sql('refresh', 'base')}]) AS dst
  FROM placed
), edges AS (
  SELECT DISTINCT src, dst FROM targets WHERE contains(dst, '://') AND contains(src, '://') AND src <> dst
), both_ways AS (
  SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges
), reach AS (
  SELECT a AS root, a AS node FROM both_ways UNION SELECT r.root, e.b FROM reach r JOIN both_ways e ON r.node = e.a
), ruled AS (
  SELECT node, {_rule_sql(_host_sql('node'), _path_sql('node'))} AS hit FROM (SELECT DISTINCT a AS node FROM both_ways)
), said AS (
  SELECT r.root, CASE WHEN bool_or(starts_with(x.hit, 'allow')) THEN 'allow' WHEN bool_or(starts_with(x.hit, 'block')) THEN 'block' END AS v
  FROM reach r JOIN ruled x ON r.node = x.node GROUP BY r.root
), own AS (
  SELECT *, {_rule_sql('host', 'path')} AS hit FROM p
)
SELECT o.page_id, o.host, o.path, nullif(substr(o.hit, 7), '') AS rule, coalesce(substr(o.hit, 1, 5), s.v, 'allow') AS verdict
FROM own o LEFT JOIN said s ON o.url = s.root
"""
