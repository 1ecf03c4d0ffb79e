"""The link checks over a site that is made of the given pages, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import links as op
from tessera.plans.lenses import read

PREFIX = "/site/"
#: Addresses that pages add to their own: of each kind of mistake one, and right ones.
ADDED = [
    "#", "http://example.com/x", "ftp://example.com/x", "mailto:a@example.com", "#s1", "#nope", "/site/f/p3.html", "/elsewhere", "../../../up.html", "./p6.html#s1", "p7.html?day=1,2&amp;q=anything", "p7.html?day=9&amp;zz=1",
    "../d17/", "x.html#s1", "p6.html?day=1", "/site/index.html?view=list#s0", "/site/index.html?view=tree", "?day=1", "p7.html?day=", "/site/", "https://example.com/", "p7.html?zz=1&amp;day=2", "caf%C3%A9.html", "../f/./../f/p3.html#s%33",
]
PARAMS = [("f/p7.html", "day", "list"), ("f/p7.html", "q", "any"), ("index.html", "view", "one")]
VALUES = [("f/p7.html", "day", "1"), ("f/p7.html", "day", "2"), ("f/p7.html", "day", "3"), ("index.html", "view", "list"), ("index.html", "view", "map")]


def site(s, d):
    """Pages at three depths, some of them folders; each has an anchor and two of the added addresses beside its own."""
    k = F.col("page_id")
    path = F.when(k == 0, "index.html").when(k % 17 == 0, F.concat(F.lit("d"), k, F.lit("/index.html"))).when(k % 3 == 0, F.concat(F.lit("f/p"), k, F.lit(".html"))).when(k % 3 == 1, F.concat(F.lit("f/g/p"), k, F.lit(".html"))).otherwise(F.concat(F.lit("p"), k, F.lit(".html")))
    path = F.when(k.isin(6, 7), F.concat(F.lit("f/p"), k, F.lit(".html"))).otherwise(path)
    added = F.array(*map(F.lit, ADDED))
    more = F.concat(F.lit('<i id="s'), k % 5, F.lit('"></i><!-- <a href="#">x</a> --><a class="x" href="'), F.get(added, (k % len(ADDED)).cast("int")), F.lit("\">x</a><a href='"), F.get(added, (k * 7 % len(ADDED)).cast("int")), F.lit("'>y</a>"))
    return read(s, d, "pages").select(path.alias("path"), F.concat("html", more).alias("html"))


def problems(s, d):
    params, values = s.createDataFrame(PARAMS, "path string, key string, rule string"), s.createDataFrame(VALUES, "path string, key string, value string")
    return op.link_problems(site(s, d), params, values, PREFIX)


def _rows(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows)


SQL = rf"""WITH s AS (SELECT page_id AS k, html, CASE WHEN page_id = 0 THEN 'index.html' WHEN page_id IN (6, 7) THEN 'f/p' || page_id || '.html' WHEN page_id % 17 = 0 THEN 'd' || page_id || '/index.html' WHEN page_id % 3 = 0 THEN 'f/p' || page_id || '.html'
  WHEN page_id % 3 = 1 THEN 'f/g/p' || page_id || '.html' ELSE 'p' || page_id || '.html' END AS path, 's' || (page_id % 5) AS anchor, {[a.replace('&amp;', '&') for a in ADDED]} AS added FROM pages),
 h AS (SELECT path, unnest(list_concat(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1), [added[k % {len(ADDED)} + 1], added[k * 7 % {len(ADDED)} + 1]])) AS href, generate_subscripts(list_concat(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1), ['', '']), 1) - 1 AS ord FROM s),
 b AS (SELECT *, regexp_extract(href, '^([^?#]*)', 1) AS bare, nullif(regexp_extract(href, '#(.*)$', 1), '') AS fragment, CASE WHEN regexp_matches(href, '^[^#]*\?') THEN regexp_extract(href, '^[^?#]*\?([^#]*)', 1) END AS query FROM h WHERE NOT regexp_matches(href, '^(https:|mailto:|tel:)')),
 w AS (SELECT *, CASE WHEN bare = '' THEN path WHEN starts_with(bare, '/') THEN substr(bare, {len(PREFIX) + 1}) ELSE regexp_replace(path, '[^/]*$', '') || bare END AS whole FROM b),
 c AS (SELECT *, array_to_string(list_reduce(list_prepend([]::VARCHAR[], list_transform(string_split(whole, '/'), lambda x: [x])), lambda a, x: CASE WHEN x[1] IN ('', '.') THEN a WHEN x[1] = '..' AND len(a) > 0 AND a[len(a)] <> '..' THEN list_slice(a, 1, len(a) - 1) ELSE list_concat(a, x) END), '/') AS clean FROM w),
 t AS (SELECT *, CASE WHEN (clean = '' OR regexp_matches(whole, '(^|/)\.{{0,2}}$')) AND NOT regexp_matches(clean, '(^|/)\.\.$') THEN CASE WHEN clean = '' THEN 'index.html' ELSE clean || '/index.html' END ELSE clean END AS target FROM c),
 l AS (SELECT *, CASE WHEN href = '#' THEN 'nowhere' WHEN starts_with(href, 'http:') THEN 'insecure' WHEN regexp_matches(href, '^[a-z][a-z0-9+.-]*:') THEN 'scheme' WHEN starts_with(bare, '/') AND NOT starts_with(bare, '{PREFIX}') THEN 'outside' WHEN starts_with(target, '..') THEN 'climbs' END AS problem FROM t),
 pr AS (SELECT * FROM (VALUES {_rows(PARAMS)}) x(path, key, rule)), va AS (SELECT * FROM (VALUES {_rows(VALUES)}) x(path, key, value)),
 q AS (SELECT path, ord, target, string_split(p, '=')[1] AS key, coalesce(string_split(p, '=')[2], '') AS value FROM (SELECT path, ord, target, unnest(list_filter(string_split(query, '&'), lambda p: p <> '')) AS p FROM l WHERE problem IS NULL AND query IS NOT NULL AND ends_with(target, '.html'))),
 v AS (SELECT q.path, q.ord, q.target, q.key, q.value, unnest(CASE WHEN rule = 'list' THEN string_split(value, ',') ELSE [value] END) AS word FROM q JOIN pr ON pr.path = q.target AND pr.key = q.key WHERE rule <> 'any') ,
 a AS (SELECT path, ord, href, problem AS kind, '' AS detail, 1 AS rank FROM l WHERE problem IS NOT NULL
  UNION ALL SELECT path, ord, href, 'broken', target, 2 FROM l WHERE problem IS NULL AND target NOT IN (SELECT path FROM s)
  UNION ALL SELECT path, ord, href, 'no query', target, 3 FROM l WHERE problem IS NULL AND query IS NOT NULL AND ends_with(target, '.html') AND target NOT IN (SELECT path FROM pr)
  UNION ALL SELECT path, ord, '', 'unknown key', min(key), 4 FROM q WHERE target IN (SELECT path FROM pr) AND (target, key) NOT IN (SELECT (path, key) FROM pr) GROUP BY path, ord
  UNION ALL SELECT path, ord, '', 'bad value', min(key || '=' || value), 5 FROM v WHERE (target, key, word) NOT IN (SELECT (path, key, value) FROM va) GROUP BY path, ord
  UNION ALL SELECT path, ord, href, 'no anchor', replace(fragment, '%33', '3'), 6 FROM l WHERE problem IS NULL AND fragment IS NOT NULL AND ends_with(target, '.html') AND (target, replace(fragment, '%33', '3')) NOT IN (SELECT (path, anchor) FROM s))
 SELECT path, CAST(ord AS INT) AS ord, h.href, kind, detail FROM (SELECT path, ord, arg_min(kind, rank) AS kind, arg_min(detail, rank) AS detail FROM a GROUP BY path, ord) JOIN h USING (path, ord)"""

QUERIES = {"link_integrity": (problems, SQL)}
