"""Quality, page and feed queries over the lenses, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import feed
from tessera.operators import quality as op
from tessera.operators import schedule
from tessera.plans.lenses import NOW, SERIES, SESSIONS, read, series, sessions

W = f"WITH {SESSIONS}, {SERIES}"


def pages(s, d):
    return read(s, d, "pages")


def texts(s, d, *more):
    """Parts as texts, some of them broken, and more columns of theirs."""
    k = F.col("p_partkey")
    name = F.when(k % 40 == 0, F.concat(F.lit(" "), "p_name")).when(k % 41 == 0, F.concat("p_name", F.lit("<b>x</b>"))).when(k % 43 == 0, "TBD").otherwise(F.col("p_name"))
    return read(s, d, "part").select(k.alias("id"), name.alias("name"), F.when(k % 47 != 0, F.col("p_brand")).alias("brand"), F.when(k % 53 == 0, "x").otherwise(F.col("p_size").cast("string")).alias("size"), *more)


def schema_rules():
    return [*op.text_rules("name"), op.Rule("brand", "missing", F.col("brand").isNull()), op.Rule("size", "not a number", F.col("size").isNotNull() & F.expr("try_cast(size AS INT)").isNull())]


TEXTS = "tx AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 40 = 0 THEN ' ' || p_name WHEN p_partkey % 41 = 0 THEN p_name || '<b>x</b>' WHEN p_partkey % 43 = 0 THEN 'TBD' ELSE p_name END AS name, CASE WHEN p_partkey % 47 <> 0 THEN p_brand END AS brand, CASE WHEN p_partkey % 53 = 0 THEN 'x' ELSE CAST(p_size AS VARCHAR) END AS size FROM part)"
FOUND = f"WITH {TEXTS}, f AS (SELECT id, 'name' AS path, 'white space around' AS message, 'error' AS level FROM tx WHERE regexp_matches(name, '^\\s|\\s$') UNION ALL SELECT id, 'name', 'holds markup', 'error' FROM tx WHERE regexp_matches(name, '<[a-zA-Z/][^>]*>') UNION ALL SELECT id, 'name', 'placeholder', 'error' FROM tx WHERE lower(name) = 'tbd' UNION ALL SELECT id, 'brand', 'missing', 'error' FROM tx WHERE brand IS NULL UNION ALL SELECT id, 'size', 'not a number', 'error' FROM tx WHERE size = 'x')"


def typed_fields(s, d):
    """Parts with a typed, a nested and a list field each, some of them broken."""
    k = F.col("p_partkey")
    bad = lambda n, wrong, right: F.when(k % n == 0, wrong).otherwise(right)
    link = F.concat(bad(31, "http://a.example/", F.when(k % 37 == 0, "ftp:").otherwise("https://a.example/")), k.cast("string"))
    tags = F.array(bad(29, "Bad Tag", "ok"), F.concat(F.lit("t"), (k % 7).cast("string")), bad(23, "x--y", "x-y"))
    return texts(s, d, bad(19, "huge", F.element_at(F.split("p_type", " "), 1)).alias("kind"), link.alias("link"), F.struct(bad(17, "1998-1-2", "1998-01-02").alias("day"), F.when(k % 13 != 0, bad(11, "24:00", "23:59")).alias("time")).alias("at"), tags.alias("tags"))


KINDS = ("STANDARD", "SMALL", "MEDIUM", "LARGE", "ECONOMY", "PROMO")


def typed_rules():
    return [*op.typed_rules("kind", "enum", KINDS), *op.typed_rules("link", "url"), *op.typed_rules("at.day", "date"), *op.typed_rules("at.time", "time", required=True), op.Each("tags", lambda x: op.typed(x, "id"))]


TYPED = f""" UNION ALL SELECT p_partkey, 'kind', 'not one of the values', 'error' FROM part WHERE p_partkey % 19 = 0 OR string_split(p_type, ' ')[1] NOT IN {KINDS}
 UNION ALL SELECT p_partkey, 'link', 'insecure link', 'error' FROM part WHERE p_partkey % 31 = 0 UNION ALL SELECT p_partkey, 'link', 'not an address', 'error' FROM part WHERE p_partkey % 31 <> 0 AND p_partkey % 37 = 0
 UNION ALL SELECT p_partkey, 'at.day', 'not a date', 'error' FROM part WHERE p_partkey % 17 = 0 UNION ALL SELECT p_partkey, 'at.time', 'missing', 'error' FROM part WHERE p_partkey % 13 = 0
 UNION ALL SELECT p_partkey, 'at.time', 'not a time', 'error' FROM part WHERE p_partkey % 13 <> 0 AND p_partkey % 11 = 0
 UNION ALL SELECT p_partkey, 'tags[0]', 'not an id', 'error' FROM part WHERE p_partkey % 29 = 0 UNION ALL SELECT p_partkey, 'tags[2]', 'not an id', 'error' FROM part WHERE p_partkey % 23 = 0"""


WINDOW = (9200, 11400)


def dated(s, d):
    """Listings with an end day (some before the first one), some of them all day, some with further occurrences."""
    k = F.col("id")
    occurrence = lambda m: F.struct((F.col("d") + k * m % 400 - 200).alias("day"), F.when(k % 4 != 0, k * m % 1440).cast("int").alias("sm"), F.when(k % 3 != 0, k * m * 7 % 1440).cast("int").alias("em"))
    rows = series(s, d).withColumns({"end": F.when(k % 6 != 0, F.col("d") + F.col("n") - F.when(k % 43 == 0, 9).otherwise(1)), "ad": k % 14 == 0, "sm": F.when(k % 26 != 0, F.col("sm")), "occurrences": F.when(k % 5 == 0, F.array(occurrence(3), occurrence(11)))})
    return rows.withColumn("em", F.when(k % 26 == 0, 600).otherwise(F.col("em")))


def time_rules(first=WINDOW[0], last=WINDOW[1], dawn=360):
    """What can't be with days and times: an end before the start is the next day's only up to dawn."""
    backward = lambda start, end: (end < start) & (end > dawn)
    sm, em, end = F.col("sm"), F.col("em"), F.coalesce("end", "d")
    return [
        op.Rule("end", "before the first day", F.col("end") < F.col("d")), op.Rule("d", "outside the window", (end < first) | (F.col("d") > last)), op.Rule("ad", "a whole day has no times", F.col("ad") & (sm.isNotNull() | em.isNotNull())),
        op.Rule("em", "end without start", sm.isNull() & em.isNotNull()), op.Rule("em", "ends before it starts", backward(sm, em)),
        op.Each("occurrences", lambda o: [("outside the window", (o["day"] < first) | (o["day"] > last), "error"), ("ends before it starts", backward(o["sm"], o["em"]), "error")]),
    ]


_SERIES_SQL = f"""WITH {SERIES}, t0 AS (SELECT id, d, n, CASE WHEN id % 6 <> 0 THEN d + n - CASE WHEN id % 43 = 0 THEN 9 ELSE 1 END END AS e, id % 14 = 0 AS ad, CASE WHEN id % 26 <> 0 THEN sm END AS sm, CASE WHEN id % 26 = 0 THEN 600 ELSE em END AS em FROM r),
 o AS (SELECT id, i, d + id * m % 400 - 200 AS day, CASE WHEN id % 4 <> 0 THEN id * m % 1440 END AS sm, CASE WHEN id % 3 <> 0 THEN id * m * 7 % 1440 END AS em FROM t0, (SELECT unnest([0, 1]) AS i, unnest([3, 11]) AS m) WHERE id % 5 = 0)"""
TIMES = _SERIES_SQL + f""" SELECT id, 'end' AS path, 'before the first day' AS message, 'error' AS level FROM t0 WHERE e < d UNION ALL SELECT id, 'd', 'outside the window', 'error' FROM t0 WHERE coalesce(e, d) < {WINDOW[0]} OR d > {WINDOW[1]}
 UNION ALL SELECT id, 'ad', 'a whole day has no times', 'error' FROM t0 WHERE ad AND (sm IS NOT NULL OR em IS NOT NULL) UNION ALL SELECT id, 'em', 'end without start', 'error' FROM t0 WHERE sm IS NULL AND em IS NOT NULL UNION ALL SELECT id, 'em', 'ends before it starts', 'error' FROM t0 WHERE em < sm AND em > 360
 UNION ALL SELECT id, 'occurrences[' || i || ']', 'outside the window', 'error' FROM o WHERE day < {WINDOW[0]} OR day > {WINDOW[1]} UNION ALL SELECT id, 'occurrences[' || i || ']', 'ends before it starts', 'error' FROM o WHERE em < sm AND em > 360"""


def conditional_rules():
    return [op.Rule("venue", "timed without a place", ~F.col("tu") & (F.col("venue") >= 95)), op.Rule("ad", "all day with an end unknown", F.col("ad") & F.col("eu")), op.Rule("featured", "cancelled but featured", F.col("cancelled") & F.col("featured"), "warning")]


def aliases(s, d):
    k = F.col("s_suppkey")
    return read(s, d, "supplier").select(k.alias("id"), F.when(k % 6 == 0, F.concat(F.lit("Hall "), k.cast("string"))).otherwise(F.concat(F.lit("hall "), k.cast("string"))).alias("key"), (k * 2).alias("target"))


def alias_found(s, d):
    bad = op.validate(aliases(s, d), "id", [op.Rule("key", "not normalised", F.col("key") != F.lower("key"))])
    lost = aliases(s, d).join(read(s, d, "supplier").select(F.col("s_suppkey").alias("target")), "target", "left_anti").select("id", F.lit("target").alias("path"), F.lit("no such target").alias("message"), F.lit("error").alias("level"))
    return bad.unionByName(lost)


def plans(s, d):
    e = read(s, d, "events").select((F.col("event_id") % 200).alias("plan"), (F.col("event_id") * 7 % 12000).alias("item"))
    return e.groupBy("plan").agg(F.array_join(F.collect_set(op.short_code(F.col("item").cast("string"))), ".").alias("codes"))


def items(s, d):
    return items_of(pages(s, d))


def items_of(pages):
    """Pages as answers to seven queries: their host names the source; titles repeat in several spellings, some are no stories."""
    k = F.col("page_id")
    topic = F.when(k % 3 == 0, " Music film").when(k % 3 == 1, " tech, music awards").otherwise(" Market")
    title = F.concat(F.when(k % 4 == 0, "News: ").otherwise("news  "), (k % 70).cast("string"), topic, F.when(k % 5 == 0, "!").otherwise(""))
    title = F.when(k % 23 == 0, F.concat(title, F.lit(" TBA"))).when(k % 29 == 0, F.concat(title, F.lit(" &amp; more"))).when(k % 31 == 0, F.concat(F.lit("Events calendar "), title)).otherwise(title)
    name = F.when(k % 8 == 0, "The Daily Example (org)").when(k % 8 == 1, "somebody").otherwise(F.lit(None))
    return pages.select(k.alias("id"), (k % 7).cast("int").alias("query"), k.alias("ord"), "url", name.alias("source"), title.alias("title"), (F.lit(NOW) - k * 50_000).alias("t"))


SOURCES = [feed.Source("Daily", ("daily example",), ("example.org",)), feed.Source("Spam", (), ("spam-farm.example.org", "cheap-pills.example.com")), feed.Source("Net", (), ("tionsh.example.net", "example.net")), feed.Source("Com", ("nobody",), ("example.com",))]
TOPICS = [feed.Tag("film", ("film",)), feed.Tag("market", ("market",), (), r"\bMarket\b"), feed.Tag("music", ("music",), (r"\bawards\b",)), feed.Tag("tech", ("tech",))]
ITEMS = f"""i0 AS (SELECT *, CASE WHEN page_id % 4 = 0 THEN 'News: ' ELSE 'news  ' END || (page_id % 70) || CASE page_id % 3 WHEN 0 THEN ' Music film' WHEN 1 THEN ' tech, music awards' ELSE ' Market' END || CASE WHEN page_id % 5 = 0 THEN '!' ELSE '' END AS title0 FROM pages),
 i1 AS (SELECT page_id AS id, page_id % 7 AS query, page_id AS ord, url, CASE page_id % 8 WHEN 0 THEN 'the daily example (org)' WHEN 1 THEN 'somebody' ELSE '' END AS source, CASE WHEN page_id % 23 = 0 THEN title0 || ' TBA' WHEN page_id % 29 = 0 THEN title0 || ' &amp; more' WHEN page_id % 31 = 0 THEN 'Events calendar ' || title0 ELSE title0 END AS title,
  {NOW} - page_id * 50000 AS t, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)), '^www\\.', '') AS host FROM i0),
 it AS (SELECT *, CASE WHEN contains(source, 'daily example') OR host = 'example.org' OR ends_with(host, '.example.org') THEN 'Daily' WHEN host = 'cheap-pills.example.com' OR ends_with(host, '.cheap-pills.example.com') THEN 'Spam'
  WHEN host = 'example.net' OR ends_with(host, '.example.net') THEN 'Net' WHEN host = 'example.com' OR ends_with(host, '.example.com') THEN 'Com' END AS label,
  list_filter([CASE WHEN contains(lower(title), 'film') THEN 'film' END, CASE WHEN contains(title, 'Market') THEN 'market' END, CASE WHEN contains(lower(title), 'music') AND NOT contains(lower(title), 'awards') THEN 'music' END, CASE WHEN contains(lower(title), 'tech') THEN 'tech' END], lambda x: x IS NOT NULL) AS tags,
  trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')) AS title_key, NOT regexp_matches(title, '\\bTBA\\b') AND NOT contains(title, '&amp;') AND NOT starts_with(title, 'Events calendar') AS story FROM i1)"""
KEPT_QUERY = "list_transform(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_') AND NOT starts_with(p, 'mc_') AND string_split(p, '=')[1] NOT IN ('fbclid', 'gclid', 'ocid', 'cmpid')), lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END)"
CANON = f"regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)), '^www\\.', '') || coalesce(nullif(regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), '/+$', ''), ''), '/') || coalesce('?' || nullif(array_to_string({KEPT_QUERY}, '&'), ''), '')"


def domains(s, d):
    """Every tenth host is allowed, by itself; example.com stands last for all below it."""
    hosts = pages(s, d).filter("page_id % 10 = 0").select(feed.host_of(F.col("url")).alias("host")).distinct()
    own = hosts.select(F.lit(0).alias("ord"), F.col("host").alias("domain"), F.concat(F.lit("own "), "host").alias("label"))
    return own.unionByName(s.range(1).select(F.lit(1).alias("ord"), F.lit("example.com").alias("domain"), F.lit("any").alias("label")))


def labelled(df):
    return df.withColumns({"label": feed.source_label(F.col("source"), F.col("url"), SOURCES), "tags": feed.tags(F.col("title"), TOPICS)})


def known(s, d):
    """Stories that are out already: every eleventh page, under its address and another title, or its own title."""
    return labelled(items(s, d)).filter("id % 11 = 0").select("url", F.when(F.col("id") % 22 == 0, F.col("title")).otherwise("elsewhere").alias("title"))


STORIES = f"WITH RECURSIVE {ITEMS}, kn AS (SELECT {CANON} AS key, CASE WHEN id % 22 = 0 THEN title_key ELSE 'elsewhere' END AS title_key FROM it WHERE id % 11 = 0), st AS (SELECT *, {CANON} AS key FROM it WHERE story AND label IS NOT NULL AND len(tags) > 0)"
#: one item a step: (position, titles taken, how many of the current query, query, items taken)
REFRESH = STORIES + f""", o AS (SELECT *, row_number() OVER (ORDER BY query, ord) AS i FROM st WHERE t >= {NOW - 120 * 86400} AND title_key NOT IN (SELECT title_key FROM kn)),
 g AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS seen, 0 AS n, -1::BIGINT AS query, []::BIGINT[] AS taken UNION ALL
  SELECT i, CASE WHEN ok AND NOT old THEN list_append(seen, title_key) ELSE seen END, CASE WHEN ok AND NOT old THEN n + 1 ELSE n END, query, CASE WHEN ok THEN list_append(taken, i) ELSE taken END
  FROM (SELECT *, n < 6 AS ok, list_contains(seen, title_key) AS old FROM (SELECT o.i, o.title_key, o.query, g.seen, g.taken, CASE WHEN o.query = g.query THEN g.n ELSE 0 END AS n FROM g JOIN o ON o.i = g.i + 1))),
 k AS (SELECT * FROM o WHERE list_contains((SELECT taken FROM g ORDER BY i DESC LIMIT 1), i)),
 f AS (SELECT title_key, arg_min({{'id': id, 'label': label, 'key': key, 't': t, 'url': url, 'i': i}}, i) AS x, array_to_string(list_sort(list_distinct(flatten(list(tags)))), ',') AS tags FROM k GROUP BY title_key),
 n AS (SELECT title_key, x.id AS id, x.label AS label, x.key AS key, x.t AS t, x.url AS url, x.i AS i, tags FROM f ORDER BY t DESC, i LIMIT 40)
 SELECT title_key, id, label, key, t, tags FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t DESC, i) AS rn FROM n WHERE starts_with(url, 'https://') AND key NOT IN (SELECT key FROM kn)) WHERE rn = 1"""
CURRENT = STORIES + f""", o AS (SELECT * FROM st WHERE t >= (SELECT max(t) FROM st) - 120 * 86400 AND title_key NOT IN (SELECT title_key FROM kn)),
 f AS (SELECT title_key, arg_min({{'id': id, 'label': label, 'key': key, 't': t}}, (-t, id)) AS x, array_to_string(list_sort(list_distinct(flatten(list(tags)))), ',') AS tags FROM o GROUP BY title_key),
 n AS (SELECT title_key, x.id AS id, x.label AS label, x.key AS key, x.t AS t, tags, row_number() OVER (PARTITION BY x.label ORDER BY x.t DESC, x.id) AS nth FROM f) SELECT title_key, id, label, key, t, tags FROM n WHERE nth <= 25"""


def toggles(s, d):
    return toggles_of(read(s, d, "events"))


def toggles_of(events):
    """Stars, drops, additions, and now and then a clear or a replacement, in the order of their numbers."""
    i = F.col("event_id")
    action = F.when(i % 97 == 0, "clear").when(i % 89 == 0, "replace").when(i % 3 == 0, "drop").when(i % 7 == 0, "add").otherwise("star")
    return events.select("user_id", (i % 12).alias("item"), action.alias("action"), i.alias("seq"), (F.lit(NOW) + i * 60).alias("at"))


def ticks(s):
    return s.range(NOW - 7200, NOW + 7201, 60).select(F.col("id").alias("tick"))


def budgets(s):
    return s.createDataFrame([("a", 3000), ("b", 6000), ("c", 9000)], "cls string, budget long")


def classed(s, d):
    return pages(s, d).withColumn("cls", F.get(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("page_id") % 3).cast("int")))


LINKS = "ln AS (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1)) AS href FROM pages)"
PATH = "regexp_replace(regexp_replace(regexp_replace({0}, '^[a-zA-Z]+://[^/?#]*', ''), '[?#].*$', ''), '(.)/$', '\\1')"
def marked_up(s, d):
    """Pages with a canonical address, pictures and outward links added to some."""
    k = F.col("page_id")
    more = F.concat(
        F.when(k % 3 != 0, '<link rel="canonical" href="https://example.com/x">').otherwise(""), F.when(k % 4 == 0, "<img src=a.png alt='' width=3 height=4>").when(k % 4 == 1, '<img alt="x" width="3" src="b.png">').when(k % 4 == 2, '<img src="c.png" width=1 height=2>').otherwise(""),
        F.when(k % 5 == 0, '<a href="https://o.example/" target="_blank" rel="noopener">o <span>(opens in a new tab)</span></a>').when(k % 5 == 1, '<a href="https://o.example/" rel="noopener">o (opens in a new tab)</a>').when(k % 5 == 2, '<a target="_blank" href="https://o.example/" rel="nofollow noopener">o</a>').otherwise(""),
    )
    return pages(s, d).withColumn("html", F.concat("html", more))


PAGE_RULES = "WITH c AS (SELECT page_id AS id, html, page_id AS k, regexp_extract_all(html, ' id=\"([^\"]*)\"', 1) AS ids FROM pages) " + " UNION ALL ".join(
    f"SELECT id, '{path}' AS path, '{message}' AS message, '{level}' AS level FROM c WHERE {broken}"
    for path, message, level, broken in (
        ("h1", "not exactly one h1", "error", "len(regexp_extract_all(html, '<h1[ >]')) <> 1"), ("title", "no title", "error", "NOT regexp_matches(html, '<title>[^<]')"), ("description", "no description", "warning", "NOT contains(html, '<meta name=\"description\"')"),
        ("canonical", "no canonical address", "error", "k % 3 = 0"), ("id", "an id twice", "error", "len(list_distinct(ids)) < len(ids)"), ("img", "image without alt", "error", "k % 4 = 2"), ("img", "image without width and height", "error", "k % 4 = 1"),
        ("a", "plain http link", "warning", "contains(html, 'href=\"http://')"), ("a", "empty link", "error", "contains(html, 'href=\"\"') OR contains(html, 'href=\"#\"')"), ("a", "outward link without its own tab", "error", "k % 5 = 1"), ("a", "outward link that does not say so", "error", "k % 5 = 2"),
    )
)

DIGIT = "substring('0123456789abcdefghijklmnopqrstuvwxyz', CAST(h // {0} % 36 AS INT) + 1, 1)"
CODES = f"""WITH k AS (SELECT event_id AS id, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(CAST(event_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, b: xor(h, b) * 16777619 & 4294967295) % {36**5} AS h FROM events),
 c AS (SELECT id, {" || ".join(DIGIT.format(36**p) for p in (4, 3, 2, 1, 0))} AS code FROM k) SELECT id, code, count(*) OVER (PARTITION BY code) AS n FROM c"""

QUERIES = {
    "validate_schema": (lambda s, d: op.validate(typed_fields(s, d), "id", [*schema_rules(), *typed_rules()]), FOUND + " SELECT * FROM f" + TYPED),
    "warning_rollup": (lambda s, d: op.warning_rollup(op.validate(texts(s, d), "id", schema_rules())), FOUND + " SELECT level, message, count(*) AS n, array_to_string(list_sort(list(DISTINCT id))[1:3], ',') AS first_ids FROM f GROUP BY level, message"),
    "unknown_keys": (lambda s, d: op.unknown_keys(read(s, d, "events").withColumn("j", F.when(F.col("event_id") % 9 == 0, F.concat(F.lit('{"k": 1, "z'), (F.col("event_id") % 4).cast("string"), F.lit('": 2}'))).otherwise(F.col("props"))), "j", ["k"]), "SELECT 'z' || (event_id % 4) AS unknown_key, count(*) AS n FROM events WHERE event_id % 9 = 0 GROUP BY 1"),
    "coerce_permissive": (lambda s, d: op.coerced(texts(s, d).select("id", "size"), {"size": "INT"}), f"WITH {TEXTS} SELECT id, TRY_CAST(size AS INT) AS size, CAST(size = 'x' AS INT) AS n_coerced FROM tx"),
    "duplicate_keys": (
        lambda s, d: op.duplicate_keys({"events": read(s, d, "events").select((F.col("event_id") % 7000).alias("id")), "orders": read(s, d, "orders").select((F.col("o_orderkey") + 6000).alias("id"))}, "id"),
        "WITH k AS (SELECT event_id % 7000 AS id, 'events' AS t FROM events UNION ALL SELECT o_orderkey + 6000, 'orders' FROM orders) SELECT CAST(id AS VARCHAR) AS id, count(*) AS n, string_agg(DISTINCT t, ',' ORDER BY t) AS tables FROM k GROUP BY id HAVING count(*) > 1",
    ),
    "time_rules": (lambda s, d: op.validate(dated(s, d), "id", time_rules()), TIMES),
    "conditional_rules": (
        lambda s, d: op.validate(sessions(s, d), "id", conditional_rules()),
        W + " SELECT id, 'venue' AS path, 'timed without a place' AS message, 'error' AS level FROM x WHERE NOT tu AND venue >= 95 UNION ALL SELECT id, 'ad', 'all day with an end unknown', 'error' FROM x WHERE ad AND eu UNION ALL SELECT id, 'featured', 'cancelled but featured', 'warning' FROM x WHERE cancelled AND featured",
    ),
    "alias_rules": (alias_found, "SELECT s_suppkey AS id, 'key' AS path, 'not normalised' AS message, 'error' AS level FROM supplier WHERE s_suppkey % 6 = 0 UNION ALL SELECT s_suppkey, 'target', 'no such target', 'error' FROM supplier WHERE s_suppkey * 2 NOT IN (SELECT s_suppkey FROM supplier)"),
    "short_codes": (lambda s, d: op.coded(read(s, d, "events"), "event_id"), CODES),
    "decode_plans": (
        lambda s, d: op.decode_plans(plans(s, d), read(s, d, "events").select(F.col("event_id").alias("item")), "item"),
        "WITH e AS (SELECT DISTINCT event_id % 200 AS plan, event_id * 7 % 12000 AS item FROM events) SELECT plan, count(*) FILTER (WHERE item IN (SELECT event_id FROM events)) AS n_items, count(*) FILTER (WHERE item NOT IN (SELECT event_id FROM events)) AS n_unknown FROM e GROUP BY plan",
    ),
    "broken_paths": (
        lambda s, d: op.broken_paths(pages(s, d)),
        f"WITH {LINKS}, i AS (SELECT page_id, {PATH.format('href')} AS path FROM ln WHERE starts_with(href, '/')) SELECT path, count(DISTINCT page_id) AS n_pages, min(page_id) AS first_page FROM i WHERE path NOT IN (SELECT {PATH.format('url')} FROM pages) GROUP BY path",
    ),
    "link_graph": (
        lambda s, d: op.link_graph(pages(s, d)),
        f"WITH {LINKS}, o AS (SELECT page_id, count(*) AS a, count(*) FILTER (WHERE starts_with(href, '/')) AS b, count(*) FILTER (WHERE regexp_matches(href, '^https?://')) AS c, count(DISTINCT href) AS e FROM ln GROUP BY page_id) SELECT p.page_id, coalesce(a, 0) AS n_out, coalesce(b, 0) AS n_internal, coalesce(c, 0) AS n_external, coalesce(e, 0) AS n_targets FROM pages p LEFT JOIN o ON p.page_id = o.page_id",
    ),
    "link_in_degree": (lambda s, d: op.in_degree(pages(s, d)), f"WITH {LINKS} SELECT href, count(DISTINCT page_id) AS n_in FROM ln GROUP BY href"),
    "page_rules": (lambda s, d: op.page_rules(marked_up(s, d)), PAGE_RULES),
    "sitemap_coverage": (
        lambda s, d: op.coverage(pages(s, d), pages(s, d).filter("page_id % 5 <> 0").select("url").unionByName(pages(s, d).filter("page_id % 20 = 1").select(F.concat("url", F.lit("#gone")).alias("url")))),
        "WITH l AS (SELECT url FROM pages WHERE page_id % 5 <> 0 UNION SELECT url || '#gone' FROM pages WHERE page_id % 20 = 1), p AS (SELECT DISTINCT url FROM pages) SELECT url, 'not listed' AS state FROM p WHERE url NOT IN (SELECT url FROM l) UNION ALL SELECT url, 'no page' FROM l WHERE url NOT IN (SELECT url FROM p)",
    ),
    "size_budgets": (
        lambda s, d: op.over_budget(classed(s, d), budgets(s)),
        "WITH p AS (SELECT ['a', 'b', 'c'][page_id % 3 + 1] AS cls, strlen(html) AS bytes, (page_id % 3 + 1) * 3000 AS budget FROM pages) SELECT cls, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) FILTER (WHERE bytes > budget) AS n_over, max(bytes) AS largest FROM p GROUP BY cls",
    ),
    "determinism_check": (lambda s, d: op.same_twice(schedule.expand_instances(series(s, d), 10000, 10400), schedule.expand_instances(series(s, d).orderBy("id"), 10000, 10400)), f"WITH {SERIES}, z AS (SELECT unnest(range(d, d + n)) AS day FROM r) SELECT count(*) AS n, true AS same FROM z WHERE day BETWEEN 10000 AND 10400"),
    "feed_allowlist": (
        lambda s, d: labelled(items(s, d)).select("id", "label"),
        f"WITH {ITEMS} SELECT id, label FROM it",
    ),
    "feed_domains": (
        lambda s, d: feed.allowlisted(pages(s, d).withColumn("host", feed.host_of(F.col("url"))), domains(s, d), "host").groupBy("label").agg(F.count("*").alias("n")),
        f"WITH {ITEMS}, h AS (SELECT DISTINCT host FROM it WHERE id % 10 = 0) SELECT CASE WHEN host IN (SELECT host FROM h) THEN 'own ' || host ELSE 'any' END AS label, count(*) AS n FROM it WHERE host IN (SELECT host FROM h) OR host = 'example.com' OR host LIKE '%.example.com' GROUP BY 1",
    ),
    "keyword_tag": (lambda s, d: items(s, d).select("id", F.array_join(feed.tags(F.col("title"), TOPICS), ",").alias("tags")), f"WITH {ITEMS} SELECT id, array_to_string(tags, ',') AS tags FROM it"),
    "canonical_url": (lambda s, d: pages(s, d).select("page_id", feed.canonical_url(F.col("url")).alias("key")), f"SELECT page_id, {CANON} AS key FROM pages"),
    "feed_refresh": (lambda s, d: feed.feed_refresh(labelled(items(s, d)), known(s, d), NOW, per_query=6, per_run=40), REFRESH),
    "plan_state": (
        lambda s, d: feed.plan_state(toggles(s, d)),
        """WITH t AS (SELECT user_id, event_id % 12 AS item, CASE WHEN event_id % 97 = 0 THEN 'clear' WHEN event_id % 89 = 0 THEN 'replace' WHEN event_id % 3 = 0 THEN 'drop' WHEN event_id % 7 = 0 THEN 'add' ELSE 'star' END AS action, event_id AS seq FROM events),
 r AS (SELECT user_id, max(seq) FILTER (WHERE action IN ('clear', 'replace')) AS reset FROM t GROUP BY user_id)
 SELECT t.user_id, item FROM t JOIN r ON t.user_id = r.user_id WHERE action <> 'clear' AND (reset IS NULL OR seq >= reset) GROUP BY t.user_id, item HAVING arg_max(action, seq) <> 'drop'""",
    ),
    "live_board_changes": (
        lambda s, d: feed.status_changes(schedule.timed(sessions(s, d)).select("id", "s", "e"), ticks(s)),
        W + f""", k AS (SELECT unnest(range({NOW - 7200}, {NOW + 7201}, 60)) AS tick), t AS (SELECT id, s, e FROM x WHERE NOT (cancelled OR tu OR ad OR og) AND e > {NOW - 90000} AND s < {NOW + 90000}),
 v AS (SELECT tick, id, CASE WHEN e <= tick THEN 'past' WHEN s <= tick THEN 'live' WHEN s - 1800 <= tick THEN 'soon' ELSE 'upcoming' END AS status FROM k, t), w AS (SELECT *, lag(status) OVER (PARTITION BY id ORDER BY tick) AS before FROM v) SELECT tick, id, status FROM w WHERE before IS NOT NULL AND before <> status""",
    ),
}
