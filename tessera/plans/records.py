"""Record queries over the lenses, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.geo import METRES_SQL
from tessera.operators import nested
from tessera.operators import records as op
from tessera.operators import schedule, similarity
from tessera.plans.lenses import CUSTOMERS, SESSIONS, SUPPLIERS, places, read, sessions

CASED = "CASE c_custkey % 3 WHEN 0 THEN upper(c_name) WHEN 1 THEN 'The ' || c_name ELSE c_name || ', Inc.' END"


def slices(s, d):
    """Customers as records of eight slices: 600 ids, names spelled in three ways, gaps in segment and balance."""
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, F.upper("c_name")).when(k % 3 == 1, F.concat(F.lit("The "), "c_name")).otherwise(F.concat("c_name", F.lit(", Inc.")))
    return read(s, d, "customer").select((k % 600).alias("id"), (k % 8 * 1_000_000 + k).alias("ord"), name.alias("name"), F.when(k % 4 != 0, F.col("c_mktsegment")).alias("segment"), F.when(k % 5 == 0, F.concat(F.lit("bio "), k.cast("string"))).alias("bio"), F.concat(F.lit("P"), (k % 5).cast("string")).alias("program"), k.alias("k"))


SLICES = f"sl AS (SELECT c_custkey % 600 AS id, c_custkey % 8 * 1000000 + c_custkey AS ord, {CASED} AS name, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS segment, CASE WHEN c_custkey % 5 = 0 THEN 'bio ' || c_custkey END AS bio, 'P' || (c_custkey % 5) AS program, c_custkey AS k FROM customer)"
KEY = r"regexp_replace(regexp_replace(trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), '^the ', ''), ' (inc|llc|ltd|co)$', '')"
W = f"WITH {SESSIONS}, {SLICES}, t AS (SELECT *, CAST(floor((s - 18000) / 86400) AS BIGINT) AS day FROM x WHERE NOT cancelled AND NOT tu AND NOT ad AND NOT og)"


def listed_stays(s, d):
    """Suppliers as listings of stays, three of a house: the second has another id and spells the address in full, the third has no
    address; every tenth house holds another stay, and some names come twice."""
    k = F.col("s_suppkey")
    house = F.floor(k / 3).cast("long")
    name = F.concat(F.when(k % 3 == 2, "The ").otherwise(""), F.when(house % 10 == 9, "Harbor").otherwise("River"), F.lit(" Inn"), F.when(k % 3 == 1, " & Suites").otherwise(""), F.lit(" "), F.when(k % 3 == 1, house + 500).otherwise(house % 400))
    address = F.when(k % 3 == 0, F.concat(house % 25 + 10, F.lit(" E 6th St., Town"))).when(k % 3 == 1, F.concat(house % 25 + 10, F.lit(" East Sixth Street")))
    return read(s, d, "supplier").select(k.alias("row"), (k % 4).alias("slice"), F.when(k % 3 == 1, k + 1_000_000).otherwise(house).alias("stay"), name.alias("name"), address.alias("address"), F.when(k % 2 == 0, F.concat(F.lit("https://stay/"), k)).alias("url"))


STAYS = """WITH RECURSIVE s AS (SELECT s_suppkey AS row, s_suppkey % 4 AS slice, CASE WHEN s_suppkey % 3 = 1 THEN s_suppkey + 1000000 ELSE s_suppkey // 3 END AS stay, CASE WHEN s_suppkey // 3 % 10 = 9 THEN 'harbor' ELSE 'river' END AS brand,
  CASE WHEN s_suppkey % 3 = 1 THEN 'innandsuites' || (s_suppkey // 3 + 500) ELSE 'inn' || (s_suppkey // 3 % 400) END AS rest, CASE WHEN s_suppkey % 3 < 2 THEN (s_suppkey // 3 % 25 + 10) || ' e 6th st' END AS addr, CASE WHEN s_suppkey % 2 = 0 THEN 'https://stay/' || s_suppkey END AS url,
  CASE WHEN s_suppkey % 3 < 2 THEN (s_suppkey // 3 % 25 + 10) || CASE WHEN s_suppkey % 3 = 0 THEN ' E 6th St., Town' ELSE ' East Sixth Street' END END AS address FROM supplier),
 e AS (SELECT row, unnest(list_filter(['id:' || stay, 'a:' || addr || '|' || brand, 'n:' || brand || rest], lambda x: x IS NOT NULL)) AS key FROM s),
 l AS (SELECT DISTINCT a.row AS x, b.row AS y FROM e a JOIN e b ON a.key = b.key), r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x), g AS (SELECT x AS row, min(y) AS "group" FROM r GROUP BY x)
 SELECT "group", arg_min(stay, row) AS stay, count(*) AS n, string_agg(DISTINCT slice, '+' ORDER BY slice) AS slices, arg_min(address, row) FILTER (WHERE address IS NOT NULL) AS address, arg_min(url, row) FILTER (WHERE url IS NOT NULL) AS url FROM s JOIN g USING (row) GROUP BY "group\""""


def organisations(s, d):
    """Customers as organisations of eight slices, spelled in several ways, with one or two roles each."""
    k = F.col("c_custkey")
    n = k % 400
    name = F.when(n % 7 == 0, F.concat(F.lit("P&G"), n)).when(k % 3 == 0, F.concat(F.lit("The Ac\u00e9 "), n, F.lit(" (Cincy) Co."))).when(k % 3 == 1, F.concat(F.lit("ACE "), n, F.lit(", Inc"))).otherwise(F.concat(F.lit("Ace-"), n))
    name = F.when((n % 7 == 0) & (k % 2 == 0), F.concat(F.lit("Procter and Gamble "), n)).otherwise(name)
    role = lambda m: F.struct(F.concat(F.lit("P"), k % m).alias("program"), F.when(k % 2 == 0, "sponsor").otherwise("partner").alias("relationship"), F.when(k % 5 != 0, F.col("c_mktsegment")).alias("tier"))
    roles = F.when(k % 4 == 0, F.array(role(3), role(2))).when(k % 4 == 1, F.array(role(3))).when(k % 4 == 2, F.array(role(2), role(2))).otherwise(F.array().cast("array<struct<program:string,relationship:string,tier:string>>"))
    return read(s, d, "customer").select((k % 8).alias("slice"), (k % 8 * 1_000_000 + k).alias("ord"), (n % 300).alias("id"), name.alias("name"), F.when(k % 3 == 0, F.concat(F.lit("logo"), k)).alias("logo"), F.when(k % 5 == 0, F.concat(F.lit("https://o/"), k)).alias("url"), roles.alias("roles"))


def same_orgs(s):
    return s.range(0, 400, 7).select(F.concat(F.lit("pandg"), "id").alias("key"), F.concat(F.lit("procterandgamble"), "id").alias("is"))


ORGS = """WITH b AS (SELECT c_custkey AS k, c_custkey % 400 AS n, c_custkey % 8 AS slice, c_custkey % 8 * 1000000 + c_custkey AS ord, c_mktsegment AS seg FROM customer),
 o AS (SELECT *, CASE WHEN n % 7 = 0 THEN 'procterandgamble' || n ELSE 'ace' || n END AS key, CASE WHEN n % 7 = 0 AND k % 2 = 0 THEN 'Procter and Gamble ' || n WHEN n % 7 = 0 THEN 'P&G' || n WHEN k % 3 = 0 THEN 'The Acé ' || n || ' (Cincy) Co.' WHEN k % 3 = 1 THEN 'ACE ' || n || ', Inc' ELSE 'Ace-' || n END AS name FROM b),
 t AS (SELECT key, ord, unnest(CASE k % 4 WHEN 0 THEN [3, 2] WHEN 1 THEN [3] WHEN 2 THEN [2, 2] ELSE [] END) AS m, generate_subscripts(CASE k % 4 WHEN 0 THEN [3, 2] WHEN 1 THEN [3] WHEN 2 THEN [2, 2] ELSE [] END, 1) AS pos, k, seg FROM o),
 u AS (SELECT key, 'P' || (k % m) || ':' || CASE WHEN k % 2 = 0 THEN 'sponsor' ELSE 'partner' END || ':' || CASE WHEN k % 5 <> 0 THEN seg ELSE '-' END AS role, min((ord, pos)) AS w FROM t GROUP BY 1, 2), v AS (SELECT key, string_agg(role, ',' ORDER BY w) AS roles FROM u GROUP BY key),
 g AS (SELECT key, min(ord) AS lead, arg_min(name, ord) AS name, arg_min('logo' || k, ord) FILTER (WHERE k % 3 = 0) AS logo, arg_min('https://o/' || k, ord) FILTER (WHERE k % 5 = 0) AS url, arg_min(n % 300, ord) AS id, arg_min(slice, ord) AS slice, count(DISTINCT slice) AS n_slices FROM o GROUP BY key)
 SELECT g.key, CASE WHEN row_number() OVER (PARTITION BY id ORDER BY lead) = 1 THEN CAST(id AS VARCHAR) ELSE id || '-' || slice END AS id, name, logo, url, coalesce(roles, '') AS roles, n_slices FROM g LEFT JOIN v ON g.key = v.key"""


def venue_names(s, d):
    return read(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))


def venue_aliases(s, d):
    k = F.col("s_suppkey")
    return read(s, d, "supplier").select(k.alias("id"), F.concat(F.lit("Hall "), (k % 30).cast("string")).alias("alias"), k.alias("ord"))


def free_texts(s, d):
    k = F.col("c_custkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("the SUPPLIER#"), F.lpad((k % 150).cast("string"), 9, "0"))).when(k % 3 == 1, F.concat(F.lit("Hall  "), (k % 40).cast("string"), F.lit("!"))).otherwise("somewhere")
    return read(s, d, "customer").select(k.alias("c"), text.alias("location"))


SHOW = T.StructType([
    T.StructField("id", T.LongType()), nested.refers("venue_id", T.LongType(), "venue"), T.StructField("title", T.StringType()), nested.refers("people", T.ArrayType(T.LongType()), "person"), nested.refers("roles", T.MapType(T.LongType(), T.StringType()), None, "person"),
    T.StructField("works", T.ArrayType(T.StructType([nested.refers("work_id", T.LongType(), "work"), T.StructField("by", T.StructType([nested.refers("org_id", T.LongType(), "org")]))]))),
])


def shows(s, d):
    """Orders as shows: a venue, two people, a map of roles by person, and their lines (at most seven) as works with an organisation each."""
    lines = read(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("l"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    works = F.transform("l", lambda x: F.struct(x["l_partkey"].alias("work_id"), F.struct(F.when(x["l_partkey"] % 3 != 0, x["l_suppkey"]).alias("org_id")).alias("by")))
    rows = read(s, d, "orders").join(lines, k == F.col("id"), "left")
    roles = F.create_map((c * 7 % 180).cast("long"), F.lit("host"), (c * 7 % 180 + 1).cast("long"), F.lit("guest"))
    shaped = rows.select(k.alias("id"), F.when(k % 5 != 0, c % 100).cast("long").alias("venue_id"), F.concat(F.lit("Show "), k).alias("title"), F.array(c, F.when(k % 2 == 0, c + 1)).cast("array<bigint>").alias("people"), F.when(k % 4 == 0, roles).alias("roles"), works.alias("works"))
    return shaped.select(*(F.col(f.name).cast(f.dataType).alias(f.name, metadata=f.metadata) for f in SHOW.fields))


def targets(s, d):
    of = lambda name, key, where, kind: read(s, d, name).filter(where).select(F.lit(kind).alias("kind"), F.col(key).alias("id"))
    return of("supplier", "s_suppkey", "s_suppkey < 80", "venue").unionByName(of("customer", "c_custkey", "c_custkey < 140", "person")).unionByName(of("part", "p_partkey", "p_partkey % 50 <> 0", "work")).unionByName(of("supplier", "s_suppkey", "s_suppkey % 9 <> 0", "org"))


DANGLING = """WITH w AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i, l_partkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
 r AS (SELECT o_orderkey AS id, 'venue_id' AS path, 'venue' AS kind, o_custkey % 100 AS ref FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT o_orderkey, 'people[0]', 'person', o_custkey FROM orders UNION ALL SELECT o_orderkey, 'people[1]', 'person', o_custkey + 1 FROM orders WHERE o_orderkey % 2 = 0
  UNION ALL SELECT o_orderkey, 'roles{' || (o_custkey * 7 % 180 + j) || '}', 'person', o_custkey * 7 % 180 + j FROM orders, (SELECT unnest([0, 1]) AS j) WHERE o_orderkey % 4 = 0
  UNION ALL SELECT id, 'works[' || i || '].work_id', 'work', l_partkey FROM w UNION ALL SELECT id, 'works[' || i || '].by.org_id', 'org', l_suppkey FROM w WHERE l_partkey % 3 <> 0)
 SELECT CAST(id AS VARCHAR) AS id, path, kind, CAST(ref AS VARCHAR) AS ref FROM r WHERE CASE kind WHEN 'venue' THEN ref NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey < 80) WHEN 'person' THEN ref NOT IN (SELECT c_custkey FROM customer WHERE c_custkey < 140)
  WHEN 'work' THEN ref NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 50 <> 0) ELSE ref NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 9 <> 0) END"""


def priced(s, d, which):
    k = F.col("o_orderkey")
    return read(s, d, "orders").filter(k % 9 != which).select(k.alias("id"), (F.col("o_custkey") % 100 + F.lit(which) * (k % 10 == 0).cast("int")).alias("start"))


def printed(s, d, kind):
    """Customers as printed entries and suppliers as works: titles of two words, up to two credited names, some without
    either a name or a place."""
    k = F.col("id")
    rows = places(s, d, kind)
    shift = {"customer": 7919, "supplier": 104_729}[kind]
    title = F.concat(F.lit("Mural w"), (k * shift % 97).cast("string"), F.lit("-v"), (k * 31 % 89).cast("string"))
    name = lambda m: F.concat(F.lit("Ané "), (k * m % 5003).cast("string"))
    credits = F.when(k % 4 == 0, F.array().cast("array<string>")).when(k % 4 == 1, F.array(name(13))).otherwise(F.array(name(13), name(29)))
    lost = k % 19 == 0
    return rows.select("id", F.regexp_replace(title, "Mural ", "").alias("title"), credits.alias("credits"), (k % 3).alias("category"), (k % 2).alias("zone"), F.when(~lost, F.col("lat")).alias("lat"), F.when(~lost, F.col("lng")).alias("lng"), (80 + k % 5 * 40).alias("reach"))


def _printed_sql(of: str, shift: int) -> str:
    return f"""(SELECT id, string_split('w' || (id * {shift} % 97) || '-v' || (id * 31 % 89), '-') AS words, CASE WHEN id % 4 = 0 THEN [] WHEN id % 4 = 1 THEN ['n' || (id * 13 % 5003)] ELSE ['n' || (id * 13 % 5003), 'n' || (id * 29 % 5003)] END AS names,
 id % 3 AS category, id % 2 AS zone, CASE WHEN id % 19 <> 0 THEN lat END AS lat, CASE WHEN id % 19 <> 0 THEN lng END AS lng, 80 + id % 5 * 40 AS reach FROM {of})"""


#: greedy one-to-one matching of c (a, b, cost...) in the order of i, one candidate a step
GREEDY = """, g AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS used_a, []::BIGINT[] AS used_b, []::BIGINT[] AS taken UNION ALL
 SELECT c.i, CASE WHEN ok THEN list_append(used_a, a) ELSE used_a END, CASE WHEN ok THEN list_append(used_b, b) ELSE used_b END, CASE WHEN ok THEN list_append(taken, c.i) ELSE taken END
 FROM (SELECT c.*, g.used_a, g.used_b, g.taken, NOT list_contains(g.used_a, c.a) AND NOT list_contains(g.used_b, c.b) AS ok FROM g JOIN c ON c.i = g.i + 1) c), t AS (SELECT unnest(taken) AS i FROM g WHERE i = (SELECT max(i) FROM g))"""
TIERS = f"""WITH RECURSIVE {SUPPLIERS}, {CUSTOMERS}, x AS {_printed_sql("cu", 7919)}, y AS {_printed_sql("sp", 104_729)},
 p AS (SELECT x.id AS a, y.id AS b, {METRES_SQL.format(a="x", b="y")} AS m, len(list_intersect(list_filter(x.words, lambda w: length(w) > 2), list_filter(y.words, lambda w: length(w) > 2))) > 0 AS t, len(list_intersect(x.names, y.names)) > 0 AS c, x.category = y.category AS k, x.zone = y.zone AS z, len(y.names) = 0 AS nobody, greatest(x.reach, 100) AS reach FROM x, y),
 r AS (SELECT a, b, CASE WHEN t AND c THEN 0 WHEN c AND k AND (m IS NULL OR m <= 200) THEN 1 WHEN t AND k AND z AND (m IS NULL OR m <= 200) THEN 2 WHEN nobody AND k AND z AND m <= reach THEN 3 END AS tier, coalesce(m, 9999) AS metres FROM p),
 c AS (SELECT *, row_number() OVER (ORDER BY tier, metres, a, b) AS i FROM r WHERE tier IS NOT NULL){GREEDY} SELECT a, b, tier, metres FROM c JOIN t USING (i)"""


def short_texts(s, d):
    """Every benchmark text, and again with another ending."""
    rows = read(s, d, "benchmark")
    return rows.select(F.col("item_id").alias("id"), "text").unionByName(rows.select((F.col("item_id") + 100_000).alias("id"), F.concat(F.expr("left(text, length(text) - 5)"), F.lit(" end")).alias("text")))


# What a credit label holds, first match first, and the role it stands for.
LABEL_ROLES = [
    (["artist", "filmmaker", "photographer"], "artist"), (["juror", "judge"], "judge"), (["curator"], "curator"), (["advisor", "faculty", "organiser", "organizer"], "organizer"),
    (["performer"], "performer"), (["speaker"], "speaker"), (["moderator"], "moderator"),
]
LABELS = ["Curated by", "Moderator", "Photographer and speaker", "Speaker", "with music by", "Guest curator", "Filmmaker", "Faculty advisor", "Organizers", "Judges", None]
LABELS_SQL = "[" + ", ".join("NULL" if x is None else f"'{x}'" for x in LABELS) + "]"
FOUND_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(label), '{'|'.join(needles)}') THEN '{role}'" for needles, role in LABEL_ROLES) + " END"


def credits(s, d):
    """Credit lines of persons at events; some without a label, some of who curated the event."""
    k = F.col("c_custkey")
    labels = F.array(*map(F.lit, LABELS))
    kinds = F.array(*map(F.lit, ["exhibition", "talk", "concert"]))
    roles = F.array(*(F.array(*map(F.lit, r)).cast("array<string>") for r in ([], ["moderator"], ["curator", "artist"], ["host", "speaker"])))
    row = [(k % 300).alias("person"), (k % 7).alias("event"), k.alias("ord"), F.when(k % 3 == 0, F.get(labels, (k * 7 % len(LABELS)).cast("int"))).alias("label"), (k % 5 == 0).alias("curated"), F.get(kinds, (k % 7 % 3).cast("int")).alias("kind")]
    return read(s, d, "customer").select(*row, F.get(roles, (k % 300 % 4).cast("int")).alias("roles"))


def rules(s):
    return s.createDataFrame([(i, needle, role) for i, (needles, role) in enumerate(LABEL_ROLES) for needle in needles], "ord int, needle string, role string")


def facts(s, d, which):
    k = F.col("p_partkey")
    return read(s, d, "part").filter(k % 2 == which).select(k.alias("ord"), F.col("p_type").alias("program"), F.concat(F.lit("v"), F.col("p_size").cast("string")).alias("key"), F.col("p_brand").alias("url"), (k % 13 == 0).alias("quoted"))


def edition(s, d, which):
    k = F.col("p_partkey")
    return read(s, d, "part").filter(k % 50 != which).select(k.alias("id"), F.when((k % 40 == 0) & (F.lit(which) == 1), F.upper("p_name")).otherwise(F.col("p_name")).alias("name"), (F.col("p_size") + F.lit(which) * (k % 60 == 0).cast("int")).alias("size"))


EDITION = "(SELECT p_partkey AS id, CASE WHEN p_partkey % 40 = 0 AND {0} = 1 THEN upper(p_name) ELSE p_name END AS name, p_size + {0} * CAST(p_partkey % 60 = 0 AS INT) AS size FROM part WHERE p_partkey % 50 <> {0})"


#: Sentences that speak of a license point at where a text comes from, not at what it says.
MARKER = r"\blicen[sc]ed?\b"


def clean_log(s, d):
    """The log of cleaning every text of three tables."""
    out = None
    for name, key in (("documents", F.col("doc_id")), ("pages", F.col("page_id")), ("conversations", F.concat_ws("/", "conv_id", "turn"))):
        rows = read(s, d, name)
        texts = [f.name for f in rows.schema.fields if f.dataType.simpleString() == "string"]
        shaped = rows.select(key.cast("string").alias("id"), F.struct(*texts).alias("texts"))
        log = op.cleaned(shaped, "id", MARKER)[1].select(F.lit(name).alias("tbl"), "id", F.regexp_replace("path", r"^texts\.", "").alias("path"), F.length("before").alias("n_before"), F.sha2("after", 256).alias("after_sha"))
        out = log if out is None else out.unionByName(log)
    return out


def _sql_clean(c: str) -> str:
    """The same steps; the tables hold entities by name only. The ampersand is decoded last, so that nothing is decoded twice."""
    out = f"regexp_replace(replace(regexp_replace({c}, '\\r\\n?', chr(10), 'g'), chr(160), ' '), '[\u200b\u200c\u200d\u2060\ufeff]', '', 'g')"
    for name, char in sorted(op.ENTITIES.items(), key=lambda x: x[0] == "amp"):
        out = f"replace({out}, '&{name};', '{char.replace(chr(39), chr(39) * 2)}')"
    out = f"regexp_replace(regexp_replace({out}, '<br\\s*/?>', chr(10), 'gi'), '</?[a-zA-Z][^>]*>', '', 'g')"
    out = f"regexp_replace(regexp_replace(regexp_replace({out}, '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"nullif(regexp_replace({out}, '^\\s+|\\s+$', '', 'g'), '')"


CLEAN = f"""WITH x AS (SELECT 'documents' AS tbl, CAST(doc_id AS VARCHAR) AS id, unnest(['text', 'lang', 'source']) AS path, unnest([text, lang, source]) AS b FROM documents UNION ALL SELECT 'pages', CAST(page_id AS VARCHAR), unnest(['url', 'html']), unnest([url, html]) FROM pages
  UNION ALL SELECT 'conversations', conv_id || '/' || turn, unnest(['role', 'text']), unnest([role, text]) FROM conversations),
 c AS (SELECT *, {_sql_clean('b')} AS t FROM x), m AS (SELECT *, regexp_replace(t, '\\s*\\([^()]*(?:\\blicen[sc]ed?\\b)[^()]*\\)', '', 'gi') AS u FROM c),
 a AS (SELECT tbl, id, path, b, CASE WHEN regexp_matches(t, '\\blicen[sc]ed?\\b', 'i') THEN nullif(regexp_replace(array_to_string(list_filter(list_transform(string_split(u, chr(10) || chr(10)), lambda p: array_to_string(list_filter(string_split(regexp_replace(p, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: NOT regexp_matches(x, '\\blicen[sc]ed?\\b', 'i')), ' ')), lambda p: p <> ''), chr(10) || chr(10)), '^\\s+|\\s+$', '', 'g'), '') ELSE t END AS a FROM m)
 SELECT tbl, id, path, CAST(length(b) AS INT) AS n_before, sha256(a) AS after_sha FROM a WHERE b IS NOT NULL AND a IS DISTINCT FROM b"""


def days_of(s, d):
    x = schedule.timed(sessions(s, d))
    return x.withColumn("day", schedule.festival_day(F.col("s")))


def windows(s, d):
    return days_of(s, d).filter("id % 2 = 0").groupBy("program").agg((F.min("day") + 2).alias("a"), (F.max("day") - 2).alias("b"))


#: In microdegrees; a strip of the customers lies outside.
REGION = (39_080_000, 39_136_000, -84_540_000, -84_480_000)


def decided(s, d):
    """The slices with coordinates merged: what has no name or is out of date goes."""
    k = F.col("k")
    where = places(s, d, "customer").select(F.col("id").alias("k"), F.when(k % 3 != 0, F.col("lat")).alias("lat"), F.when(k % 4 != 0, F.col("lng")).alias("lng"))
    rows = slices(s, d).drop("program").join(where, "k").withColumn("slice", F.floor(F.col("ord") / 1_000_000).cast("int")).withColumn("name", F.when(k % 29 != 0, F.col("name")))
    return op.merged_with_log(rows, ["name", "segment", "bio"], {"no name": F.col("name").isNull(), "out of date": k % 31 == 0}, REGION)


DECIDED = f"""WITH {SLICES}, {CUSTOMERS}, r AS (SELECT sl.id, sl.ord, ord // 1000000 AS slice, CASE WHEN k % 29 <> 0 THEN sl.name END AS name, segment, bio, CASE WHEN k % 3 <> 0 THEN lat END AS lat, CASE WHEN k % 4 <> 0 THEN lng END AS lng, k FROM sl JOIN cu ON cu.id = k),
 w AS (SELECT *, CASE WHEN name IS NULL THEN 'no name' WHEN k % 31 = 0 THEN 'out of date' END AS wrong FROM r), q AS (SELECT * FROM w WHERE wrong IS NULL),
 p AS (SELECT id, min(ord) AS lead, min(ord) FILTER (WHERE name IS NOT NULL) AS o_name, min(ord) FILTER (WHERE segment IS NOT NULL) AS o_segment, min(ord) FILTER (WHERE bio IS NOT NULL) AS o_bio,
  arg_min(lat, ord) FILTER (WHERE lat IS NOT NULL AND lng IS NOT NULL) AS lat, arg_min(lng, ord) FILTER (WHERE lat IS NOT NULL AND lng IS NOT NULL) AS lng FROM q GROUP BY id),
 f AS (SELECT id, lead, unnest(['name', 'segment', 'bio']) AS field, unnest([o_name, o_segment, o_bio]) AS source FROM p)
 SELECT 'drop' AS decision, CAST(id AS VARCHAR) AS id, CAST(ord AS VARCHAR) AS source, wrong AS detail FROM w WHERE wrong IS NOT NULL UNION ALL SELECT 'merge', CAST(q.id AS VARCHAR), CAST(ord AS VARCHAR), CAST(lead AS VARCHAR) FROM q JOIN p ON q.id = p.id WHERE ord <> lead
 UNION ALL SELECT 'fill', CAST(id AS VARCHAR), CAST(source AS VARCHAR), field FROM f WHERE source <> lead UNION ALL SELECT 'gap', CAST(id AS VARCHAR), NULL, field FROM f WHERE source IS NULL
 UNION ALL SELECT 'geo', CAST(id AS VARCHAR), NULL, lat || ', ' || lng FROM p WHERE NOT (lat BETWEEN {REGION[0]} AND {REGION[1]} AND lng BETWEEN {REGION[2]} AND {REGION[3]}) UNION ALL SELECT 'input', CAST(slice AS VARCHAR), NULL, CAST(count(*) AS VARCHAR) FROM w GROUP BY slice"""


def printed_texts(s, d):
    """Customers as printed entries: titles of common words, some in another spelling or called just Mural, and a line of credits."""
    k = F.col("c_custkey")
    words = F.array(*map(F.lit, TITLE_WORDS))
    word = lambda m: F.get(words, (k * m % len(TITLE_WORDS)).cast("int"))
    title = F.when(k % 11 == 0, "Mural").when(k % 3 == 0, F.concat(F.upper(word(7)), F.lit("! "), word(13))).otherwise(F.concat(F.lit("The "), word(7), F.lit(" "), word(13), F.lit(" "), word(17)))
    credit = F.when(k % 5 == 0, F.lit(None)).when(k % 2 == 0, F.concat(F.lit("Ané Artist"), k % 90)).otherwise(F.concat(F.lit("Studio"), k % 70, F.lit(" X Ane Artist"), k % 80))
    return read(s, d, "customer").select(k.alias("id"), title.alias("title"), credit.alias("credit"), (k % 3).alias("medium"))


def online_texts(s, d):
    """Suppliers as works with up to two names."""
    k = F.col("s_suppkey")
    words = F.array(*map(F.lit, TITLE_WORDS))
    word = lambda m: F.get(words, (k * m % len(TITLE_WORDS)).cast("int"))
    title = F.when(k % 7 == 0, F.concat(F.lit("Mural by Ane Artist"), k % 90)).otherwise(F.concat(word(7), F.lit(" & "), word(13)))
    names = F.when(k % 4 == 0, F.array().cast("array<string>")).when(k % 4 == 1, F.array(F.concat(F.lit("ANE artist"), k % 90))).otherwise(F.array(F.concat(F.lit("Studio "), k % 70), F.lit("x"), F.concat(F.lit("ane artist "), k % 80)))
    return read(s, d, "supplier").select(k.alias("id"), title.alias("title"), names.alias("names"), (k % 3).alias("medium"))


TITLE_WORDS = ["River", "Show", "Big", "TV", "Garden", "Lights", "Insane", "Echo", "the", "Paper", "Moon", "Cloud", "Station", "Mirror", "Tiger", "Song", "of", "Summer", "North", "Bridge", "Glass", "Atlas", "Ferry"]


def _score_sql() -> str:
    squash = lambda c: f"regexp_replace({c}, '[^a-z0-9]', '', 'g')"
    fold = lambda c: f"replace(replace(replace(lower(coalesce({c}, '')), 'é', 'e'), '&', ' and '), '!', 'i')"
    grams = lambda c: f"list_distinct(list_transform(range(1, length({c}) + 2), lambda i: substr('  ' || {c} || ' ', i, 3)))"
    sim = lambda a, b: f"len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b})))"
    words = lambda c: f"list_distinct(list_filter(regexp_split_to_array({c}, '[^a-z0-9]+'), lambda w: w NOT IN ('', {', '.join(repr(w) for w in similarity.STOPWORDS)})))"
    n = len(TITLE_WORDS)
    word = lambda k, m: f"{TITLE_WORDS}[{k} * {m} % {n} + 1]"
    return f"""WITH e0 AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 11 = 0 THEN 'Mural' WHEN c_custkey % 3 = 0 THEN upper({word('c_custkey', 7)}) || '! ' || {word('c_custkey', 13)} ELSE 'The ' || {word('c_custkey', 7)} || ' ' || {word('c_custkey', 13)} || ' ' || {word('c_custkey', 17)} END AS title,
  CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 2 = 0 THEN 'Ané Artist' || (c_custkey % 90) ELSE 'Studio' || (c_custkey % 70) || ' X Ane Artist' || (c_custkey % 80) END AS credit, c_custkey % 3 AS medium FROM customer),
 e1 AS (SELECT *, {fold('title')} AS ft, {squash(fold('credit'))} AS cq, list_transform(list_prepend(credit, regexp_split_to_array(credit, ',| X | and ')), lambda p: {squash(fold('p'))}) AS parts FROM e0),
 e2 AS (SELECT *, {squash("CASE WHEN ft = 'mural' THEN 'mural by ' || " + fold('credit') + " ELSE ft END")} AS tq FROM e1), e AS (SELECT id, medium, credit, cq, CASE WHEN ft = 'mural' THEN [] ELSE {words('ft')} END AS w, {grams('tq')} AS g, list_transform(parts, lambda p: {grams('p')}) AS pg FROM e2),
 o0 AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 7 = 0 THEN 'Mural by Ane Artist' || (s_suppkey % 90) ELSE {word('s_suppkey', 7)} || ' & ' || {word('s_suppkey', 13)} END AS title, s_suppkey % 3 AS medium,
  CASE WHEN s_suppkey % 4 = 0 THEN [] WHEN s_suppkey % 4 = 1 THEN ['aneartist' || (s_suppkey % 90)] ELSE ['studio' || (s_suppkey % 70), 'aneartist' || (s_suppkey % 80)] END AS names FROM supplier),
 o1 AS (SELECT *, {fold('title')} AS ft, {squash(fold('title'))} AS tq FROM o0), o AS (SELECT id, medium, {words('ft')} AS w, {grams('tq')} AS g, list_transform(names, lambda n: {{'n': n, 'g': {grams('n')}}}) AS names FROM o1),
 s AS (SELECT e.id AS a, o.id AS b, greatest({sim('e.g', 'o.g')}, CASE WHEN len(list_intersect(e.w, o.w)) >= 2 THEN len(list_intersect(e.w, o.w)) / least(len(e.w), len(o.w)) ELSE 0 END) AS t,
  CASE WHEN len(names) = 0 OR cq = '' THEN 0 ELSE len(list_filter(names, lambda n: contains(cq, n.n) OR contains(n.n, cq) OR len(list_filter(pg, lambda p: {sim('n.g', 'p')} >= 0.6)) > 0)) / len(names) END AS c FROM e JOIN o ON e.medium = o.medium)
 SELECT a, b, CAST(floor(t * 1000 + 1e-6) AS BIGINT) AS title, CAST(floor(c * 1000 + 1e-6) AS BIGINT) AS credit FROM s WHERE t + c >= 0.9 - 1e-9"""


QUERIES = {
    "remap_ids": (
        lambda s, d: op.remap_ids(slices(s, d).select("k", "id"), s.range(0, 600, 7).select(F.col("id").alias("drop"), (F.col("id") + 1).alias("keep")), "id").groupBy("id").agg(F.count("*").alias("n")),
        W + " SELECT CASE WHEN id % 7 = 0 THEN id + 1 ELSE id END AS id, count(*) AS n FROM sl GROUP BY 1",
    ),
    "merge_first_non_null": (
        lambda s, d: op.merge_first_non_null(slices(s, d), "id", "ord", ["name", "segment", "bio"], ["program"]),
        W + " SELECT id, arg_min(name, ord) AS name, arg_min(segment, ord) FILTER (WHERE segment IS NOT NULL) AS segment, arg_min(bio, ord) FILTER (WHERE bio IS NOT NULL) AS bio, string_agg(DISTINCT program, ',' ORDER BY program) AS program, count(*) AS n FROM sl GROUP BY id",
    ),
    "merge_people": (
        lambda s, d: op.merge_people(slices(s, d).select("id", "name", "program", "bio", "ord")),
        W + f", a AS (SELECT *, {KEY.format('name')} AS key FROM sl), l AS (SELECT id, arg_min(key, ord) AS lead FROM a GROUP BY id), b AS (SELECT a.*, CASE WHEN key = lead THEN CAST(a.id AS VARCHAR) ELSE a.id || '-' || program END AS nid FROM a JOIN l ON a.id = l.id) SELECT nid AS id, arg_min(name, ord) AS name, arg_min(bio, ord) FILTER (WHERE bio IS NOT NULL) AS bio, string_agg(DISTINCT program, ',' ORDER BY program) AS program, count(*) AS n FROM b GROUP BY nid",
    ),
    "merge_orgs": (
        lambda s, d: op.merge_orgs(organisations(s, d), same_orgs(s)).withColumn("roles", F.array_join(F.transform("roles", lambda r: F.concat_ws(":", r["program"], r["relationship"], F.coalesce(r["tier"], F.lit("-")))), ",")),
        ORGS,
    ),
    "merge_stays": (lambda s, d: op.merge_stays(listed_stays(s, d), ["address", "url"]), STAYS),
    "alias_join": (
        lambda s, d: op.alias_join(free_texts(s, d), "location", venue_names(s, d), venue_aliases(s, d)),
        rf"""WITH f AS (SELECT c_custkey AS c, CASE c_custkey % 3 WHEN 0 THEN 'the SUPPLIER#' || lpad(CAST(c_custkey % 150 AS VARCHAR), 9, '0') WHEN 1 THEN 'Hall  ' || (c_custkey % 40) || '!' ELSE 'somewhere' END AS location FROM customer),
 n AS (SELECT {KEY.format('s_name')} AS key, s_suppkey AS id, 0 AS p, 0 AS o FROM supplier UNION ALL SELECT {KEY.format("'Hall ' || (s_suppkey % 30)")}, s_suppkey, 1, -s_suppkey FROM supplier), k AS (SELECT key, arg_min(id, (p, o, id)) AS found FROM n GROUP BY key)
 SELECT c, location, found FROM f LEFT JOIN k ON {KEY.format('location')} = k.key""",
    ),
    "resolve_refs": (
        lambda s, d: sessions(s, d).join(read(s, d, "supplier").select(F.col("s_suppkey").cast("int").alias("venue"), F.col("s_nationkey").alias("n_nationkey")), "venue", "left").join(read(s, d, "nation"), "n_nationkey", "left").groupBy(F.coalesce("n_name", F.lit("unknown")).alias("hood")).agg(F.count("*").alias("n")),
        W + " SELECT coalesce(n_name, 'unknown') AS hood, count(*) AS n FROM x LEFT JOIN supplier ON venue = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey GROUP BY 1",
    ),
    "dangling_refs": (lambda s, d: op.dangling_refs(nested.references(shows(s, d), "id"), targets(s, d)), DANGLING),
    "referenced_only": (
        lambda s, d: op.referenced_only(venue_names(s, d), sessions(s, d).filter("featured").select(F.col("venue").cast("long").alias("id")), "id"),
        W + " SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey IN (SELECT venue FROM x WHERE featured)",
    ),
    "enrich_fill": (
        lambda s, d: op.enrich_fill(slices(s, d).select("k", "segment", "bio"), slices(s, d).filter("k % 2 = 0").select("k", F.lit("side").alias("segment"), F.concat(F.lit("from "), "program").alias("bio")), "k", ["segment", "bio"]),
        W + " SELECT k, coalesce(segment, CASE WHEN k % 2 = 0 THEN 'side' END) AS segment, coalesce(bio, CASE WHEN k % 2 = 0 THEN 'from ' || program END) AS bio, CAST(segment IS NULL AND k % 2 = 0 AS INT) + CAST(bio IS NULL AND k % 2 = 0 AS INT) AS n_filled FROM sl",
    ),
    "session_sponsors": (
        lambda s, d: read(s, d, "orders").select(F.col("o_custkey").alias("org"), F.explode(F.array(F.col("o_orderkey") % 500, F.col("o_orderkey") % 313)).alias("event")).groupBy("event").agg(F.countDistinct("org").alias("n_orgs"), F.min("org").alias("first_org")),
        "WITH o AS (SELECT o_custkey AS org, unnest([o_orderkey % 500, o_orderkey % 313]) AS event FROM orders) SELECT event, count(DISTINCT org) AS n_orgs, min(org) AS first_org FROM o GROUP BY event",
    ),
    "plan_join": (
        lambda s, d: op.plan_join(sessions(s, d).select("user_id", (F.col("id") * 3 % 14000).alias("id")), sessions(s, d).filter("not cancelled")),
        W + " SELECT p.user_id, count(x.id) AS n_known, count(*) FILTER (WHERE x.id IS NULL) AS n_unknown FROM (SELECT user_id, id * 3 % 14000 AS id FROM x) p LEFT JOIN (SELECT id FROM x WHERE NOT cancelled) x ON p.id = x.id GROUP BY p.user_id",
    ),
    "theta_time_check": (
        lambda s, d: op.recon_fields(priced(s, d, 0), priced(s, d, 1), ["id"], "start"),
        "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 0 THEN 'missing_a' WHEN o_orderkey % 9 = 1 THEN 'missing_b' WHEN o_orderkey % 10 = 0 THEN 'differs' ELSE 'same' END AS state FROM orders",
    ),
    "program_window_check": (
        lambda s, d: op.window_check(days_of(s, d), windows(s, d)).groupBy("program").agg(F.count("*").alias("n"), F.min("id").alias("first_id")),
        W + ", w AS (SELECT program, min(day) + 2 AS a, max(day) - 2 AS b FROM t WHERE id % 2 = 0 GROUP BY program) SELECT t.program, count(*) AS n, min(id) AS first_id FROM t JOIN w ON t.program = w.program WHERE day < a - 1 OR day > b + 1 GROUP BY t.program",
    ),
    "fuzzy_match_tiers": (lambda s, d: op.match_tiers(printed(s, d, "customer"), printed(s, d, "supplier")), TIERS),
    "trigram_similarity": (lambda s, d: similarity.text_scores(printed_texts(s, d), online_texts(s, d)), _score_sql()),
    "near_texts": (
        lambda s, d: similarity.near_texts(short_texts(s, d)),
        """WITH t AS (SELECT min(id) AS id, text FROM (SELECT item_id AS id, lower(text) AS text FROM benchmark UNION ALL SELECT item_id + 100000, lower(left(text, length(text) - 5) || ' end') FROM benchmark) GROUP BY text),
 g AS (SELECT DISTINCT id, substring('  ' || text || ' ', CAST(i AS INT), 3) AS g FROM (SELECT *, unnest(range(1, length(text) + 2)) AS i FROM t)), n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
 p AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2) SELECT a, b, CAST(floor(c / (x.n + y.n - c) * 1000) AS BIGINT) AS permille FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE c / (x.n + y.n - c) >= 0.5""",
    ),
    "role_inference": (
        lambda s, d: op.role_inference(credits(s, d), rules(s)),
        f"""WITH c AS (SELECT c_custkey % 300 AS person, c_custkey % 7 AS event, c_custkey AS ord, CASE WHEN c_custkey % 3 = 0 THEN {LABELS_SQL}[c_custkey * 7 % 11 + 1] END AS label,
 c_custkey % 5 = 0 AS curated, ['exhibition', 'talk', 'concert'][c_custkey % 7 % 3 + 1] AS kind, [[], ['moderator'], ['curator', 'artist'], ['host', 'speaker']][c_custkey % 300 % 4 + 1] AS roles FROM customer),
 p AS (SELECT person, event, min_by(label, ord) FILTER (WHERE label IS NOT NULL) AS label, bool_or(curated) AS curated, any_value(kind) AS kind, min_by(roles, ord) AS roles FROM c GROUP BY person, event),
 f AS (SELECT *, coalesce(roles[1], 'artist') AS one, {FOUND_SQL} AS found,
 list_filter(CASE kind WHEN 'exhibition' THEN ['artist', 'curator'] WHEN 'talk' THEN ['speaker', 'moderator', 'curator', 'artist'] ELSE ['performer', 'speaker', 'artist'] END, lambda r: list_contains(roles, r))[1] AS by_kind FROM p)
 SELECT person, event, CASE WHEN label IS NOT NULL THEN coalesce(found, one) WHEN curated THEN 'curator' WHEN len(roles) = 1 THEN one ELSE coalesce(by_kind, one) END AS role FROM f""",
    ),
    "page_policy": (
        lambda s, d: op.page_policy(read(s, d, "customer").select(F.col("c_custkey").alias("person"), (F.col("c_custkey") % 5 == 0).alias("bio"), (F.col("c_custkey") % 7 == 0).alias("photo"), (F.col("c_custkey") % 11 == 0).alias("already")), sessions(s, d).select(F.col("user_id").alias("person"), F.col("featured").alias("key_role"))),
        W + " SELECT c_custkey AS person, c_custkey % 5 = 0 OR c_custkey % 7 = 0 OR c_custkey % 11 = 0 OR c_custkey IN (SELECT user_id FROM x WHERE featured) AS kept FROM customer",
    ),
    "credit_buckets": (
        lambda s, d: credits(s, d).groupBy("event", "label").agg(F.countDistinct("person").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_set("person")), lambda x: x.cast("string")), ",").alias("names")),
        f"WITH c AS (SELECT c_custkey % 300 AS person, c_custkey % 7 AS event, CASE WHEN c_custkey % 3 = 0 THEN {LABELS_SQL}[c_custkey * 7 % 11 + 1] END AS label FROM customer) SELECT event, label, count(DISTINCT person) AS n, string_agg(DISTINCT person, ',' ORDER BY person) AS names FROM c GROUP BY 1, 2",
    ),
    "text_clean_job": (clean_log, CLEAN),
    "decision_log": (lambda s, d: decided(s, d)[1], DECIDED),
    "facts_union": (
        lambda s, d: op.facts_union(facts(s, d, 0), facts(s, d, 1)).select("program", "key", "url", "ord"),
        "WITH f AS (SELECT p_partkey AS ord, p_partkey % 2 AS src, p_type AS program, 'v' || p_size AS key, p_brand AS url, p_partkey % 13 = 0 AS quoted FROM part) SELECT program, key, url, ord FROM (SELECT *, row_number() OVER (PARTITION BY program, key, url ORDER BY src, ord) AS rn FROM f WHERE NOT quoted) WHERE rn = 1 UNION ALL SELECT program, key, url, ord FROM f WHERE quoted",
    ),
    "unique_ids": (
        lambda s, d: op.unique_ids(read(s, d, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("-")).alias("slug")), "slug", "p_partkey").select("p_partkey", "unique_id"),
        "SELECT p_partkey, replace(p_name, ' ', '-') || CASE WHEN row_number() OVER w = 1 THEN '' ELSE '-' || row_number() OVER w END AS unique_id FROM part WINDOW w AS (PARTITION BY p_name ORDER BY p_partkey)",
    ),
    "changelog": (
        lambda s, d: op.changelog(edition(s, d, 0), edition(s, d, 1), "id", ["name", "size"]),
        f"WITH o AS {EDITION.format(0)}, n AS {EDITION.format(1)}, j AS (SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' ELSE 'changed' END AS state, o.name AS a, n.name AS b, CAST(o.size AS VARCHAR) AS c, CAST(n.size AS VARCHAR) AS e FROM o FULL JOIN n ON o.id = n.id) SELECT id, state, 'name' AS field, a AS old, b AS new FROM j WHERE a IS DISTINCT FROM b UNION ALL SELECT id, state, 'size', c, e FROM j WHERE c IS DISTINCT FROM e",
    ),
}
