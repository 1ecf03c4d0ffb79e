"""Directory queries over the lenses, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import directory as op
from tessera.operators import schedule
from tessera.plans.lenses import CUSTOMERS, NOW, SESSIONS, SUPPLIERS, places, read, sessions

PARTS = "pt AS (SELECT p_partkey AS id, p_name AS name, p_brand AS brand, p_type AS type, p_size AS size, CAST(trunc(p_retailprice) AS BIGINT) % 2 = 0 AS even FROM part)"
W = f"WITH {SESSIONS}, {PARTS}, {SUPPLIERS}, {CUSTOMERS}"
PROGRAMS = ["click", "error", "purchase", "signup", "view"]
STATE = {"brand": ["Brand#1", "Brand#2", "Brand#3", "Brand#4"], "type": ["PROMO", "SMALL"]}
IN = {"brand": "brand IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4')", "type": "type IN ('PROMO', 'SMALL')", "size": "true"}


def parts(s, d):
    return read(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").alias("size"), (F.col("p_retailprice").cast("long") % 2 == 0).alias("even"))


def states(s, d):
    """One saved state for every nation: a brand, a type, a term or none of them."""
    k = F.col("n_nationkey")
    types = F.array(*map(F.lit, ["PROMO", "SMALL", "ECONOMY", "MEDIUM"]))
    return read(s, d, "nation").select(k.alias("qid"), F.when(k % 2 == 0, F.concat(F.lit("Brand#"), k.cast("string"))).alias("q_brand"), F.when(k % 3 == 0, F.get(types, k % 4)).alias("q_type"), F.when(k % 5 == 0, "red").alias("q_term"))


STATES = "st AS (SELECT n_nationkey AS qid, CASE WHEN n_nationkey % 2 = 0 THEN 'Brand#' || n_nationkey END AS q_brand, CASE WHEN n_nationkey % 3 = 0 THEN ['PROMO', 'SMALL', 'ECONOMY', 'MEDIUM'][n_nationkey % 4 + 1] END AS q_type, CASE WHEN n_nationkey % 5 = 0 THEN 'red' END AS q_term FROM nation)"


def state_pairs(s, d):
    c = read(s, d, "customer")
    return c.select(F.col("c_nationkey").alias("qid"), F.explode(F.array(F.struct(F.lit("segment").alias("key"), F.col("c_mktsegment").alias("value")), F.struct(F.lit("brand").alias("key"), F.concat(F.lit("Brand#"), (F.col("c_custkey") % 40).cast("string")).alias("value")))).alias("x")).select("qid", "x.key", "x.value")


def allowed(s, d):
    a = read(s, d, "customer").select(F.lit("segment").alias("key"), F.col("c_mktsegment").alias("value")).filter("value <> 'MACHINERY'")
    return a.unionByName(parts(s, d).select(F.lit("brand").alias("key"), F.col("brand").alias("value")))


def people(s, d):
    c = read(s, d, "customer")
    role = F.array(F.lit("R0"), F.concat(F.lit("R"), (F.col("c_custkey") % 3).cast("string")), F.concat(F.lit("R"), (F.col("c_custkey") % 7).cast("string")))
    return c.select(F.col("c_custkey").alias("person"), F.explode(F.array_distinct(role)).alias("role"), (F.col("c_acctbal") * 100).cast("long").alias("score"))


PEOPLE = "pe AS (SELECT DISTINCT c_custkey AS person, unnest(['R0', 'R' || (c_custkey % 3), 'R' || (c_custkey % 7)]) AS role, CAST(trunc(c_acctbal * 100) AS BIGINT) AS score FROM customer)"


def orgs(s, d):
    k = F.col("s_suppkey")
    return read(s, d, "supplier").select((k % 40).alias("org"), F.concat(F.lit("P"), (k % 6).cast("string")).alias("program"), F.concat(F.lit("tier"), (k * 7 % 5).cast("string")).alias("tier"), F.when(k * 7 % 5 < 3, 9 - k * 7 % 5).alias("tier_rank"), k.alias("ord"))


def stays(s, d):
    k = F.col("s_suppkey")
    return read(s, d, "supplier").select(k.alias("id"), F.col("s_name").alias("name"), (k % 9 == 0).alias("block"), F.when(k % 5 != 0, k * 131 % 5000).alias("metres"))


def feed(s, d, which):
    p = read(s, d, "pages").select(F.col("page_id").alias("ord"), F.concat(F.lit("k"), (F.col("page_id") % 90).cast("string")).alias("key"), F.concat(F.lit("t"), F.col("page_id").cast("string")).alias("title"), F.when(F.col("page_id") % 4 == 0, F.col("url")).alias("image"), F.concat(F.lit("P"), (F.col("page_id") % 5).cast("string")).alias("program"))
    return p.filter(F.col("ord") % 2 == which)


def links(s, d, which):
    """Two editions of a manifest: pages with a version that some changed, some lost."""
    p = read(s, d, "pages").select(F.col("page_id").alias("id"), "url", (F.lit(which) * (F.col("page_id") % 3 == 0).cast("int")).alias("version"))
    return p.filter(F.col("id") % 7 != which)


def candidates(s, d):
    return read(s, d, "pages").select(F.col("page_id").alias("id"), F.concat(F.lit("t"), (F.col("page_id") % 120).cast("string")).alias("title"), "url")


def views(s, d):
    k = F.col("n_nationkey")
    return read(s, d, "nation").select(k.alias("view"), (39_080_000 + k * 1000).alias("lat0"), (39_100_000 + k * 1000).alias("lat1"), (-84_540_000 + k * 800).alias("lng0"), (-84_510_000 + k * 800).alias("lng1"))


def activity(s, d):
    """Venue rows with their live sessions."""
    return schedule.timed(sessions(s, d)).groupBy("venue").agg(F.count("*").alias("n")).withColumn("hood", F.concat(F.lit("H"), (F.col("venue") % 7).cast("string")))


def facet_sql() -> str:
    each = []
    for f in ("brand", "type", "size"):
        others = " AND ".join(IN[g] for g in IN if g != f)
        each.append(f"SELECT '{f}' AS facet, CAST({f} AS VARCHAR) AS value, count(*) AS n FROM pt WHERE contains(lower(name), 're') AND {others} GROUP BY 2")
    return W + " " + " UNION ALL ".join(each)


def chip_sql() -> str:
    live = "NOT cancelled AND NOT tu AND NOT ad AND NOT og"
    return W + f", c AS (SELECT program, kind, 'D' || (CAST(floor((s - 18000) / 86400) AS BIGINT) % 7) AS day FROM x WHERE {live}) SELECT 'program' AS facet, program AS value, count(*) AS n FROM c WHERE kind IN ('K1', 'K2') GROUP BY 2 UNION ALL SELECT 'kind', kind, count(*) FROM c WHERE program IN ('view') GROUP BY 2 UNION ALL SELECT 'day', day, count(*) FROM c WHERE kind IN ('K1', 'K2') AND program IN ('view') GROUP BY 2"


def chips(s, d):
    rows = schedule.timed(sessions(s, d)).withColumn("day", F.concat(F.lit("D"), F.pmod(schedule.festival_day(F.col("s")), F.lit(7)).cast("string")))
    return op.facet_counts(rows, ["program", "kind", "day"], {"program": ["view"], "kind": ["K1", "K2"]})


GROUPS = "(SELECT 'K' || i AS kind, 'G' || (i % 2) AS grp FROM range(6) t(i))"


def groups(s, d):
    return s.range(6).select(F.concat(F.lit("K"), F.col("id").cast("string")).alias("kind"), F.concat(F.lit("G"), (F.col("id") % 2).cast("string")).alias("grp"))


def costs(s, d):
    """A cost note for each part: prices of the table in several wordings, and wordings of free."""
    k, price = F.col("p_partkey"), F.format_string("%.2f", F.col("p_retailprice").cast("double"))
    notes = [
        F.lit("Free"), F.lit(" FREE, drop-in."), F.lit("free with registration"), F.lit("Free for Biennial Pass Holders"), F.lit("Free add-on to a ticket"), F.concat(F.lit("$"), price), F.concat(F.lit("Tickets start at $ "), price),
        F.concat(F.lit("$"), price, F.lit(", free for kids")), F.lit("$0.00 with a ticket ($300)"), F.lit("Drinks are free"), F.lit("Tickets at the door"), F.lit("This is a FREE EVENT, please register"), F.lit("Freedom pass $5"), F.lit(None), F.lit(""),
    ]
    return read(s, d, "part").select(k.alias("id"), F.get(F.array(*notes), (k % len(notes)).cast("int")).alias("cost"))


COSTS = """(SELECT p_partkey AS id, trim(lower(['Free', ' FREE, drop-in.', 'free with registration', 'Free for Biennial Pass Holders', 'Free add-on to a ticket', '$' || printf('%.2f', CAST(p_retailprice AS DOUBLE)), 'Tickets start at $ ' || printf('%.2f', CAST(p_retailprice AS DOUBLE)),
 '$' || printf('%.2f', CAST(p_retailprice AS DOUBLE)) || ', free for kids', '$0.00 with a ticket ($300)', 'Drinks are free', 'Tickets at the door', 'This is a FREE EVENT, please register', 'Freedom pass $5', NULL, ''][p_partkey % 15 + 1])) AS c FROM part)"""
LIVE = "NOT cancelled AND NOT tu AND NOT ad AND NOT og"

def audit(s, d):
    """The ten counters: events, venues, works (parts) and people (customers), each in one pass."""
    i, k = F.col("id"), F.col("k")
    events = sessions(s, d).filter("not cancelled").withColumns({"description": F.when(i % 7 != 0, F.col("title")), "free": F.when(i % 5 != 0, i % 2 == 0), "location": F.when(i % 3 == 0, "not listed").when(i % 3 == 1, "a hall")})
    venues = places(s, d, "supplier").select(F.when(i % 13 != 0, F.col("lat")).alias("lat"))
    works = read(s, d, "part").select(F.col("p_partkey").alias("k"), F.when(F.col("p_size") > 5, F.col("p_name")).alias("description"))
    people = read(s, d, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_name")).alias("bio"))
    return op.unknown_audit({
        "events": (events, {"end not listed": F.col("eu"), "hours not listed": F.col("tu"), "location not listed": (F.col("venue") >= 80) & (F.col("location").isNull() | (F.col("location") == "not listed")), "no description": F.col("description").isNull(), "price not stated": F.col("free").isNull()}),
        "venues": (venues, {"no address": F.col("lat").isNull(), "no such thing": F.lit(False)}), "works": (works, {"work without description": F.col("description").isNull(), "work without photo": k % 11 == 0}),
        "people": (people, {"no bio": F.col("bio").isNull(), "no headshot": k % 10 != 0}),
    })


AUDIT = W + """, e AS (SELECT * FROM x WHERE NOT cancelled), a AS (SELECT 'end not listed' AS counter, count(*) AS n FROM e WHERE eu UNION ALL SELECT 'hours not listed', count(*) FROM e WHERE tu UNION ALL SELECT 'location not listed', count(*) FROM e WHERE venue >= 80 AND id % 3 <> 1
 UNION ALL SELECT 'no description', count(*) FROM e WHERE id % 7 = 0 UNION ALL SELECT 'price not stated', count(*) FROM e WHERE id % 5 = 0 UNION ALL SELECT 'no address', count(*) FROM sp WHERE id % 13 = 0 UNION ALL SELECT 'work without description', count(*) FROM part WHERE p_size <= 5
 UNION ALL SELECT 'work without photo', count(*) FROM part WHERE p_partkey % 11 = 0 UNION ALL SELECT 'no bio', count(*) FROM customer WHERE c_custkey % 4 <> 0 UNION ALL SELECT 'no headshot', count(*) FROM customer WHERE c_custkey % 10 <> 0) SELECT * FROM a WHERE n > 0"""


def rollup(s, d):
    """Six kinds by hood: events by their venue's, venues, works, food, stays and landmarks; two hoods have no summary."""
    hood = F.concat(F.lit("H"), (F.col("p_partkey") % 8).cast("string"))
    parts_of = read(s, d, "part").select(hood.alias("hood"), (F.col("p_partkey") % 3).alias("kind"))
    venue = places(s, d, "supplier").select(F.col("id").cast("int").alias("venue"), "hood")
    rows = {
        "events": sessions(s, d).filter("not cancelled").join(venue, "venue"), "venues": venue, "works": parts_of.filter("kind = 0"), "food": parts_of.filter("kind = 1"), "stays": places(s, d, "customer"), "landmarks": parts_of.filter("kind = 2"),
    }
    k = F.col("id")
    hoods = s.range(9).select(F.concat(F.lit("H"), k.cast("string")).alias("hood"), F.concat(F.lit("Hood "), (10 - k).cast("string")).alias("name"), F.when(k % 4 != 1, "about it").alias("summary"))
    return op.hood_rollup({n: df.select("hood") for n, df in rows.items()}, {"events": 2, "venues": 1, "food": 1, "stays": 1}, hoods)


ROLLUP = W + """, p AS (SELECT 'H' || (p_partkey % 8) AS hood, p_partkey % 3 AS kind FROM part), h AS (SELECT 'H' || k AS hood, 'Hood ' || (10 - k) AS name, k % 4 = 1 AS bare FROM (SELECT unnest(range(9)) AS k)),
 a AS (SELECT hood, 'e' AS k FROM x JOIN sp ON venue = sp.id WHERE NOT cancelled UNION ALL SELECT hood, 'v' FROM sp UNION ALL SELECT hood, ['w', 'f', 'l'][kind + 1] FROM p UNION ALL SELECT hood, 's' FROM cu),
 c AS (SELECT h.hood, name, bare, count(*) FILTER (WHERE k = 'e') AS n_events, count(*) FILTER (WHERE k = 'v') AS n_venues, count(*) FILTER (WHERE k = 'w') AS n_works, count(*) FILTER (WHERE k = 'f') AS n_food, count(*) FILTER (WHERE k = 's') AS n_stays, count(*) FILTER (WHERE k = 'l') AS n_landmarks FROM h LEFT JOIN a ON a.hood = h.hood GROUP BY h.hood, name, bare),
 w AS (SELECT *, 2 * n_events + n_venues + n_food + n_stays AS weight FROM c) SELECT hood, n_events, n_venues, n_works, n_food, n_stays, n_landmarks, weight, CAST(row_number() OVER (ORDER BY bare, weight DESC, name) AS INT) AS place FROM w"""

QUERIES = {
    "filter_by_state": (
        lambda s, d: op.filter_by_state(parts(s, d), {"brand": ["Brand#1", "Brand#2"], "even": True, "q": "RE", "size": None}).select("id", "name", "brand"),
        W + " SELECT id, name, brand FROM pt WHERE brand IN ('Brand#1', 'Brand#2') AND even AND contains(lower(name), 're')",
    ),
    "batch_filter_queries": (lambda s, d: op.batch_filter_queries(parts(s, d), states(s, d)), W + f", {STATES} SELECT qid, count(*) AS n FROM pt JOIN st ON (q_brand IS NULL OR q_brand = brand) AND (q_type IS NULL OR q_type = type) AND (q_term IS NULL OR contains(name, q_term)) GROUP BY qid"),
    "validate_filter_state": (
        lambda s, d: op.validate_filter_state(state_pairs(s, d), allowed(s, d)),
        W + """, p AS (SELECT c_nationkey AS qid, 'segment' AS key, c_mktsegment AS value FROM customer UNION ALL SELECT c_nationkey, 'brand', 'Brand#' || (c_custkey % 40) FROM customer),
 a AS (SELECT DISTINCT 'segment' AS key, c_mktsegment AS value FROM customer WHERE c_mktsegment <> 'MACHINERY' UNION SELECT DISTINCT 'brand', brand FROM pt)
 SELECT qid, coalesce(string_agg(DISTINCT p.key || '=' || p.value, '&' ORDER BY p.key || '=' || p.value) FILTER (WHERE a.key IS NOT NULL), '') AS canonical, count(*) FILTER (WHERE a.key IS NULL) AS n_dropped FROM p LEFT JOIN a ON p.key = a.key AND p.value = a.value GROUP BY qid""",
    ),
    "kind_group_rollup": (lambda s, d: op.group_rollup(sessions(s, d), groups(s, d)), W + f" SELECT grp, count(DISTINCT title) FILTER (WHERE NOT og AND NOT tu AND NOT ad) AS n_timed, count(DISTINCT title) FILTER (WHERE og) AS n_ongoing FROM x JOIN {GROUPS} g ON x.kind = g.kind WHERE NOT cancelled GROUP BY grp"),
    "free_classifier": (
        lambda s, d: costs(s, d).select("id", op.free_class(F.col("cost")).alias("free")),
        rf"""SELECT id, CASE WHEN starts_with(c, 'free to the public') OR starts_with(c, 'free admission') OR starts_with(c, 'this is a free event') OR starts_with(c, 'entry is free') THEN 'yes'
 WHEN regexp_matches(c, '^free\b') AND NOT regexp_matches(c, '^free\s+((to|for)\s+(biennial\s+)?pass|with|add-on)') THEN 'yes'
 WHEN regexp_matches(c, '\$\s?[0-9]') AND NOT contains(c, 'free') AND NOT contains(c, '$0.00') THEN 'no' ELSE 'unknown' END AS free FROM {COSTS}""",
    ),
    "facet_counts": (lambda s, d: op.facet_counts(parts(s, d), ["brand", "type", "size"], STATE, "re"), facet_sql()),
    "chip_counts": (chips, chip_sql()),
    "count_matrix": (lambda s, d: op.count_matrix(sessions(s, d), "kind", "program", PROGRAMS), W + " SELECT kind, " + ", ".join(f"count(DISTINCT title) FILTER (WHERE program = '{p}') AS c_{p}" for p in PROGRAMS) + ", count(DISTINCT title) AS total FROM x GROUP BY kind"),
    "unknown_audit": (audit, AUDIT),
    "hood_rollup": (rollup, ROLLUP),
    "top_venues_per_hood": (
        lambda s, d: op.top_per_group(activity(s, d), ["hood"], [F.col("n").desc(), F.col("venue")], 8),
        W + f", a AS (SELECT venue, count(*) AS n, 'H' || (venue % 7) AS hood FROM x WHERE {LIVE} GROUP BY venue) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hood ORDER BY n DESC, venue) AS rank FROM a) WHERE rank <= 8",
    ),
    "role_popularity": (lambda s, d: people(s, d).groupBy("role").agg(F.count("*").alias("n")), f"WITH {PEOPLE} SELECT role, count(*) AS n FROM pe GROUP BY role"),
    "role_sections": (
        lambda s, d: op.role_sections(people(s, d)),
        f"""WITH {PEOPLE}, top AS (SELECT role, row_number() OVER (ORDER BY count(*) DESC, role) AS section FROM pe GROUP BY role ORDER BY count(*) DESC, role LIMIT 3),
 q AS (SELECT section, role, person, score FROM pe JOIN top USING (role)),
 a AS (SELECT * FROM q WHERE section = 1 ORDER BY score DESC, person LIMIT 8), b AS (SELECT * FROM q WHERE section = 2 AND person NOT IN (SELECT person FROM a) ORDER BY score DESC, person LIMIT 8),
 c AS (SELECT * FROM q WHERE section = 3 AND person NOT IN (SELECT person FROM a UNION ALL SELECT person FROM b) ORDER BY score DESC, person LIMIT 8)
 SELECT section, role, person FROM a UNION ALL SELECT section, role, person FROM b UNION ALL SELECT section, role, person FROM c""",
    ),
    "medium_zone_counts": (lambda s, d: op.grouping_counts(parts(s, d), ["brand", "type", "size"]), W + " " + " UNION ALL ".join(f"SELECT '{c}' AS facet, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM pt GROUP BY 2" for c in ("brand", "type", "size"))),
    "modal_label": (
        lambda s, d: op.modal_label(parts(s, d).withColumn("label", F.when(F.col("id") % 3 == 0, F.upper("type")).otherwise(F.initcap("type"))), F.lower("type"), "label", "id"),
        W + ", l AS (SELECT id, lower(type) AS key, CASE WHEN id % 3 = 0 THEN upper(type) ELSE upper(type[1]) || lower(type[2:]) END AS label FROM pt), c AS (SELECT key, label, count(*) AS n, min(id) AS f FROM l GROUP BY key, label) SELECT key, arg_max(label, (n, -f)) AS label, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY key",
    ),
    "tier_walls": (
        lambda s, d: op.tier_walls(orgs(s, d)),
        """WITH o AS (SELECT s_suppkey % 40 AS org, 'P' || (s_suppkey % 6) AS program, 'tier' || (s_suppkey * 7 % 5) AS tier, CASE WHEN s_suppkey * 7 % 5 < 3 THEN 9 - s_suppkey * 7 % 5 END AS r, s_suppkey AS ord FROM supplier),
 t AS (SELECT program, tier, row_number() OVER (PARTITION BY program ORDER BY min(r) NULLS LAST, min(ord)) AS wall FROM o GROUP BY program, tier), g AS (SELECT program, tier, org, min(ord) AS ord FROM o GROUP BY ALL)
 SELECT g.program, wall, g.tier, org, row_number() OVER (PARTITION BY g.program, g.tier ORDER BY ord) AS place FROM g JOIN t ON g.program = t.program AND g.tier = t.tier""",
    ),
    "facility_zone_pivot": (lambda s, d: op.listed_pivot(parts(s, d), "type", "brand", "size"), W + " SELECT type, brand, count(*) AS n, array_to_string(list_sort(list(DISTINCT size))[1:5], ',') AS first_numbers FROM pt GROUP BY type, brand"),
    "zone_rank": (lambda s, d: op.zone_rank(parts(s, d), "type", "brand", "id"), W + " SELECT type, brand, least, n, row_number() OVER (PARTITION BY type ORDER BY least, brand) AS rank FROM (SELECT type, brand, min(id) AS least, count(*) AS n FROM pt GROUP BY type, brand)"),
    "source_hosts": (
        lambda s, d: op.source_hosts(read(s, d, "pages").withColumn("program", F.concat(F.lit("P"), (F.col("page_id") % 5).cast("string"))), "program", "url"),
        "SELECT 'P' || (page_id % 5) AS program, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\\.', '') AS host, count(*) AS n, min(url) AS example FROM pages GROUP BY 1, 2",
    ),
    "derived_membership": (
        lambda s, d: op.derived_membership(sessions(s, d).filter("id % 3 = 0").select(F.col("user_id").alias("person"), "program"), sessions(s, d).filter("id % 5 < 2").select(F.col("user_id").alias("person"), "program")),
        W + ", a AS (SELECT DISTINCT user_id AS person, program FROM x WHERE id % 3 = 0), b AS (SELECT DISTINCT user_id AS person, program FROM x WHERE id % 5 < 2), f AS (SELECT coalesce(a.person, b.person) AS person, coalesce(a.program, b.program) AS program, a.person IS NULL AS na, b.person IS NULL AS nb FROM a FULL JOIN b ON a.person = b.person AND a.program = b.program) SELECT person, string_agg(program, ',' ORDER BY program) AS programs, count(*) FILTER (WHERE na) AS n_added, count(*) FILTER (WHERE nb) AS n_unseen FROM f GROUP BY person",
    ),
    "venue_activity": (lambda s, d: op.venue_activity(sessions(s, d)), W + " SELECT venue, string_agg(DISTINCT program, ',' ORDER BY program) AS programs, count(*) AS n, row_number() OVER (ORDER BY min(id)) AS stall FROM x GROUP BY venue"),
    "featured_per_day": (
        lambda s, d: op.featured_per_day(sessions(s, d), schedule.festival_day(F.col("s"))),
        W + " SELECT day, id, s FROM (SELECT CAST(floor((s - 18000) / 86400) AS BIGINT) AS day, id, s, row_number() OVER (PARTITION BY floor((s - 18000) / 86400) ORDER BY s, id) AS rn FROM x WHERE featured AND NOT og AND NOT cancelled) WHERE rn = 1",
    ),
    "faq_topics": (lambda s, d: op.topics(parts(s, d), "type", "size", "name"), W + " SELECT type, size, count(*) AS n, min(name) AS first_item, max(name) AS last_item FROM pt GROUP BY type, size"),
    "news_sections": (
        lambda s, d: op.news_sections(sessions(s, d), NOW),
        W + f", l AS (SELECT program, string_agg(id, ',' ORDER BY id) AS latest FROM (SELECT *, row_number() OVER (PARTITION BY program ORDER BY s DESC, id) AS rn FROM x) WHERE rn <= 5 GROUP BY program) SELECT x.program, count(*) FILTER (WHERE s >= {NOW}) AS n_current, count(*) FILTER (WHERE s < {NOW}) AS n_background, any_value(latest) AS latest FROM x JOIN l ON x.program = l.program GROUP BY x.program",
    ),
    "off_view_summary": (
        lambda s, d: op.off_view_summary(views(s, d), places(s, d, "customer")),
        W + """, v AS (SELECT n_nationkey AS view, 39080000 + n_nationkey * 1000 AS lat0, 39100000 + n_nationkey * 1000 AS lat1, -84540000 + n_nationkey * 800 AS lng0, -84510000 + n_nationkey * 800 AS lng1 FROM nation),
 o AS (SELECT view, CASE WHEN lat > lat1 THEN 'N' WHEN lat < lat0 THEN 'S' ELSE '' END || CASE WHEN lng > lng1 THEN 'E' WHEN lng < lng0 THEN 'W' ELSE '' END AS direction, hood, count(*) AS c FROM cu JOIN v ON lat > lat1 OR lat < lat0 OR lng > lng1 OR lng < lng0 GROUP BY ALL)
 SELECT view, direction, CAST(sum(c) AS BIGINT) AS n, arg_min(hood, (-c, hood)) AS hood FROM o GROUP BY view, direction""",
    ),
    "slice_counts": (
        lambda s, d: read(s, d, "orders").groupBy((F.col("o_orderkey") % 8).alias("slice"), F.col("o_orderstatus").alias("file")).agg(F.count("*").alias("n")),
        "SELECT o_orderkey % 8 AS slice, o_orderstatus AS file, count(*) AS n FROM orders GROUP BY 1, 2",
    ),
    "az_index": (
        lambda s, d: op.az_index(read(s, d, "documents"), F.col("text"), "doc_id"),
        r"WITH f AS (SELECT strip_accents(lower(regexp_replace(text, '^[^\p{L}\p{N}]+', ''))) AS fold, doc_id FROM documents), g AS (SELECT CASE WHEN regexp_matches(upper(substring(fold, 1, 1)), '^[A-Z]$') THEN upper(substring(fold, 1, 1)) ELSE '#' END AS letter, fold, doc_id FROM f) SELECT letter, count(*) AS n, arg_min(doc_id, (fold, doc_id)) AS first_id FROM g GROUP BY letter",
    ),
    "stay_order": (lambda s, d: op.stay_order(stays(s, d)).select("id", "place"), "SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_suppkey % 9 = 0 DESC, CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey * 131 % 5000 ELSE 1000000000 END, s_name) AS place FROM supplier"),
    "program_rankings": (
        lambda s, d: op.top_per_group(parts(s, d), ["type"], [F.col("even").desc(), F.col("size").desc(), F.col("name"), F.col("id")], 12).select("type", "rank", "id"),
        W + " SELECT type, rank, id FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY even DESC, size DESC, name, id) AS rank FROM pt) WHERE rank <= 12",
    ),
    "union_with_precedence": (
        lambda s, d: op.union_with_precedence(feed(s, d, 0), feed(s, d, 1)),
        "WITH f AS (SELECT page_id AS ord, page_id % 2 AS p, 'k' || (page_id % 90) AS key, 't' || page_id AS title, CASE WHEN page_id % 4 = 0 THEN url END AS image, 'P' || (page_id % 5) AS program FROM pages) SELECT key, arg_min(title, (p, ord)) AS title, arg_min(image, (p, ord)) FILTER (WHERE image IS NOT NULL) AS image, string_agg(DISTINCT program, ',' ORDER BY program) AS programs, count(*) AS n FROM f GROUP BY key",
    ),
    "new_minus_existing": (
        lambda s, d: op.new_minus_existing(candidates(s, d).filter("id % 2 = 1"), candidates(s, d).filter("id % 2 = 0 and id < 100"), ["id", "title", "url"]).select("id", "title"),
        "WITH c AS (SELECT page_id AS id, 't' || (page_id % 120) AS title, url FROM pages), o AS (SELECT * FROM c WHERE id % 2 = 0 AND id < 100) SELECT id, title FROM c WHERE id % 2 = 1 AND title NOT IN (SELECT title FROM o) AND url NOT IN (SELECT url FROM o)",
    ),
    "symmetric_recon": (lambda s, d: op.symmetric_recon(links(s, d, 0), links(s, d, 1), "id"), "SELECT CASE WHEN page_id % 7 = 0 THEN 'only_b' WHEN page_id % 7 = 1 THEN 'only_a' ELSE 'both' END AS side, count(*) AS n FROM pages GROUP BY 1"),
    "stale_entries": (lambda s, d: op.stale_entries(links(s, d, 1), links(s, d, 0)), "SELECT page_id AS id, CASE WHEN page_id % 7 = 0 THEN 'new' WHEN page_id % 7 = 1 THEN 'orphan' WHEN page_id % 3 = 0 THEN 'changed' ELSE 'same' END AS state FROM pages"),
}
