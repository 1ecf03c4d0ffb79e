"""Geo and search queries over the lenses, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.geo import METRES_SQL, walk_minutes
from tessera.operators import geo as op
from tessera.operators import schedule, search
from tessera.plans.lenses import CUSTOMERS, NOW, SESSIONS, SUPPLIERS, places, read, sessions
from tessera.plans.records import GREEDY

BOX = (39_085_000, 39_130_000, -84_535_000, -84_490_000)
REGION = (39_081_000, 39_138_000, -84_539_000, -84_482_000)
W = f"WITH {SUPPLIERS}, {CUSTOMERS}"
DIST = METRES_SQL.format(a="a", b="b")
GRID = [(1.0, 20.0), (1.5, 20.0), (1.5, 40.0), (2.0, 40.0)]
IN = "lat BETWEEN {0} AND {1} AND lng BETWEEN {2} AND {3}"


def sup(s, d):
    return places(s, d, "supplier")


def cus(s, d):
    return places(s, d, "customer")


def pins(s, d):
    """Pins of maps of 750 each."""
    k = F.col("c_custkey")
    return read(s, d, "customer").select(F.floor(k / 750).alias("map"), k.alias("pin"), (k * 37 % 1000).cast("double").alias("x"), (k * 91 % 800).cast("double").alias("y"))


def controls(s, d):
    """Surveyed points of maps of 50 each, a bent plane."""
    k = F.col("s_suppkey")
    x, y = (k * 53 % 1000).cast("double"), (k * 29 % 800).cast("double")
    return read(s, d, "supplier").select(F.floor(k / 50).alias("map"), k.alias("c"), x.alias("cx"), y.alias("cy"), (2.0 * x + 0.5 * y + 0.001 * x * y).alias("u"), (1.5 * y - 0.25 * x + 0.0005 * x * x).alias("v"))


def residuals(s, d):
    """Residuals of the controls; two of three count for the factor."""
    return controls(s, d).select("map", "c", "cx", "cy", (F.col("c") * 7 % 40 + F.col("c") % 3 * 5).cast("double").alias("r"), (F.col("c") % 3 != 0).alias("counts"))


CONTROLS = "ct AS (SELECT CAST(floor(s_suppkey / 50) AS BIGINT) AS map, s_suppkey AS c, x AS cx, y AS cy, 2.0::DOUBLE * x + 0.5::DOUBLE * y + 0.001::DOUBLE * x * y AS u, 1.5::DOUBLE * y - 0.25::DOUBLE * x + 0.0005::DOUBLE * x * x AS v FROM (SELECT s_suppkey, CAST(s_suppkey * 53 % 1000 AS DOUBLE) AS x, CAST(s_suppkey * 29 % 800 AS DOUBLE) AS y FROM supplier))"
PINS = "pn AS (SELECT CAST(floor(c_custkey / 750) AS BIGINT) AS map, c_custkey AS pin, CAST(c_custkey * 37 % 1000 AS DOUBLE) AS x, CAST(c_custkey * 91 % 800 AS DOUBLE) AS y FROM customer)"
SUMS = "sum(w) AS s0, sum(w * dx) AS sx, sum(w * dy) AS sy, sum(w * dx * dx) AS sxx, sum(w * dx * dy) AS sxy, sum(w * dy * dy) AS syy, sum(w * u) AS su, sum(w * u * dx) AS sux, sum(w * u * dy) AS suy, sum(w * v) AS sv, sum(w * v * dx) AS svx, sum(w * v * dy) AS svy"
DET = "(s0 * (sxx * syy - sxy * sxy) - sx * (sx * syy - sxy * sy) + sy * (sx * sxy - sxx * sy))"
CRAMER = "(s{0} * (sxx * syy - sxy * sxy) - sx * (s{0}x * syy - sxy * s{0}y) + sy * (s{0}x * sxy - sxx * s{0}y)) / " + DET


def milli(c):
    return F.floor(F.col(c) * 100 + 0.5).cast("long").alias(f"{c}_centi")


def entries(s, d):
    p = read(s, d, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("title"), F.col("p_brand").alias("subline"), F.lower("p_type").alias("keywords"), F.col("p_partkey").alias("ord"), (NOW + (F.col("p_partkey") % 400 - 200) * 600).cast("long").alias("st"), (NOW + (F.col("p_partkey") % 400 - 194) * 600).cast("long").alias("en"))
    c = read(s, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"), F.lit("red supplier").alias("subline"), F.lit("").alias("keywords"), F.col("s_suppkey").alias("ord"), F.lit(None).cast("long").alias("st"), F.lit(None).cast("long").alias("en"))
    return [p, c, p, c.withColumn("kind", F.lit("draft"))]


def asked(s, d):
    k = F.col("n_nationkey")
    words = F.array(*map(F.lit, ["red", "ring promo", "Brand", "supplier#000000007", "small widget", "blue ring economy", "e, #", "ed"]))
    return read(s, d, "nation").select(k.alias("qid"), F.get(words, (k % 8).cast("int")).alias("query"))


def index(s, d):
    return search.build_search_index(entries(s, d), ["part", "supplier"])


def hits(s, d, limit=200):
    return search.rank_search(index(s, d), asked(s, d), ["supplier"], limit, NOW)


INDEX = f"ix AS (SELECT 'part' AS kind, p_partkey AS id, p_name || ' ' || p_type AS title, lower(p_name || ' ' || p_type) AS ft, lower(p_brand) AS fs, lower(p_type) AS fk, {NOW} + (p_partkey % 400 - 200) * 600 AS st, {NOW} + (p_partkey % 400 - 194) * 600 AS en FROM part UNION ALL SELECT 'supplier', s_suppkey, s_name, lower(s_name), 'red supplier', '', NULL, NULL FROM supplier)"
ASKED = "q AS (SELECT n_nationkey AS qid, lower(['red', 'ring promo', 'Brand', 'supplier#000000007', 'small widget', 'blue ring economy', 'e, #', 'ed'][n_nationkey % 8 + 1]) AS phrase FROM nation)"
HITS = f"""WITH {INDEX}, {ASKED}, t0 AS (SELECT qid, phrase, unnest(regexp_split_to_array(phrase, '[\\s,]+')) AS t0 FROM q), tm AS (SELECT qid, phrase, regexp_replace(t0, '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g') AS t FROM t0),
 sc AS (SELECT qid, phrase, kind, id, title, ft, st, en,
 CASE WHEN starts_with(ft, t) THEN 40 WHEN contains(' ' || regexp_replace(ft, '[^a-z0-9'']+', ' ', 'g'), ' ' || t) THEN 30 WHEN contains(ft, t) THEN 20 ELSE 0 END + CASE WHEN contains(fs, t) THEN 8 ELSE 0 END + CASE WHEN contains(fk, t) THEN 4 ELSE 0 END AS n FROM tm, ix WHERE t <> ''),
 tt AS (SELECT qid, kind, id, title, CAST(sum(n) AS INT) + max(CASE WHEN ft = phrase THEN 100 WHEN starts_with(ft, phrase) THEN 60 WHEN contains(ft, phrase) THEN 30 ELSE 0 END) + CASE WHEN kind = 'supplier' THEN 3 ELSE 0 END
 + max(CASE WHEN st <= {NOW} AND en > {NOW} THEN 25 WHEN st > {NOW} AND st - {NOW} < 10800 THEN 15 WHEN en < {NOW} THEN -5 ELSE 0 END) AS score, bool_or(ft = phrase) AS exact FROM sc GROUP BY qid, kind, id, title HAVING min(n) > 0 AND score >= 0),
 h AS (SELECT qid, kind, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, title, kind, id) AS rank, exact FROM tt)"""

def layers(s, d):
    """Six layers: venues with the days of their sessions, art and facilities with a program, stays, stops and food without either."""
    days = schedule.timed(sessions(s, d)).groupBy(F.col("venue").cast("long").alias("id")).agg(F.array_sort(F.collect_set(schedule.festival_day(F.col("s")))).alias("days"))
    k = F.col("p_partkey")
    spread = read(s, d, "part").select(k.alias("id"), (39_080_000 + k * 6151 % 60_000).alias("lat"), (-84_540_000 + k * 27_103 % 60_000).alias("lng"), F.when(k % 3 == 0, "view").when(k % 3 == 1, "click").alias("program"), (k % 4).alias("kind"))
    of = lambda n: spread.filter(F.col("kind") == n)
    return {"venues": sup(s, d).join(days, "id", "left"), "art": of(0), "facilities": of(1), "stays": cus(s, d), "transit": of(2).drop("program"), "food": of(3).drop("program")}


def calendar(s, d):
    days = schedule.timed(sessions(s, d)).groupBy("program").agg(F.min(schedule.festival_day(F.col("s"))).alias("first"))
    return days.withColumn("last", F.col("first") + F.length("program"))


LAYERS = f"""WITH {SESSIONS}, {SUPPLIERS}, {CUSTOMERS}, t AS (SELECT venue, program, CAST(floor((s - 18000) / 86400) AS BIGINT) AS day FROM x WHERE NOT cancelled AND NOT tu AND NOT ad AND NOT og),
 v AS (SELECT venue, array_to_string(list_sort(list(DISTINCT day)), ',') AS days FROM t GROUP BY venue), c AS (SELECT program, array_to_string(range(min(day), min(day) + length(program) + 1), ',') AS days FROM t GROUP BY program),
 p AS (SELECT p_partkey AS id, 39080000 + p_partkey * 6151 % 60000 AS lat, -84540000 + p_partkey * 27103 % 60000 AS lng, CASE p_partkey % 3 WHEN 0 THEN 'view' WHEN 1 THEN 'click' END AS program, p_partkey % 4 AS kind FROM part),
 l AS (SELECT 'venues' AS layer, id, lat, lng, days FROM sp LEFT JOIN v ON v.venue = sp.id UNION ALL SELECT 'stays', id, lat, lng, NULL FROM cu UNION ALL SELECT ['art', 'facilities', 'transit', 'food'][kind + 1], id, lat, lng, CASE WHEN kind < 2 THEN c.days END FROM p LEFT JOIN c ON c.program = p.program)
 SELECT layer, CAST(id AS VARCHAR) AS id, CAST(floor((lng - {BOX[2]}) * 1000 / {BOX[3] - BOX[2]}) AS BIGINT) AS px, CAST(floor(({BOX[1]} - lat) * 1000 / {BOX[3] - BOX[2]}) AS BIGINT) AS py, coalesce(days, '') AS days FROM l WHERE {IN.format(*BOX)}"""


def on_screen(s, d):
    """Customers of each hood in pixels; some stand in one place."""
    k = F.col("id")
    return cus(s, d).select(F.col("hood").alias("view"), "id", F.floor((F.col("lng") + 84_540_000) / 80).alias("x"), F.floor((F.col("lat") - 39_080_000 - F.when(k % 9 == 0, F.col("lat") % 4000).otherwise(0)) / 80).alias("y"), (k % 10).alias("importance"))


#: one point of each view a step; seeds are (x, y, order, id)
CLUSTERS = f"""WITH RECURSIVE {CUSTOMERS}, p AS (SELECT hood AS view, id, CAST(floor((lng + 84540000) / 80) AS BIGINT) AS x, CAST(floor((lat - 39080000 - CASE WHEN id % 9 = 0 THEN lat % 4000 ELSE 0 END) / 80) AS BIGINT) AS y, id % 10 AS importance FROM cu),
 o AS (SELECT *, row_number() OVER (PARTITION BY view ORDER BY importance DESC, id) AS i FROM p),
 g AS (SELECT view, 0::BIGINT AS i, []::STRUCT(x BIGINT, y BIGINT, i BIGINT, id BIGINT)[] AS seeds FROM o GROUP BY view
  UNION ALL SELECT o.view, o.i, CASE WHEN len(list_filter(seeds, lambda q: pow(q.x - o.x, 2) + pow(q.y - o.y, 2) < 44 * 44)) > 0 THEN seeds ELSE list_append(seeds, {{'x': o.x, 'y': o.y, 'i': o.i, 'id': o.id}}) END FROM g JOIN o ON o.view = g.view AND o.i = g.i + 1),
 z AS (SELECT view, unnest(arg_max(seeds, i)) AS q FROM g GROUP BY view),
 m AS (SELECT o.view, o.id, o.x, o.y, arg_min(q.id, (floor(q.x / 44) - floor(o.x / 44), pow(q.x - o.x, 2) + pow(q.y - o.y, 2), q.i)) AS seed FROM o LEFT JOIN z ON z.view = o.view AND q.i < o.i AND pow(q.x - o.x, 2) + pow(q.y - o.y, 2) < 44 * 44 GROUP BY o.view, o.id, o.x, o.y)
 SELECT view, coalesce(seed, id) AS seed, count(*) AS n, CAST(floor(avg(x) * 100 + 0.5) AS BIGINT) AS x, CAST(floor(avg(y) * 100 + 0.5) AS BIGINT) AS y FROM m GROUP BY 1, 2"""

PAIRED = f"WITH RECURSIVE {SUPPLIERS}, {CUSTOMERS}, r AS (SELECT a.id AS a, b.id AS b, {DIST} AS cost FROM sp a, cu b), c AS (SELECT *, row_number() OVER (ORDER BY cost, a, b) AS i FROM r WHERE cost <= 600){GREEDY} SELECT a, b, cost FROM c JOIN t USING (i)"

QUERIES = {
    "within_radius": (lambda s, d: op.within_radius(sup(s, d), cus(s, d), 400), W + f" SELECT * FROM (SELECT a.id AS a, b.id AS b, {DIST} AS metres FROM sp a, cu b) WHERE metres <= 400"),
    "knn_within": (lambda s, d: op.knn_within(sup(s, d), cus(s, d), 400, 3), W + f", p AS (SELECT a.id AS a, b.id AS b, {DIST} AS metres FROM sp a, cu b) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY metres, b) AS rank FROM p WHERE metres <= 400) WHERE rank <= 3"),
    "nearest_seed": (lambda s, d: op.nearest_seed(cus(s, d), sup(s, d), 250), W + f", p AS (SELECT a.id AS a, b.id AS b, {DIST} AS metres FROM cu a, sp b), n AS (SELECT a, arg_min(b, (metres, -b)) AS seed, min(metres) AS metres FROM p WHERE metres <= 250 GROUP BY a) SELECT cu.id, seed, metres FROM cu LEFT JOIN n ON cu.id = n.a"),
    "distance_matrix": (lambda s, d: op.distance_matrix(cus(s, d), sup(s, d).filter("id < 4"), walk_minutes), W + f" SELECT b.id, a.id AS hub, greatest(1, CAST(ceil({METRES_SQL.format(a='b', b='a')} * 1.3::DOUBLE / 80.0::DOUBLE) AS BIGINT)) AS minutes FROM sp a, cu b WHERE a.id < 4"),
    "map_layers": (lambda s, d: op.map_layers(layers(s, d), BOX, calendar(s, d)).withColumn("days", F.array_join("days", ",")), LAYERS),
    "off_map_split": (
        lambda s, d: op.off_map_split(cus(s, d).withColumn("lng", F.when(F.col("id") % 50 != 0, F.col("lng"))), BOX),
        W + f" SELECT CASE WHEN id % 50 = 0 THEN 'none' WHEN {IN.format(*BOX)} THEN 'on' ELSE 'outside' END AS side, count(*) AS n FROM cu GROUP BY 1",
    ),
    "region_check": (
        lambda s, d: op.region_check(cus(s, d).withColumn("lng", F.when(F.col("id") % 50 != 0, F.col("lng"))), REGION, BOX),
        W + f" SELECT id, CASE WHEN id % 50 = 0 THEN 'half' WHEN NOT ({IN.format(*REGION)}) THEN 'error' ELSE 'warning' END AS level FROM cu WHERE id % 50 = 0 OR NOT ({IN.format(*BOX)})",
    ),
    "cluster_points": (lambda s, d: op.cluster_points(on_screen(s, d), 44).withColumns({c: F.floor(F.col(c) * 100 + 0.5).cast("long") for c in ("x", "y")}), CLUSTERS),
    "extent_fit": (
        lambda s, d: op.extent_fit(sup(s, d).select("hood", *(F.floor(c).alias(n) for n, c in (("x", (F.col("lng") - BOX[2]) / 45), ("y", (BOX[1] - F.col("lat")) / 45)))), "hood", (1000, 1000)).select("hood", *(F.floor(F.col(c) * 10 + 0.5).cast("long").alias(c) for c in ("x0", "y0", "w", "h"))),
        W + f""", p AS (SELECT hood, CAST(floor((lng - {BOX[2]}) / 45) AS BIGINT) AS x, CAST(floor(({BOX[1]} - lat) / 45) AS BIGINT) AS y FROM sp), e AS (SELECT hood, (min(x) + max(x)) / 2 AS mx, (min(y) + max(y)) / 2 AS my, greatest(max(x) - min(x) + 80, 200)::DOUBLE AS w, greatest(max(y) - min(y) + 80, 150)::DOUBLE AS h FROM p WHERE x BETWEEN 0 AND 1000 AND y BETWEEN 0 AND 1000 GROUP BY hood),
 g AS (SELECT hood, mx, my, least(CASE WHEN w / h > 4 / 3 THEN w ELSE h * 4 / 3 END, 1000) AS w, least(CASE WHEN w / h > 4 / 3 THEN w * 3 / 4 ELSE h END, 1000) AS h FROM e)
 SELECT hood, CAST(floor(least(greatest(0, mx - w / 2), 1000 - w) * 10 + 0.5) AS BIGINT) AS x0, CAST(floor(least(greatest(0, my - h / 2), 1000 - h) * 10 + 0.5) AS BIGINT) AS y0, CAST(floor(w * 10 + 0.5) AS BIGINT) AS w, CAST(floor(h * 10 + 0.5) AS BIGINT) AS h FROM g""",
    ),
    "georeference_pins": (
        lambda s, d: op.georeference_pins(pins(s, d), controls(s, d)).select("map", "pin", milli("u"), milli("v")),
        f"WITH {CONTROLS}, {PINS}, m AS (SELECT map, pin, 1.0::DOUBLE / pow((cx - x) * (cx - x) + (cy - y) * (cy - y) + 400, 1.5) AS w, cx - x AS dx, cy - y AS dy, u, v FROM pn JOIN ct USING (map)), s AS (SELECT map, pin, {SUMS} FROM m GROUP BY map, pin) SELECT map, pin, CAST(floor({CRAMER.format('u')} * 100 + 0.5) AS BIGINT) AS u_centi, CAST(floor({CRAMER.format('v')} * 100 + 0.5) AS BIGINT) AS v_centi FROM s",
    ),
    "georef_cv": (
        lambda s, d: op.georef_cv(controls(s, d), GRID),
        f"WITH {CONTROLS}, g AS (SELECT * FROM (VALUES {', '.join(f'({a}::DOUBLE, {s}::DOUBLE)' for a, s in GRID)}) t(alpha, s)), m AS (SELECT l.map, alpha, s, l.c AS pin, l.u AS tu, l.v AS tv, 1.0::DOUBLE / pow((k.cx - l.cx) * (k.cx - l.cx) + (k.cy - l.cy) * (k.cy - l.cy) + s * s, alpha) AS w, k.cx - l.cx AS dx, k.cy - l.cy AS dy, k.u, k.v FROM ct l JOIN ct k ON l.c <> k.c AND l.map = k.map, g), q AS (SELECT map, alpha, s, pin, tu, tv, {SUMS} FROM m GROUP BY ALL), r AS (SELECT map, alpha, s, sqrt(pow({CRAMER.format('u')} - tu, 2) + pow({CRAMER.format('v')} - tv, 2)) AS r FROM q) SELECT map, alpha, s, CAST(floor(avg(r) * 1000 + 0.5) AS BIGINT) AS mean_milli, CAST(floor(quantile_cont(r, 0.9) * 1000 + 0.5) AS BIGINT) AS p90_milli FROM r GROUP BY map, alpha, s",
    ),
    "position_uncertainty": (
        lambda s, d: op.position_uncertainty(pins(s, d), residuals(s, d)),
        f"""WITH {CONTROLS}, {PINS}, r AS (SELECT map, c, cx, cy, CAST(c * 7 % 40 + c % 3 * 5 AS DOUBLE) AS r, c % 3 <> 0 AS counts FROM ct),
 k0 AS (SELECT a.map, a.c, a.r, sqrt(sum(b.r * b.r / pow((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) + 1600, 2)) / sum(1 / pow((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) + 1600, 2))) AS local
  FROM r a JOIN r b ON a.map = b.map AND NOT (abs(a.cx - b.cx) < 0.01 AND abs(a.cy - b.cy) < 0.01) WHERE a.counts GROUP BY a.map, a.c, a.r),
 k AS (SELECT map, quantile_cont(r / greatest(local, 1), 0.9) AS factor FROM k0 GROUP BY map),
 l AS (SELECT pn.map, pin, sqrt(sum(r * r / pow((x - cx) * (x - cx) + (y - cy) * (y - cy) + 1600, 2)) / sum(1 / pow((x - cx) * (x - cx) + (y - cy) * (y - cy) + 1600, 2))) AS local FROM pn JOIN r ON pn.map = r.map GROUP BY pn.map, pin)
 SELECT l.map, pin, CAST(ceil(greatest(15, local * coalesce(factor, 2)) / 5 - 1e-9) * 5 AS BIGINT) AS approx_m FROM l LEFT JOIN k ON l.map = k.map""",
    ),
    "hood_assignment": (
        lambda s, d: op.hood_assignment(cus(s, d), cus(s, d).filter("id % 10 = 0").select("name", F.lit("T").alias("table_hood")), sup(s, d), 250, REGION),
        W + f", p AS (SELECT a.id AS a, b.id AS b, b.hood AS h, {DIST} AS metres FROM cu a, sp b), n AS (SELECT a, arg_min(h, (metres, -b)) AS h FROM p WHERE metres <= 250 GROUP BY a) SELECT cu.id, CASE WHEN {IN.format(*REGION)} THEN CASE WHEN cu.id % 10 = 0 THEN 'T' ELSE h END END AS hood FROM cu LEFT JOIN n ON cu.id = n.a",
    ),
    "geofence_override": (
        lambda s, d: op.geofence_override(cus(s, d), "7", (39_110_000, -84_510_000), 1500, "GREEN"),
        W + f", b AS (SELECT *, contains(name, '7') AND {METRES_SQL.format(a='cu', b='o')} <= 1500 AS moved FROM cu, (SELECT 39110000 AS lat, -84510000 AS lng) o) SELECT id, CASE WHEN moved THEN 'GREEN' ELSE hood END AS hood, moved FROM b",
    ),
    "geocode_gate": (
        lambda s, d: op.geocode_gate(cus(s, d).withColumn("place_rank", 20 + F.col("id") % 12), REGION).groupBy("reason").agg(F.count("*").alias("n")),
        W + f" SELECT CASE WHEN 20 + id % 12 < 28 THEN 'coarse' WHEN NOT ({IN.format(*REGION)}) THEN 'outside' ELSE 'ok' END AS reason, count(*) AS n FROM cu GROUP BY 1",
    ),
    "reach_limit": (
        lambda s, d: op.reach_limit(cus(s, d), (39_110_000, -84_510_000), F.col("id") % 400 == 7, 300, 200),
        W + f", b AS (SELECT id, {METRES_SQL.format(a='cu', b='o')} AS metres FROM cu, (SELECT 39110000 AS lat, -84510000 AS lng) o), r AS (SELECT greatest(max(metres), 300) + 200 AS reach FROM b WHERE id % 400 = 7) SELECT id, metres, reach FROM b, r WHERE metres <= reach",
    ),
    "pair_by_proximity": (lambda s, d: op.paired(sup(s, d), cus(s, d), 600), PAIRED),
    "build_search_index": (lambda s, d: index(s, d).select("kind", "id", "ft", "fs"), f"WITH {INDEX} SELECT kind, id, ft, fs FROM ix"),
    "rank_search": (hits, HITS + " SELECT * FROM h WHERE rank <= 200"),
    "match_spans": (
        lambda s, d: search.marked_hits(hits(s, d, 40), index(s, d), asked(s, d)).select("qid", "kind", "id", F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["start"], x["end"])), ",").alias("spans")),
        HITS + f""", m AS (SELECT qid, kind, id, lower(title) AS ft FROM h JOIN (SELECT kind, id, title FROM ix) USING (kind, id) WHERE rank <= 40), u AS (SELECT DISTINCT qid, t FROM tm WHERE length(t) > 1),
 i AS (SELECT m.qid, kind, id, ft, t, unnest(range(0, length(ft) - length(t) + 1)) AS i FROM m JOIN u USING (qid) WHERE length(ft) >= length(t)), o AS (SELECT qid, kind, id, i AS a, i + length(t) AS b FROM i WHERE substr(ft, i + 1, length(t)) = t),
 g AS (SELECT *, CASE WHEN a < max(b) OVER (PARTITION BY qid, kind, id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM o), n AS (SELECT *, sum(fresh) OVER (PARTITION BY qid, kind, id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS nth FROM g),
 s AS (SELECT qid, kind, id, nth, min(a) AS a, max(b) AS b FROM n GROUP BY qid, kind, id, nth) SELECT m.qid, m.kind, m.id, coalesce(string_agg(a || '-' || b, ',' ORDER BY a), '') AS spans FROM m LEFT JOIN s ON s.qid = m.qid AND s.kind = m.kind AND s.id = m.id GROUP BY m.qid, m.kind, m.id""",
    ),
    "group_search": (
        lambda s, d: search.group_search(hits(s, d), ["part", "supplier"]),
        HITS + ", g AS (SELECT qid, kind, count(*) AS n, bool_or(rank = 1 AND exact) AS leads FROM h WHERE rank <= 200 GROUP BY qid, kind) SELECT qid, kind, n, row_number() OVER (PARTITION BY qid ORDER BY leads DESC, kind) AS place FROM g",
    ),
}
