"""Schedule queries over the lenses, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.geo import METRES_SQL
from tessera.operators import schedule as op
from tessera.plans.lenses import NOW, SERIES, SESSIONS, SUPPLIERS, places, series, sessions

D0, D1 = 10227, 10590  # window of days for listings, in 1998
LANES = ("view", "click", "purchase")
WEEK = (10300, 10312)
W = f"WITH {SESSIONS}, t AS (SELECT *, CAST(floor((s - 18000) / 86400) AS BIGINT) AS day FROM x WHERE NOT cancelled AND NOT tu AND NOT ad AND NOT og)"
I = f"""WITH {SERIES}, z AS (SELECT *, unnest(range(d, d + n)) AS day FROM r), i AS (SELECT id, program, venue, day, n,
 CAST(day * 86400 + coalesce(sm * 60, 0) AS BIGINT) AS s,
 CAST(CASE WHEN sm IS NULL THEN (day + 1) * 86400 WHEN em IS NULL THEN day * 86400 + sm * 60 + 3600 WHEN em < sm THEN (day + 1) * 86400 + em * 60 ELSE day * 86400 + em * 60 END AS BIGINT) AS e,
 sm IS NOT NULL AND em IS NULL AS eu, sm IS NULL AS ad, n > 1 OR sm IS NULL AS og FROM z WHERE day BETWEEN {D0} AND {D1})"""
STATUS = f"CASE WHEN tu THEN NULL WHEN s - {NOW} > 1800 THEN 'upcoming' WHEN s > {NOW} THEN 'soon' WHEN e <= {NOW} THEN 'past' WHEN eu THEN 'started' ELSE 'live' END"
TODAY = (NOW - 18000) // 86400
PAIRS = W + """, p AS (SELECT a.user_id, a.id AS a, b.id AS b, CASE WHEN NOT a.eu AND NOT b.eu THEN CASE WHEN least(a.e, b.e) - b.s > 0 THEN 'overlap' END
 WHEN a.s = b.s THEN 'same' WHEN NOT a.eu AND b.s < a.e THEN 'during' WHEN a.eu AND b.s - a.s < 3600 THEN 'maybe' END AS kind, least(a.e, b.e) - b.s AS shared
 FROM t a JOIN t b ON a.user_id = b.user_id AND a.id <> b.id AND (a.s, a.e, a.id) < (b.s, b.e, b.id) AND b.s < greatest(a.e, a.s + 3600))"""


WEEKLY = I + ", k AS (SELECT id % 40 AS lane, day FROM i WHERE day BETWEEN 10300 - id % 40 % 7 AND 10306 + id % 40 % 13), p AS (SELECT 'L' || lane AS program, min(day) AS a, max(day) AS b FROM k GROUP BY lane)"


def weekly(spark, sf_dir):
    """Instances of forty lanes of different lengths around the week."""
    lane = F.col("id") % 40
    rows = instances(spark, sf_dir).filter(F.col("day").between(10300 - lane % 7, 10306 + lane % 13))
    return rows.withColumn("program", F.concat(F.lit("L"), lane.cast("string")))


def titled(spark, sf_dir):
    s = sessions(spark, sf_dir)
    return op.timed(s).withColumn("day", op.festival_day(s["s"]))


def plan(spark, sf_dir):
    return sessions(spark, sf_dir).filter("user_id < 200")


def filtered(spark, sf_dir):
    """Every predicate but day and venue at once."""
    rows = sessions(spark, sf_dir).withColumns({"hood": F.concat(F.lit("H"), (F.col("venue") % 7).cast("string")), "free": F.col("id") % 3 != 0})
    state = {"programs": ["view", "click"], "kinds": ["K1", "K2", "K4", "ongoing"], "times": ["evening", "late", "allday"], "hoods": ["H1", "H2", "H3", "H4"], "free": True, "text": "t 1", "when": "tonight", "star": True}
    return op.filter_schedule(rows, plan(spark, sf_dir), NOW, **state)


def instances(spark, sf_dir):
    return op.expand_instances(series(spark, sf_dir), D0, D1)


QUERIES = {
    "expand_instances": (lambda s, d: instances(s, d), I + " SELECT id, program, venue, day, s, e, eu, ad, og FROM i"),
    "sessions_per_festival_day": (lambda s, d: op.sessions_per_festival_day(sessions(s, d)), W + " SELECT day, count(*) AS n_sessions, count(*) FILTER (WHERE s % 86400 < 18000) AS n_late, count(DISTINCT title) AS n_titles FROM t GROUP BY day"),
    "time_of_day_counts": (
        lambda s, d: op.time_of_day_counts(sessions(s, d)),
        W + " SELECT CASE WHEN ad OR tu THEN 'allday' WHEN s % 86400 < 18000 THEN 'late' WHEN s % 86400 < 43200 THEN 'morning' WHEN s % 86400 < 61200 THEN 'afternoon' WHEN s % 86400 < 75600 THEN 'evening' ELSE 'late' END AS bucket, count(*) AS n FROM x WHERE NOT cancelled AND NOT og GROUP BY 1",
    ),
    "status_board": (
        lambda s, d: op.status_board(sessions(s, d), NOW),
        W + f", b AS (SELECT *, {STATUS} AS st FROM x WHERE NOT cancelled AND NOT og) SELECT program, " + ", ".join(f"count(*) FILTER (WHERE st = '{k}') AS {k}" for k in ("upcoming", "soon", "live", "started", "past"))
        + f", CAST(coalesce(sum(floor(({NOW} - s) / 60)) FILTER (WHERE st = 'live'), 0) AS BIGINT) AS elapsed_min, CAST(coalesce(sum(floor((e - s) / 60)) FILTER (WHERE st = 'live'), 0) AS BIGINT) AS total_min FROM b WHERE st IS NOT NULL GROUP BY program",
    ),
    "next_instance": (lambda s, d: op.next_instance(instances(s, d), 10300 * 86400), I + f" SELECT id, (coalesce(min((s, e)) FILTER (WHERE e > {10300 * 86400}), max((s, e))))[1] AS s, (coalesce(min((s, e)) FILTER (WHERE e > {10300 * 86400}), max((s, e))))[2] AS e FROM i GROUP BY id"),
    "next_up": (lambda s, d: op.next_up(sessions(s, d), NOW), W + f" SELECT user_id, id, s FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s, id) AS rn FROM x WHERE NOT cancelled AND e > {NOW}) WHERE rn = 1"),
    "live_count": (lambda s, d: op.live_count(sessions(s, d), NOW), W + f" SELECT count(DISTINCT id) AS n_live FROM x WHERE s <= {NOW} AND e > {NOW} AND NOT (cancelled OR eu OR tu OR ad)"),
    "when_preset": (
        lambda s, d: op.when_preset(sessions(s, d), NOW),
        W + f", b AS (SELECT id, s <= {NOW} AND e > {NOW} AND NOT eu AS on_now, s >= {NOW} AND s < {NOW + 7200} AS next, (s % 86400 >= 61200 OR s % 86400 < 18000) AND e > {NOW} AND CAST(floor((s - 18000) / 86400) AS BIGINT) = {TODAY} AS tonight FROM x WHERE NOT cancelled AND NOT tu AND NOT ad) SELECT * FROM b WHERE on_now OR next OR tonight",
    ),
    "at_this_hour": (
        lambda s, d: op.at_this_hour(sessions(s, d), NOW, LANES),
        W + f""", b AS (SELECT id, s, og, eu, CASE WHEN eu THEN s + 3600 ELSE e END AS e, CASE WHEN featured THEN 0 ELSE 10 END + coalesce(list_position({list(LANES)}, program) - 1, 9) AS ord,
  NOT tu AND NOT ad AS hours, CAST(floor((s - 18000) / 86400) AS BIGINT) = {TODAY} AS today FROM x WHERE NOT cancelled),
 o AS (SELECT *, hours AND s <= {NOW} AND e > {NOW} AS running, hours AND s > {NOW} AS later FROM b),
 soon AS (SELECT count(*) AS n FROM o WHERE later AND s < {NOW + 10800}), pool AS (SELECT min(s) FILTER (WHERE NOT og) AS plain, min(s) AS any_s FROM o WHERE later),
 nx AS (SELECT o.* FROM o, soon, pool WHERE later AND CASE WHEN soon.n > 0 THEN s < {NOW + 10800} WHEN plain IS NOT NULL THEN s = plain AND NOT og ELSE s = any_s END ORDER BY ord, s, id LIMIT 3),
 nw AS (SELECT * FROM o WHERE running AND NOT og ORDER BY ord, s, id LIMIT 4), op AS (SELECT * FROM o WHERE running AND og AND NOT eu ORDER BY ord, s, id LIMIT 2),
 ta AS (SELECT * FROM o WHERE later AND today AND (s % 86400 >= 61200 OR s % 86400 < 18000) AND id NOT IN (SELECT id FROM nx) AND id NOT IN (SELECT id FROM nw)), tn AS (SELECT * FROM ta ORDER BY ord, s, id LIMIT 6)
 SELECT 'now' AS section, row_number() OVER (ORDER BY ord, s, id) AS rank, id, greatest((SELECT count(*) FROM o WHERE running AND NOT og) - 4, 0) AS n_more FROM nw
 UNION ALL SELECT 'open', row_number() OVER (ORDER BY ord, s, id), id, greatest((SELECT count(*) FROM o WHERE running AND og AND NOT eu) - 2, 0) FROM op
 UNION ALL SELECT 'next', row_number() OVER (ORDER BY s, ord, id), id, 0 FROM nx
 UNION ALL SELECT 'tonight', row_number() OVER (ORDER BY s, ord, id), id, greatest((SELECT count(*) FROM ta) - 6, 0) FROM tn
 UNION ALL SELECT 'on_view', 1, NULL, (SELECT count(*) FROM o WHERE today AND og AND NOT hours)""",
    ),
    "first_up": (
        lambda s, d: op.first_up(sessions(s, d), NOW, LANES, "signup"),
        W + f""", u AS (SELECT *, CAST(floor((s - 18000) / 86400) AS BIGINT) AS day, CASE WHEN featured THEN 0 ELSE 10 END + coalesce(nullif(coalesce(list_position(['view', 'click', 'purchase'], program), 0), 0) - 1, 9) AS rank
 FROM x WHERE NOT (cancelled OR tu OR ad) AND CASE WHEN eu THEN s + 3600 ELSE e END > {NOW} AND program <> 'signup'), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY day, rank, s, title) AS rn FROM u) WHERE rn = 1 ORDER BY day, rank, s, id LIMIT 4)
 SELECT CAST(row_number() OVER (ORDER BY s, rank, id) AS INT) AS place, id, title, day, s FROM f""",
    ),
    "ongoing_band": (lambda s, d: op.ongoing_band(instances(s, d)), I + " SELECT id, program, min(day) AS first_day, max(day) AS last_day FROM i GROUP BY id, program HAVING bool_and(og)"),
    "time_slots": (lambda s, d: op.time_slots(sessions(s, d)), W + " SELECT day, s, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM t GROUP BY day, s"),
    "fold_ended": (
        lambda s, d: op.fold_ended(sessions(s, d), NOW),
        W + f", b AS (SELECT *, {STATUS} AS st FROM t), c AS (SELECT day, s, CASE WHEN bool_or(st IN ('live', 'started')) THEN 'live' WHEN bool_and(st = 'past') THEN 'past' WHEN bool_or(st = 'soon') THEN 'soon' ELSE 'upcoming' END AS slot_status, max(e) AS ends, count(*) AS n FROM b GROUP BY day, s) SELECT *, slot_status = 'past' AS earlier FROM c",
    ),
    "day_tabs": (
        lambda s, d: op.day_tabs(sessions(s, d), TODAY - 16, TODAY + 20),
        W + f" SELECT g.day, coalesce(n, 0) AS n, coalesce(n_programs, 0) AS n_programs, g.day = {TODAY - 16} AS first_day, g.day = {TODAY + 20} AS last_day FROM (SELECT unnest(range({TODAY - 16}, {TODAY + 21})) AS day) g LEFT JOIN (SELECT day, count(*) AS n, count(DISTINCT program) AS n_programs FROM t GROUP BY day) c ON g.day = c.day",
    ),
    "full_spans": (lambda s, d: op.full_spans(instances(s, d)), I + " SELECT id, min(day) AS first_day, max(day) AS last_day, count(*) AS n FROM i GROUP BY id HAVING count(*) >= 2"),
    "program_calendar": (
        lambda s, d: op.program_calendar(op.lanes_of(weekly(s, d)), (WEEK[0] + 3) * 86400, *WEEK),
        WEEKLY + f", q AS (SELECT *, unnest(range({WEEK[0]}, {WEEK[1] + 1})) AS day FROM p) SELECT program, day, CASE WHEN day < a OR day > b THEN NULL WHEN a < {WEEK[0]} AND b > {WEEK[1]} THEN 'thru' WHEN a = b THEN 'only' WHEN day = a THEN 'start' WHEN day = b THEN 'end' ELSE 'mid' END AS cell,"
        + f" CASE WHEN day BETWEEN a AND b THEN day - a + 1 END AS nth, b - a + 1 AS of, CASE WHEN a > {WEEK[0] + 3} THEN 'before' WHEN b < {WEEK[0] + 3} THEN 'over' ELSE 'running' END AS phase, greatest(a - {WEEK[0] + 3}, 0) AS days_until FROM q",
    ),
    "interchange_days": (
        lambda s, d: op.interchange_days(op.lanes_of(weekly(s, d)).filter("b > 10306 and a < 10308"), 10300, 10312),
        WEEKLY + ", u AS (SELECT * FROM p WHERE b > 10306 AND a < 10308 AND NOT (a < 10300 AND b > 10312)), g AS (SELECT unnest(range(10300, 10313)) AS day) SELECT day, (SELECT count(*) FROM u) AS n FROM g WHERE (SELECT count(*) FROM u) >= 2 AND NOT EXISTS (SELECT 1 FROM u WHERE day < a OR day > b)",
    ),
    "nightly_flag": (lambda s, d: op.nightly_flag(series(s, d)), f"WITH {SERIES} SELECT program, bool_or(n > 1 AND coalesce(sm, 0) >= 1020) AS nightly FROM r GROUP BY program"),
    "occurrence_rules": (
        lambda s, d: op.occurrence_rules(series(s, d)),
        f"WITH {SERIES}, z AS (SELECT *, unnest(range(d, d + n)) AS day FROM r WHERE sm IS NOT NULL) SELECT id, day, sm, CASE WHEN (day + 4) % 7 = 0 AND em > 1020 THEN 1020 ELSE em END AS em FROM z WHERE (day + 4) % 7 <> 1",
    ),
    "collapse_runs": (lambda s, d: op.collapse_runs(titled(s, d)), W + " SELECT title, venue, min(day) AS first_day, max(day) AS last_day, count(*) AS n, count(DISTINCT (s % 86400) || '-' || (e - s)) AS n_hours FROM t GROUP BY title, venue"),
    "gaps_to_occurrences": (
        lambda s, d: op.gaps_to_occurrences(titled(s, d)),
        W + ", g AS (SELECT DISTINCT title, day FROM t), h AS (SELECT *, day - row_number() OVER (PARTITION BY title ORDER BY day) AS island FROM g) SELECT title, min(day) AS first_day, max(day) AS last_day, count(*) AS n FROM h GROUP BY title, island",
    ),
    "dedupe_slot": (
        lambda s, d: op.dedupe_slot(sessions(s, d)).select("id", "program", "title", "s"),
        W + " SELECT id, program, title, s FROM (SELECT *, row_number() OVER (PARTITION BY program, lower(title), s ORDER BY id) AS rn FROM x WHERE NOT tu) WHERE rn = 1 UNION ALL SELECT id, program, title, s FROM x WHERE tu",
    ),
    "filter_schedule": (
        lambda s, d: filtered(s, d).select("id", "program", "kind", "title"),
        W + f""", h AS (SELECT x.*, 'H' || (venue % 7) AS hood, id % 3 <> 0 AS free FROM x) SELECT id, program, kind, title FROM h WHERE NOT cancelled AND program IN ('view', 'click') AND (kind IN ('K1', 'K2', 'K4') OR og)
 AND contains(lower(title), 't') AND contains(lower(title), '1') AND id IN (SELECT id FROM x WHERE user_id < 200) AND hood IN ('H1', 'H2', 'H3', 'H4') AND free AND (CASE WHEN ad OR tu THEN 'allday' WHEN s % 86400 < 18000 THEN 'late' WHEN s % 86400 < 43200 THEN 'morning' WHEN s % 86400 < 61200 THEN 'afternoon' WHEN s % 86400 < 75600 THEN 'evening' ELSE 'late' END IN ('evening', 'late', 'allday') OR og)
 AND NOT tu AND NOT ad AND (s % 86400 >= 61200 OR s % 86400 < 18000) AND e > {NOW} AND CAST(floor((s - 18000) / 86400) AS BIGINT) = {TODAY}""",
    ),
    "window_clip": (lambda s, d: op.window_clip(series(s, d), 10300, 10330).select("id", "d", "n"), f"WITH {SERIES} SELECT id, d, n FROM r WHERE d <= 10330 AND d + n - 1 >= 10300"),
    "interval_overlap": (
        lambda s, d: op.interval_overlap(sessions(s, d)),
        PAIRS + ", m AS (SELECT *, CAST(CASE WHEN kind = 'overlap' THEN floor(shared / 60) END AS BIGINT) AS minutes FROM p WHERE kind IS NOT NULL) SELECT user_id, a AS id, b AS other, kind, minutes FROM m UNION ALL SELECT user_id, b, a, kind, minutes FROM m",
    ),
    "walk_gaps": (
        lambda s, d: op.walk_gaps(sessions(s, d), places(s, d, "supplier").filter("id % 5 <> 0")),
        W + f", {SUPPLIERS}, j AS (SELECT t.*, lat, lng FROM t LEFT JOIN sp ON t.venue = sp.id AND sp.id % 5 <> 0), k AS (SELECT *, lag(id) OVER o AS fi, lag(venue) OVER o AS fv, lag(e) OVER o AS le, lag(eu) OVER o AS oe, lag(lat) OVER o AS la, lag(lng) OVER o AS ln FROM j WINDOW o AS (PARTITION BY user_id, day ORDER BY s, e, id)),"
        + " m AS (SELECT *, coalesce(venue = fv, false) AS same, " + METRES_SQL.replace("{a}.lat", "la").replace("{a}.lng", "ln").replace("{b}.", "") + " AS dist FROM k WHERE fi IS NOT NULL), n AS (SELECT *, CASE WHEN same THEN 0 WHEN dist IS NOT NULL THEN greatest(1, CAST(ceil(dist * 1.3::DOUBLE / 80.0::DOUBLE) AS BIGINT)) END AS mins FROM m)"
        + " SELECT user_id, day, id, CASE WHEN same THEN 'same' WHEN dist IS NULL THEN 'unknown' ELSE 'walk' END AS kind, CASE WHEN same THEN 0 ELSE dist END AS metres, mins AS minutes, mins > 25 AS long_way, CASE WHEN NOT oe THEN CAST(floor((s - le) / 60 + 0.5) AS BIGINT) END AS free_min FROM n",
    ),
    "top_conflicts": (
        lambda s, d: top_conflicts(s, d),
        PAIRS + " SELECT user_id, count(*) AS n_conflicts, CAST(coalesce(sum(floor(shared / 60)) FILTER (WHERE kind = 'overlap'), 0) AS BIGINT) AS overlap_min FROM p WHERE kind IS NOT NULL GROUP BY user_id ORDER BY n_conflicts DESC, overlap_min DESC, user_id LIMIT 20",
    ),
}


def top_conflicts(spark, sf_dir):
    """The users whose plans conflict most."""
    pairs = op.conflict_pairs(sessions(spark, sf_dir))
    per = pairs.groupBy("user_id").agg(F.count("*").alias("n_conflicts"), F.coalesce(F.sum("minutes"), F.lit(0)).cast("long").alias("overlap_min"))
    return per.orderBy(F.col("n_conflicts").desc(), F.col("overlap_min").desc(), "user_id").limit(20)
