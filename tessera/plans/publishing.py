"""Source, sink and streaming queries over the lenses, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import quality, schedule
from tessera.plans import audits
from tessera.plans.lenses import SESSIONS, read, sessions
from tessera.plans.schedule import I, W, instances
from tessera.sources import entities as io
from tessera.sources.shared import scratch
from tessera.streaming import jobs

ENTITY = T.StructType([T.StructField("id", T.LongType()), T.StructField("kind", T.StringType())])
CUSTOMER = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("segment", T.StringType())])
SUPPLIER = T.StructType([T.StructField("id", T.LongType()), T.StructField("balance", T.DoubleType())])
#: How many records a slice has: files stay small however large the tables are.
SLICE = 50


def load_entities(s, d):
    """Four kinds as lines: events, every fiftieth broken and some twice; customers; one without a line, one without a file. What
    each holds by message."""
    i, root = F.col("event_id"), scratch(s, "entities")
    line = F.when(i % 50 == 0, F.concat(F.lit('{"id": '), i.cast("string"), F.lit(', "kind"'))).otherwise(F.to_json(F.struct((i - F.when(i % 77 == 1, 1).otherwise(0)).alias("id"), F.col("event_type").alias("kind"))))
    read(s, d, "events").select(line.alias("value")).write.text(f"{root}/events")
    read(s, d, "customer").select(F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("kind"))).alias("value")).write.text(f"{root}/people")
    read(s, d, "region").filter("r_regionkey < 0").select(F.col("r_name").alias("value")).write.text(f"{root}/works")
    tables, problems = io.load_entities(s, root, dict.fromkeys(("events", "people", "works", "venues", "notes"), ENTITY), ("events", "works", "venues"))
    out = problems.groupBy(F.col("kind").alias("tbl"), "message").agg(F.count("*").alias("n"))
    for name, rows in tables.items():
        out = out.unionByName(rows.groupBy(F.lit(name).alias("tbl"), F.col("kind").alias("message")).agg(F.count("*").alias("n")))
    return out


ENTITIES = """WITH e AS (SELECT event_id, event_id - CASE WHEN event_id % 77 = 1 THEN 1 ELSE 0 END AS id, event_type AS kind FROM events WHERE event_id % 50 <> 0)
 SELECT 'events' AS tbl, 'is no such object' AS message, count(*) AS n FROM events WHERE event_id % 50 = 0 UNION ALL SELECT 'events', 'key twice', count(*) FROM (SELECT id FROM e GROUP BY id HAVING count(*) > 1) UNION ALL SELECT 'events', kind, count(*) FROM e GROUP BY kind
 UNION ALL SELECT 'people', c_mktsegment, count(*) FROM customer GROUP BY 2 UNION ALL SELECT 'works', 'is empty', 1 UNION ALL SELECT 'venues', 'is missing', 1"""


def sliced(s, d):
    """Two kinds of records as whole JSON arrays, a file for each slice of fifty ids: every seventh slice is empty, every eleventh
    broken, every thirteenth no array, every fifth missing; some records are no objects or hold a wrong type."""
    root = scratch(s, "sliced")
    for name, key, record in (("customer", "c_custkey", ("c_name", "c_mktsegment")), ("supplier", "s_suppkey", ("s_acctbal",))):
        k = F.col(key)
        fields = [k.alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")] if name == "customer" else [k.alias("id"), F.col("s_acctbal").cast("double").alias("balance")]
        text = F.when(k % 41 == 0, F.concat(F.lit('"'), k, F.lit('"'))).when(k % 37 == 0, F.concat(F.lit('{"id": "x'), k, F.lit('"}'))).otherwise(F.to_json(F.struct(*fields)))
        rows = read(s, d, name).select(F.floor(k / SLICE).cast("int").alias("slice"), F.struct(k.alias("k"), text.alias("text")).alias("x")).filter("slice % 5 <> 4")
        whole = rows.groupBy("slice").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["text"]), ",\n").alias("all"))
        at = F.col("slice")
        file = F.when(at % 7 == 3, "[]").when(at % 11 == 2, F.concat(F.lit("["), "all")).when(at % 13 == 1, '{"id": 1}').otherwise(F.concat(F.lit("[\n"), "all", F.lit("\n]\n")))
        whole.select("slice", file.alias("value")).write.partitionBy("slice").text(f"{root}/{name}")
    kinds = [io.Kind("customer", CUSTOMER, "customer/slice=*/*.txt", r"slice=([0-9]+)", True), io.Kind("supplier", SUPPLIER, "supplier/slice=*/*.txt", r"slice=([0-9]+)"), io.Kind("venue", SUPPLIER, "venue/slice=*/*.txt", r"slice=([0-9]+)")]
    expected = read(s, d, "customer").select(F.floor(F.col("c_custkey") / SLICE).cast("int").alias("slice")).distinct()
    return io.load_slices(s, root, kinds, expected)


def load_slices(s, d):
    """What came of each file: records, and problems by message."""
    found, problems = sliced(s, d)
    out = problems.groupBy("kind", "slice", "level", "message").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))
    for name, rows in found.items():
        out = out.unionByName(rows.groupBy(F.lit(name).alias("kind"), "slice").agg(F.lit("info").alias("level"), F.lit("records").alias("message"), F.count("*").alias("n"), F.min("pos").alias("first_pos")))
    return out


SLICES = f"""WITH r AS (SELECT 'customer' AS kind, c_custkey AS k, c_custkey // {SLICE} AS slice FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_suppkey // {SLICE} FROM supplier),
 f AS (SELECT *, row_number() OVER (PARTITION BY kind, slice ORDER BY k) - 1 AS pos, CASE WHEN slice % 7 = 3 THEN 'is empty' WHEN slice % 11 = 2 THEN 'invalid JSON' WHEN slice % 13 = 1 THEN 'must be an array' END AS wrong FROM r WHERE slice % 5 <> 4),
 e AS (SELECT DISTINCT c_custkey // {SLICE} AS slice FROM customer), k AS (SELECT unnest(['customer', 'supplier', 'venue']) AS kind),
 o AS (SELECT kind, slice, CASE WHEN wrong = 'is empty' AND kind <> 'customer' THEN 'warning' ELSE 'error' END AS level, wrong AS message, 1 AS n, NULL AS first_pos FROM f WHERE wrong IS NOT NULL GROUP BY kind, slice, wrong
  UNION ALL SELECT kind, slice, 'error', CASE WHEN k % 41 = 0 THEN 'must be an object' ELSE 'holds a value of the wrong type' END AS m, count(*), min(pos) FROM f WHERE wrong IS NULL AND (k % 41 = 0 OR k % 37 = 0) GROUP BY kind, slice, m
  UNION ALL SELECT kind, slice, CASE WHEN kind = 'customer' THEN 'error' ELSE 'warning' END, 'is missing', 1, NULL FROM e, k WHERE (kind, slice) NOT IN (SELECT (kind, slice) FROM f)
  UNION ALL SELECT kind, slice, 'info', 'records', count(*), min(pos) FROM f WHERE wrong IS NULL AND k % 41 <> 0 GROUP BY kind, slice)
 SELECT kind, CAST(slice AS VARCHAR) AS slice, level, message, n, CAST(first_pos AS INT) AS first_pos FROM o"""


def exported(s, d):
    """The two outputs joined again: what a client has that loads both."""
    rows = instances(s, d).withColumn("description", F.when(F.col("id") % 3 != 0, F.concat(F.lit("About \"listing\" "), "id")))
    venues = read(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")).filter("id % 4 <> 0")
    narrow, wide = io.export_instances(rows, venues, scratch(s, "export"))
    return narrow.join(wide, "n", "left")


EXPORTED = """, v AS (SELECT s_suppkey AS id, s_name AS name, row_number() OVER (ORDER BY s_suppkey) - 1 AS v FROM supplier WHERE s_suppkey % 4 <> 0),
 g AS (SELECT i.id, any_value(program) AS program, any_value(venue) AS venue, string_agg('[' || day || ',' || s || ',' || e || ',' || (CAST(eu AS INT) + CAST(ad AS INT) * 4 + CAST(og AS INT) * 8) || ']', ',' ORDER BY day) AS i FROM i GROUP BY i.id)
 SELECT row_number() OVER (ORDER BY g.id) AS n, '{"id":' || g.id || ',"p":"' || program || '","v":' || coalesce(CAST(v AS VARCHAR), 'null') || ',"vn":' || coalesce('"' || name || '"', 'null') || ',"i":[' || i || ']}' AS json, CASE WHEN g.id % 3 <> 0 THEN 'About "listing" ' || g.id END AS text FROM g LEFT JOIN v ON v.id = g.venue"""


def publish(s, d):
    """Two editions of a table: the one with errors stays unpublished."""
    rows = audits.texts(s, d)
    found = quality.validate(rows, "id", audits.schema_rules()).filter("level = 'error'")
    clean = rows.join(found.select("id").distinct(), "id", "left_anti")
    out = None
    for name, df in (("all", rows), ("clean", clean)):
        to = scratch(s, f"published-{name}")
        done = io.publish_if_clean(df, quality.validate(df, "id", audits.schema_rules()), to)
        one = (s.read.schema(df.schema).parquet(to) if done else df.limit(0)).agg(F.lit(name).alias("edition"), F.lit(done).alias("published"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


#: The first and the last day of the week that day summaries tell of, from the first festival day on.
WEEK = (3, 16)


def day_summary(s, d):
    """Days of the sessions, the programs as lanes of different lengths from the week's start on; every seventh day is an interchange."""
    rows = schedule.timed(sessions(s, d)).withColumn("day", schedule.festival_day(F.col("s")))
    start = F.lit(rows.agg(F.min("day")).first()[0])
    days = rows.groupBy("day").agg(F.min(F.when(F.col("featured"), F.struct("s", "title")))["title"].alias("featured"), F.count("*").alias("n"))
    days = days.select("day", F.coalesce((F.col("day") - start) % 7 == 5, F.lit(False)).alias("interchange"), F.when((F.col("day") - start) % 3 != 0, F.col("featured")).alias("featured"), "n")
    k = F.length("program")
    lanes = rows.select("program").distinct().withColumn("a", start + k - 3).withColumn("b", F.col("a") + F.when(F.col("program") == "view", 40).otherwise(k * k % 11 + 1))
    lanes = lanes.withColumn("a", F.when(F.col("program") == "view", start).otherwise(F.col("a")))
    day = F.sequence("a", "b")
    themes = F.map_from_arrays(day, F.transform(day, lambda x: F.when(x % 3 == 0, "Opening party").when(x % 3 == 1, F.concat(F.lit("Theme "), x)).otherwise(F.lit(None))))
    first = rows.agg(F.min("day")).first()[0]
    return schedule.day_summary(days, lanes.withColumns({"nightly": F.col("program") == "click", "themes": themes}), (first + WEEK[0], first + WEEK[1])).withColumn("parts", F.array_join("parts", "; "))


DAYS = W + f""", z AS (SELECT min(day) AS z FROM t), dd AS (SELECT day, (day - z) % 7 = 5 AS interchange, CASE WHEN (day - z) % 3 <> 0 THEN arg_min(title, (s, title)) FILTER (WHERE featured) END AS featured, count(*) AS n FROM t, z GROUP BY day, z),
 l AS (SELECT DISTINCT program, CASE WHEN program = 'view' THEN z ELSE z + length(program) - 3 END AS a, CASE WHEN program = 'view' THEN z + 41 ELSE z + length(program) - 3 + length(program) * length(program) % 11 + 1 END AS b, z FROM t, z),
 r AS (SELECT *, unnest(range(greatest(a, z + {WEEK[0]}), least(b, z + {WEEK[1]}) + 1)) AS day FROM l WHERE NOT (a < z + {WEEK[0]} AND b > z + {WEEK[1]})),
 q AS (SELECT *, day = a AS f, day = b AS e, program = 'click' AS nightly, CASE day % 3 WHEN 0 THEN 'Opening party' WHEN 1 THEN 'Theme ' || day END AS th FROM r),
 v AS (SELECT *, CASE WHEN f THEN program || ' opens' END AS opens, CASE WHEN e AND NOT f THEN program || CASE WHEN nightly THEN '''s last night' ELSE '''s last day' END END AS ends, CASE WHEN nightly AND NOT f AND NOT e THEN program || ' night ' || (day - a + 1) || ' of ' || (b - a + 1) END AS night,
  CASE WHEN th IS NOT NULL AND NOT (f AND th = 'Opening party') THEN CASE WHEN f OR e THEN th ELSE program || ': ' || th END END AS says FROM q),
 g AS (SELECT day, count(*) AS k, list(opens ORDER BY program) FILTER (WHERE opens IS NOT NULL) AS opens, list(ends ORDER BY program) FILTER (WHERE ends IS NOT NULL) AS ends, list(night ORDER BY program) FILTER (WHERE night IS NOT NULL) AS nights, list(says ORDER BY program) FILTER (WHERE says IS NOT NULL AND b - a < 4) AS short, list(says ORDER BY program) FILTER (WHERE says IS NOT NULL AND b - a >= 4) AS long FROM v GROUP BY day),
 w AS (SELECT dd.day, n, list_concat(CASE WHEN interchange THEN ['Interchange: all ' || ['no', 'one', 'two', 'three', 'four', 'five', 'six'][coalesce(k, 0) + 1] || ' run'] ELSE [] END, coalesce(opens, []), coalesce(ends, []))[1:2] AS news, list_concat(coalesce(nights, []), coalesce(short, []), CASE WHEN featured IS NOT NULL THEN [featured] ELSE [] END, coalesce(long, [])) AS details FROM dd LEFT JOIN g ON g.day = dd.day),
 y AS (SELECT day, n, list_concat(news, CASE WHEN len(news) < 2 THEN details[1:1] ELSE [] END) AS p FROM w) SELECT day, array_to_string(CASE WHEN len(p) < 3 THEN list_append(p, n || CASE WHEN n = 1 THEN ' event' ELSE ' events' END) ELSE p END, '; ') AS parts FROM y"""


def feed_stream(s, d):
    stream = jobs.file_stream(s, f"{d}/pages.parquet")
    return jobs.feed_stream(audits.labelled(audits.items_of(stream)), audits.known(s, d))


def plan_state_stream(s, d):
    stream = jobs.file_stream(s, f"{d}/events.parquet")
    return jobs.latest_plans(audits.toggles_of(stream))


def live_board_stream(s, d):
    to = scratch(s, "ticks")
    audits.ticks(s).coalesce(1).write.parquet(to)
    return jobs.board_stream(jobs.file_stream(s, to), schedule.timed(sessions(s, d)).select("id", "s", "e"))


STAMP = "strftime(make_timestamp(CAST({0} * 1000000 AS BIGINT)), '%Y%m%dT%H%M%S')"

QUERIES = {
    "load_entities": (load_entities, ENTITIES),
    "publish_if_clean": (publish, audits.FOUND + ", e AS (SELECT DISTINCT id FROM f WHERE level = 'error') SELECT 'all' AS edition, false AS published, 0 AS n UNION ALL SELECT 'clean', true, count(*) FROM tx WHERE id NOT IN (SELECT id FROM e)"),
    "load_slices": (load_slices, SLICES),
    "export_instances_json": (exported, I + EXPORTED),
    "calendar_feed": (
        lambda s, d: io.calendar_feed(sessions(s, d)).select("user_id", F.sha2("ics", 256).alias("sha"), F.length("ics").alias("n_chars")),
        f"WITH {SESSIONS}, b AS (SELECT user_id, s, id, concat_ws(chr(10), 'BEGIN:VEVENT', 'UID:' || id, 'SUMMARY:' || title, CASE WHEN ad OR tu THEN 'DTSTART;VALUE=DATE:' || {STAMP.format('s')}[1:8] ELSE 'DTSTART:' || {STAMP.format('s')} END, CASE WHEN NOT (ad OR tu) AND NOT eu THEN 'DTEND:' || {STAMP.format('e')} END, CASE WHEN cancelled THEN 'STATUS:CANCELLED' END, 'END:VEVENT') AS block FROM x), g AS (SELECT user_id, string_agg(block, chr(10) ORDER BY s, id) AS ics FROM b GROUP BY user_id) SELECT user_id, sha256(ics) AS sha, length(ics) AS n_chars FROM g",
    ),
    "day_summary": (day_summary, DAYS),
    "feed_stream": (feed_stream, audits.CURRENT),
    "plan_state_stream": (plan_state_stream, audits.QUERIES["plan_state"][1]),
    "live_board_stream": (live_board_stream, audits.QUERIES["live_board_changes"][1]),
}
