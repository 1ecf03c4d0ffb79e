"""Boundaries of the schedule algebra and mutations of clean rows, on tiny tables."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import directory, feed, geo, quality, records, schedule, search
from tessera.plans import audits
from tessera.plans import records as record_plans

H = 3600


def session(spark, rows):
    base = {"user_id": 1, "program": "p", "venue": 1, "eu": False, "tu": False, "ad": False, "og": False, "cancelled": False, "featured": False, "title": "T", "kind": "K1"}
    schema = "id long, s long, e long, user_id long, program string, venue int, eu boolean, tu boolean, ad boolean, og boolean, cancelled boolean, featured boolean, title string, kind string"
    return spark.createDataFrame([tuple((base | {"id": i} | r)[c.split()[0]] for c in schema.split(", ")) for i, r in enumerate(rows)], schema)


@pytest.mark.parametrize(("at", "want"), [(-31 * 60, "upcoming"), (-30 * 60, "soon"), (-1, "soon"), (0, "live"), (H - 1, "live"), (H, "past")])
def test_status_boundaries(spark, at, want):
    row = session(spark, [{"s": 100_000, "e": 100_000 + H}]).select(schedule.status(100_000 + at).alias("x")).first()
    assert row.x == want


def test_status_without_an_end_or_hours(spark):
    df = session(spark, [{"s": 0, "e": H, "eu": True}, {"s": 0, "e": H, "tu": True}])
    assert [r.x for r in df.select(schedule.status(60).alias("x")).collect()] == ["started", None]


def test_festival_day_begins_at_five(spark):
    df = spark.createDataFrame([(10 * 86400 + 5 * H - 1,), (10 * 86400 + 5 * H,)], "s long")
    assert [r.x for r in df.select(schedule.festival_day(F.col("s")).alias("x")).collect()] == [9, 10]


def test_conflict_kinds(spark):
    df = session(spark, [
        {"user_id": 1, "s": 0, "e": H}, {"user_id": 1, "s": H // 2, "e": 2 * H},  # overlap, 30 minutes
        {"user_id": 2, "s": 0, "e": H}, {"user_id": 2, "s": H, "e": 2 * H},  # they touch: nothing
        {"user_id": 3, "s": 0, "e": H, "eu": True}, {"user_id": 3, "s": 0, "e": 2 * H},  # same start
        {"user_id": 4, "s": 0, "e": H}, {"user_id": 4, "s": 60, "e": H, "eu": True},  # starts during
        {"user_id": 5, "s": 0, "e": H, "eu": True}, {"user_id": 5, "s": H - 1, "e": 2 * H},  # maybe
        {"user_id": 6, "s": 0, "e": H, "eu": True}, {"user_id": 6, "s": H, "e": 2 * H},  # beyond the window
        {"user_id": 7, "s": 0, "e": H}, {"user_id": 7, "s": 0, "e": H, "og": True},  # ongoing ones don't count
    ])
    got = {r.user_id: (r.kind, r.minutes) for r in schedule.interval_overlap(df).collect()}
    assert got == {1: ("overlap", 30), 3: ("same", None), 4: ("during", None), 5: ("maybe", None)}


def test_expansion(spark):
    rows = [(1, "p", 1, 100, 3, 22 * 60, 60), (2, "p", 1, 100, 1, 600, None), (3, "p", 1, 90, 19, None, None)]
    df = spark.createDataFrame(rows, "id long, program string, venue int, d long, n long, sm long, em long")
    got = {}
    for r in schedule.expand_instances(df, 100, 104).collect():
        got.setdefault(r.id, []).append((r.day, (r.s - r.day * 86400) // 60, (r.e - r.day * 86400) // 60, r.eu, r.ad, r.og))
    assert sorted(got[1]) == [(d, 1320, 1500, False, False, True) for d in (100, 101, 102)]
    assert got[2] == [(100, 600, 660, True, False, False)]
    assert sorted(got[3]) == [(d, 0, 1440, False, True, True) for d in range(100, 105)]


MUTATIONS = [
    ({"name": " a"}, "white space around"), ({"name": "a "}, "white space around"), ({"name": "a <b>c</b>"}, "holds markup"), ({"name": "TBD"}, "placeholder"), ({"name": "tba later"}, "placeholder"),
    ({"name": "Lorem ipsum dolor"}, "placeholder"), ({"name": "x" * 5001}, "too long"), ({"brand": None}, "missing"), ({"size": "x"}, "not a number"), ({"size": "1.5"}, "not a number"),
]


@pytest.mark.parametrize(("change", "message"), MUTATIONS)
def test_each_mutation_is_found_by_name(spark, change, message):
    row = {"id": 1, "name": "fine name", "brand": "b", "size": "3"}
    df = spark.createDataFrame([tuple((row | change).values()), tuple((row | {"id": 2}).values())], "id long, name string, brand string, size string")
    assert [(r.id, r.message) for r in quality.validate(df, "id", audits.schema_rules()).collect()] == [(1, message)]


def test_short_codes(spark):
    def plain(s):
        h = 2166136261
        for b in s.encode():
            h = (h ^ b) * 16777619 & 0xFFFFFFFF
        h, out = h % 36**5, ""
        for _ in range(5):
            h, d = divmod(h, 36)
            out = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + out
        return out

    names = ["", "a", "opening-night", "12345"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(quality.short_code(F.col("n")).alias("c"))
    assert [r.c for r in df.collect()] == [plain(n) for n in names]


def test_search_order(spark):
    rows = [("part", 1, "Light show", "", "", 1), ("part", 2, "The light", "", "", 2), ("part", 3, "Delight", "", "", 3), ("part", 4, "Dark", "light", "", 4), ("part", 5, "Dark", "", "light", 5), ("part", 6, "Light", "", "", 6)]
    index = search.build_search_index([spark.createDataFrame(rows, "kind string, id long, title string, subline string, keywords string, ord long")], ["part"])
    hits = search.rank_search(index, spark.createDataFrame([(1, "Light")], "qid long, query string"), []).orderBy("rank").collect()
    assert [(r.id, r.score) for r in hits] == [(6, 140), (1, 100), (2, 60), (3, 50), (4, 8), (5, 4)]


def test_search_short_terms(spark):
    rows = [("part", 1, "Red ai", "", "", 1), ("part", 2, "Red box", "", "", 2), ("part", 3, "Ai x", "", "", 3), ("part", 4, "x", "", "", 4)]
    index = search.build_search_index([spark.createDataFrame(rows, "kind string, id long, title string, subline string, keywords string, ord long")], ["part"])
    asked = spark.createDataFrame([(1, "ai"), (2, "red ai"), (3, "x"), (4, "red & box"), (5, " & ,")], "qid long, query string")
    hits = {}
    for r in search.rank_search(index, asked, []).orderBy("rank").collect():
        hits.setdefault(r.qid, []).append(r.id)
    assert hits == {1: [3, 1], 2: [1], 3: [4, 3, 2], 4: [2]}


def test_whole_days_are_never_on_now_and_next_takes_now(spark):
    now = 100 * 86400 + 18 * H
    df = session(spark, [{"s": now - H, "e": now + H, "ad": True}, {"s": now, "e": now + H}, {"s": now + 2 * H, "e": now + 3 * H}, {"s": now - H, "e": now + H, "og": True}])
    got = {r.id: (r.on_now, r.next, r.tonight) for r in schedule.when_preset(df, now).collect()}
    assert got == {1: (True, True, True), 2: (False, False, True), 3: (True, False, True)}


def test_two_times_of_one_session_never_conflict(spark):
    df = session(spark, [{"id": 7, "s": 0, "e": H}, {"id": 7, "s": 60, "e": H}, {"id": 8, "s": 0, "e": 3000 * H}, {"id": 9, "s": 2999 * H, "e": 2999 * H + 60}])
    got = sorted((r.id, r.other, r.kind, r.minutes) for r in schedule.interval_overlap(df).collect())
    assert got == sorted([(7, 8, "overlap", 60), (7, 8, "overlap", 59), (8, 7, "overlap", 60), (8, 7, "overlap", 59), (8, 9, "overlap", 1), (9, 8, "overlap", 1)])


def test_at_this_hour(spark):
    now = 100 * 86400 + 16 * H
    rows = [
        {"s": now - H, "e": now + H, "program": "b"}, {"s": now - 60, "e": now + H, "program": "a"}, {"s": now - 2 * H, "e": now + H, "eu": True}, {"s": now - 60, "e": now - 30, "eu": True, "featured": True},
        {"s": now - 5 * H, "e": now + H, "og": True}, {"s": now - 5 * H, "e": now + H, "og": True, "eu": True}, {"s": now, "e": now + H, "og": True, "tu": True},
        {"s": now + 2 * H, "e": now + 3 * H, "program": "b"}, {"s": now + 4 * H, "e": now + 5 * H}, {"s": now + 10 * H, "e": now + 11 * H, "featured": True}, {"s": now + 14 * H, "e": now + 15 * H},
    ]
    got = sorted((r.section, r.rank, r.id, r.n_more) for r in schedule.at_this_hour(session(spark, rows), now, ("a", "b")).collect())
    assert got == sorted([("now", 1, 3, 0), ("now", 2, 1, 0), ("now", 3, 0, 0), ("open", 1, 4, 0), ("next", 1, 7, 0), ("tonight", 1, 8, 0), ("tonight", 2, 9, 0), ("on_view", 1, None, 1)], key=lambda x: (x[0], x[1]))
    later = schedule.at_this_hour(session(spark, [{"s": now + 5 * H, "e": now + 6 * H, "og": True}, {"s": now + 6 * H, "e": now + 7 * H}]), now).collect()
    assert [(r.id) for r in later if r.section == "next"] == [1]


def test_gaps_without_a_place_are_unknown(spark):
    df = session(spark, [{"s": 20 * H, "e": 21 * H, "venue": 1}, {"s": 21 * H + 90, "e": 22 * H, "venue": 2}, {"s": 22 * H, "e": 22 * H + 60, "venue": 2, "eu": True}, {"s": 23 * H, "e": 24 * H, "venue": 1}])
    venues = spark.createDataFrame([(1, 39_100_000, -84_500_000)], "id int, lat long, lng long")
    got = {r.id: (r.kind, r.metres, r.minutes, r.free_min) for r in schedule.walk_gaps(df, venues).collect()}
    assert got == {1: ("unknown", None, None, 2), 2: ("same", 0, 0, 0), 3: ("unknown", None, None, None)}


def test_lanes_of_a_week(spark):
    lanes = spark.createDataFrame([("thru", 5, 40), ("a", 8, 12), ("b", 11, 13), ("one", 12, 12)], "program string, a long, b long")
    cells = {(r.program, r.day): r.cell for r in schedule.program_calendar(lanes, 11 * 86400, 10, 14).collect()}
    assert [cells["a", d] for d in range(10, 15)] == ["mid", "mid", "end", None, None] and cells["b", 11] == "start" and cells["one", 12] == "only" and cells["thru", 14] == "thru"
    assert [r.day for r in schedule.interchange_days(lanes, 10, 14).collect()] == [12]
    assert schedule.interchange_days(lanes.filter("program in ('thru', 'a')"), 10, 14).count() == 0


def test_only_an_exact_title_leads(spark):
    rows = [("event", 1, "Light show", "", "", 1), ("place", 2, "Light", "", "", 2), ("event", 3, "Café-Léger ﬁnal", "", "", 3)]
    index = search.build_search_index([spark.createDataFrame(rows, "kind string, id long, title string, subline string, keywords string, ord long")], ["event", "place"])
    hits = search.rank_search(index, spark.createDataFrame([(1, "light sh"), (2, "light"), (3, "leger"), (4, "FINAL"), (5, "light light")], "qid long, query string"), [])
    assert {r.qid: (r.id, r.score) for r in hits.filter("rank = 1 and qid > 2").collect()} == {3: (3, 30 + 30), 4: (3, 30 + 30), 5: (2, 80)}
    groups = {(r.qid, r.place): r.kind for r in search.group_search(hits, ["event", "place"]).collect()}
    assert groups[1, 1] == "event" and groups[2, 1] == "place" and groups[2, 2] == "event"


def test_first_up_takes_running_and_ongoing_ones_once_each_and_shows_them_by_start(spark):
    now = 100 * 86400 + 16 * H
    rows = [
        {"s": now - H, "e": now + H}, {"s": now - 5 * H, "e": now + 60, "og": True}, {"s": now + H, "e": now + 2 * H, "program": "also"}, {"s": now + 3 * H, "e": now + 4 * H, "featured": True},
        {"id": 0, "s": now + 25 * H, "e": now + 26 * H, "featured": True}, {"s": now + 60, "e": now + H, "tu": True}, {"s": now, "e": now + H, "ad": True}, {"s": now - 2 * H, "e": now + 9 * H, "eu": True},
        {"s": now + 60, "e": now + 90, "cancelled": True}, {"s": now + 30 * H, "e": now + 31 * H, "program": "a"}, {"s": now + 29 * H, "e": now + 31 * H},
    ]
    df = session(spark, rows)
    assert [(r.place, r.id) for r in schedule.first_up(df, now, ("a",)).orderBy("place").collect()] == [(1, 1), (2, 0), (3, 3), (4, 9)]
    assert [r.id for r in schedule.first_up(df, now, ("a",), most=2).orderBy("place").collect()] == [1, 3]


def test_next_up_counts_ongoing_whole_day_and_untimed_ones(spark):
    df = session(spark, [{"s": 60, "e": H, "og": True}, {"s": 3 * H, "e": 4 * H}, {"s": 30, "e": H, "cancelled": True}, {"user_id": 2, "s": -H, "e": 5, "ad": True}, {"user_id": 2, "s": H, "e": 2 * H}, {"user_id": 3, "s": -H, "e": 0}])
    assert {r.user_id: r.id for r in schedule.next_up(df, 0).collect()} == {1: 0, 2: 3}


def test_what_scores_below_nothing_is_no_hit(spark):
    rows = [("event", 1, "Dark", "", "light", 1, 0, 50), ("event", 2, "Dark", "light", "", 2, 0, 50), ("event", 3, "Dark", "", "light", 3, None, None)]
    index = search.build_search_index([spark.createDataFrame(rows, "kind string, id long, title string, subline string, keywords string, ord long, st long, en long")], ["event"])
    hits = search.rank_search(index, spark.createDataFrame([(1, "light")], "qid long, query string"), [], now=100).collect()
    assert sorted((r.id, r.score) for r in hits) == [(2, 3), (3, 4)]


@pytest.mark.parametrize(("text", "want"), [
    *((t, "yes") for t in ("Free", "Free to the Public", "free admission for all", "Free, drop-in.", "Free (approval required)", "This is a FREE EVENT, but you must register to receive a ticket.", "Entry is free.")),
    *((t, "no") for t in ("$40", "Tickets start at $39", "$54.42 (registration, incl. fees)", "Ticket required. Adult: $ 19.50")),
    *((t, "unknown") for t in ("Free to Biennial Pass Holders", "Free for Pass Holders in October. General admission: $15", "FREE with admission or membership", "Free add-on to any ticket", "$0.00 add-on, with a ticket ($300.00)", "Ticketed. Free for members. $17.", None, "", "Drinks are free", "$10, free for kids", "Tickets at the door", "Freedom")),
])
def test_free(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(directory.free_class(F.col("t"))).first()[0] == want


@pytest.mark.parametrize(("url", "want"), [
    ("HTTPS://WWW.A.com/B/?ocid=1&ref=2&mc_z=3&utm_x=4&cmpid=5&fbclid=6#top", "a.com/B?ref=2"), ("http://a.com", "a.com/"), ("http://a.com//", "a.com/"), (" https://a.com/x?a&b=&c=1%202+3 ", "a.com/x?a=&b=&c=1+2+3"),
    ("https://a.com/x?q=%7Ea*", "a.com/x?q=~a%2A"), ("https://a.com/x?q=%zz", "a.com/x?q=%25zz"), ("", "/"), ("/only/path/", "/only/path"),
])
def test_canonical_url(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(feed.canonical_url(F.col("u"))).first()[0] == want


def test_feed_refresh_goes_through_queries_in_order(spark):
    """Caps count titles that are new in a query, later spellings add tags, known titles and addresses go."""
    rows = [
        (1, 0, 1, "https://a/1", "One", ["x"], 10), (2, 0, 2, "https://a/2", "one!", ["y"], 20), (3, 0, 3, "https://a/3", "Two", ["x"], 30), (4, 0, 4, "https://a/4", "Three", ["x"], 40),
        (5, 1, 1, "https://a/5", "THREE", ["z"], 50), (6, 1, 2, "https://a/6", "Two", ["z"], 60), (7, 1, 3, "https://a/5?utm_a=1", "Four", ["z"], 5), (8, 1, 4, "https://a/8", "Five", ["z"], 70),
        (9, 2, 1, "http://a/9", "Six", ["x"], 80), (10, 2, 2, "https://a/10", "Known", ["x"], 80), (11, 2, 3, "https://k/1/", "Seven", ["x"], 81), (12, 2, 4, "https://a/12", "TBD", ["x"], 81), (13, 2, 5, "https://a/13", "Eight", [], 81), (14, 2, 6, "https://a/14", "Nine", ["x"], -100),
    ]
    items = spark.createDataFrame(rows, "id long, query int, ord long, url string, title string, tags array<string>, t long").withColumn("label", F.lit("L"))
    existing = spark.createDataFrame([("https://k/1", "x"), ("https://k/2", "known")], "url string, title string")
    got = {r.title_key: (r.id, r.tags) for r in feed.feed_refresh(items, existing, 100, days=0.0013, per_query=2, per_run=9).collect()}
    assert got == {"one": (1, "x,y"), "two": (3, "x,z"), "three": (5, "z")}


def test_an_entry_may_reach_beyond_the_radius(spark):
    schema = "id long, title string, credits array<string>, category int, zone int, lat long, lng long"
    entries = spark.createDataFrame([(1, "aaa", [], 1, 1, 39_100_000, -84_500_000, 400), (2, "bbb", [], 1, 1, 39_200_000, -84_500_000, 100)], schema + ", reach long")
    works = spark.createDataFrame([(1, "ccc", [], 1, 1, 39_102_700, -84_500_000), (2, "ddd", [], 1, 1, 39_202_700, -84_500_000)], schema)
    got = [(r.a, r.b, r.tier) for r in records.match_tiers(entries, works).collect()]
    assert got == [(1, 1, 3)]


def test_roles_by_rule_order_then_curation_then_kind(spark):
    rules = record_plans.rules(spark)
    rows = [(1, 1, 1, "Speaker and artist", False, "talk", ["host"]), (1, 2, 1, None, True, "talk", []), (1, 3, 1, None, False, "talk", ["artist", "moderator"]), (1, 4, 1, None, False, "concert", ["host"]), (1, 5, 1, "Thanks", True, "talk", ["host"]), (1, 6, 1, None, False, "talk", []), (1, 6, 2, "Curator", False, "talk", []), (1, 7, 1, "Curated by", True, "talk", []), (1, 8, 1, "ORGANIZED: organizer", False, "talk", []), (1, 9, 1, "Filmmaker", False, "talk", ["host"]), (1, 10, 1, "Faculty advisor", False, "x", []), (1, 11, 1, "Juror and curator", False, "x", [])]
    credits = spark.createDataFrame(rows, "person long, event long, ord int, label string, curated boolean, kind string, roles array<string>")
    got = {r.event: r.role for r in records.role_inference(credits, rules).collect()}
    assert got == {1: "artist", 2: "curator", 3: "moderator", 4: "host", 5: "host", 6: "curator", 7: "artist", 8: "organizer", 9: "artist", 10: "organizer", 11: "judge"}


@pytest.mark.parametrize(("text", "query", "want"), [
    ("Light show", "light", [(0, 5)]), ("Café Léger", "cafe leger", [(0, 4), (5, 10)]), ("Cafe\u0301 x", "cafe", [(0, 5)]), ("ﬁnal ﬁne", "fin", [(0, 2), (5, 7)]), ("ﬁx", "ix", [(0, 2)]), ("banana", "ana nan", [(1, 5)]), ("aaa", "aa", [(0, 2)]),
    ("abcd", "ab cd", [(0, 2), (2, 4)]), ("a b", "a", []), ("", "light", []), ("😀 light", "LIGHT", [(2, 7)]), ("d’Art", "d'art", [(0, 5)]), ("xyz", "", []), (None, "x y", []), ("İstanbul", "stan", [(1, 5)]),
])
def test_spans_are_in_the_text_as_it_is(spark, text, query, want):
    row = spark.createDataFrame([(text, query)], "t string, q string").select(search.match_spans(F.col("t"), F.col("q")).alias("x")).first()
    assert [tuple(x) for x in row.x] == want


def test_uncertainty_covers_nine_of_ten_controls_left_out(spark):
    """Residuals that grow across a map: what is said around each control covers its own in about the asked share."""
    import random

    rng = random.Random(3)
    rows = [(m, c, x, y, abs(rng.gauss(0, 10 + x / 20)), c % 5 != 0) for m in range(4) for c in range(150) for x, y in [(rng.random() * 1000, rng.random() * 800)]]
    residuals = spark.createDataFrame(rows, "map long, c long, cx double, cy double, r double, counts boolean")
    factors = {r.map: (r.factor, r.n) for r in geo.uncertainty_factors(residuals).collect()}
    assert all(f > 1 and n == 120 for f, n in factors.values())
    covered = 0
    for m, c, x, y, r, counts in rows:
        others = [(1 / ((x - a) ** 2 + (y - b) ** 2 + 1600) ** 2, e) for n, k, a, b, e, _ in rows if n == m and k != c]
        covered += counts and r <= max(15, 5 * -(-factors[m][0] * (sum(w * e * e for w, e in others) / sum(w for w, _ in others)) ** 0.5 // 5))
    assert 0.88 <= covered / 480 <= 0.97
    pins = residuals.select("map", F.col("c").alias("pin"), F.col("cx").alias("x"), F.col("cy").alias("y"))
    got = geo.position_uncertainty(pins, residuals).collect()
    assert len(got) == 600 and all(r.approx_m >= 15 and r.approx_m % 5 == 0 for r in got)
    none = geo.uncertainty_factors(residuals.withColumn("counts", F.lit(False))).collect()
    assert {(r.factor, r.n) for r in none} == {(2.0, 0)}


def test_stays_by_id_address_and_name(spark):
    rows = [
        (1, "a", "x1", "The Grand Hotel", "210 East Sixth Street, Town", None), (2, "b", "x2", "Grand Hotel & Suites", "210 E 6th St.", "u2"), (3, "b", "x3", "Grän-d  hotel", None, "u3"), (4, "c", "x1", "Something else", None, None),
        (5, "a", "y1", "Homewood Inn", "210 E. 6th Street", None), (6, "a", "y2", "Grand Hotel (annex)", "Sixth Street", None), (7, "a", "y3", "", None, None), (8, "a", "y4", None, None, None),
    ]
    df = spark.createDataFrame(rows, "row long, slice string, stay string, name string, address string, url string")
    got = {r.group: (r.stay, r.n, r.slices, r.url) for r in records.merge_stays(df, ["address", "url"]).collect()}
    assert got == {1: ("x1", 5, "a+b+c", "u2"), 5: ("y1", 1, "a", None), 7: ("y3", 1, "a", None), 8: ("y4", 1, "a", None)}


def test_organisations_keep_all_roles_and_tell_ids_apart(spark):
    role = "array<struct<program:string,relationship:string,tier:string>>"
    rows = [
        ("s1", 1, "acme", "Acme, Inc.", None, None, [("p", "sponsor", "gold")]), ("s2", 2, "acme2", "The ACME (Cincinnati) Co.", "l", None, [("q", "partner", None), ("p", "sponsor", "gold")]), ("s2", 3, "acme", "Other", None, "u", None),
        ("s1", 4, "pg", "P&G", None, None, [("p", "sponsor", None)]), ("s3", 5, "pg9", "Procter & Gamble", None, "v", [("p", "sponsor", None)]),
    ]
    same = spark.createDataFrame([("pandg", "procterandgamble")], "key string, is string")
    df = spark.createDataFrame(rows, f"slice string, ord long, id string, name string, logo string, url string, roles {role}")
    got = {r.key: (r.id, r.name, r.logo, r.url, [tuple(x) for x in r.roles], r.n_slices) for r in records.merge_orgs(df, same).collect()}
    assert got == {
        "acme": ("acme", "Acme, Inc.", "l", None, [("p", "sponsor", "gold"), ("q", "partner", None)], 2), "other": ("acme-s2", "Other", None, "u", [], 1), "procterandgamble": ("pg", "P&G", None, "v", [("p", "sponsor", None)], 2),
    }


def test_time_rules(spark):
    kind = "id long, d long, end long, ad boolean, sm int, em int, occurrences array<struct<day:long,sm:int,em:int>>"
    rows = [(1, 9300, 9299, False, 600, 660, None), (2, 9300, None, True, 600, None, None), (3, 9300, 9301, False, None, 660, None), (4, 9300, None, False, 1380, 360, None), (5, 9300, None, False, 1380, 361, [(9000, 1, 2), (9300, 700, 650), (9300, 1380, 30)]), (6, 9100, 9150, False, None, None, None), (7, 9100, 9200, True, None, None, [])]
    found = sorted((r.id, r.path, r.message) for r in quality.validate(spark.createDataFrame(rows, kind), "id", audits.time_rules()).collect())
    assert found == [
        (1, "end", "before the first day"), (2, "ad", "a whole day has no times"), (3, "em", "end without start"), (5, "em", "ends before it starts"), (5, "occurrences[0]", "outside the window"), (5, "occurrences[1]", "ends before it starts"), (6, "d", "outside the window"),
    ]


def test_a_clean_page_and_one_with_every_mistake(spark):
    clean = '<title>t</title><meta name="description" content="x"><link rel="canonical" href="https://a/"><h1>x</h1><img alt="" width=1 height=2 src=a><a href="https://b/" target="_blank" rel="noopener">b (opens in a new tab)</a><a href="b.html">b</a>'
    bad = '<h1>x</h1><h1 class="y">z</h1><i id="a"></i><i id="a"></i><img src=a width=1><a href="#">x</a><a href="http://b/">b</a><a href="https://b/">b</a>'
    found = sorted((r.page_id, r.path, r.message) for r in quality.page_rules(spark.createDataFrame([(1, clean), (2, bad)], "page_id long, html string")).withColumnRenamed("id", "page_id").collect())
    assert [x[0] for x in found] == [2] * 11
    assert {x[2] for x in found} == {
        "not exactly one h1", "no title", "no description", "no canonical address", "an id twice", "image without alt", "image without width and height", "plain http link", "empty link", "outward link without its own tab", "outward link that does not say so",
    }


def test_a_day_in_at_most_three_parts(spark):
    lanes = spark.createDataFrame([("A", 10, 12, False, {11: "Talks", 10: "Opening night"}), ("B", 8, 13, True, {12: "Light"}), ("C", 1, 40, False, {11: "thru"}), ("D", 12, 12, False, None)], "program string, a long, b long, nightly boolean, themes map<bigint,string>")
    days = spark.createDataFrame([(8, False, None, 1), (9, False, "F", 4), (10, True, "F", 5), (11, False, "F", 2), (12, False, None, 3), (13, False, None, 0), (20, False, "G", None)], "day long, interchange boolean, featured string, n long")
    got = {r.day: r.parts for r in schedule.day_summary(days, lanes, (8, 13)).collect()}
    assert got == {
        8: ["B opens", "1 event"], 9: ["B night 2 of 6", "4 events"], 10: ["Interchange: all two run", "A opens", "5 events"], 11: ["B night 4 of 6", "2 events"], 12: ["D opens", "A's last day", "3 events"], 13: ["B's last night", "0 events"], 20: ["G"],
    }


def test_extents_are_four_to_three_inside_the_map(spark):
    points = spark.createDataFrame([("one", 500, 400), ("wide", 100, 300), ("wide", 900, 310), ("corner", 5, 995), ("out", 2000, 3)], "g string, x long, y long")
    got = {r.g: (r.x0, r.y0, r.w, r.h) for r in geo.extent_fit(points, "g", (1000, 1000)).collect()}
    assert got == {"one": (400.0, 325.0, 200.0, 150.0), "wide": (60.0, 0.0, 880.0, 660.0), "corner": (0.0, 850.0, 200.0, 150.0)}
