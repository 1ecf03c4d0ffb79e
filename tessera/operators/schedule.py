"""Schedule algebra: sessions have s and e in seconds and the flags of plans.lenses; ``now`` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY, HOUR, CUT = 86400, 3600, 5 * 3600
#: sessions of more than LONG windows meet others in buckets of WIDE windows
LONG, WIDE = 24, 720


def festival_day(s: Column) -> Column:
    """Days since 1970; a session before five in the morning belongs to the day before."""
    return F.floor((s - CUT) / DAY).cast("long")


def timed(df: DataFrame) -> DataFrame:
    """Live sessions with hours: what counts on a day."""
    return df.filter("not cancelled and not tu and not ad and not og")


def expand_instances(series: DataFrame, first: int, last: int) -> DataFrame:
    """One row for each day of a listing inside [first, last]. Without an end it lasts an hour, an end before the start is
    the next day's, without a start it is the whole day."""
    rows = series.withColumn("day", F.explode(F.sequence(F.col("d"), F.col("d") + F.col("n") - 1))).filter(F.col("day").between(first, last))
    s = F.col("day") * DAY + F.coalesce(F.col("sm") * 60, F.lit(0))
    e = F.when(F.col("sm").isNull(), (F.col("day") + 1) * DAY).when(F.col("em").isNull(), s + HOUR).when(F.col("em") < F.col("sm"), (F.col("day") + 1) * DAY + F.col("em") * 60).otherwise(F.col("day") * DAY + F.col("em") * 60)
    return rows.select("id", "program", "venue", "day", s.cast("long").alias("s"), e.cast("long").alias("e"), (F.col("sm").isNotNull() & F.col("em").isNull()).alias("eu"), F.col("sm").isNull().alias("ad"), ((F.col("n") > 1) | F.col("sm").isNull()).alias("og"))


def sessions_per_festival_day(df: DataFrame) -> DataFrame:
    day = festival_day(F.col("s"))
    return timed(df).groupBy(day.alias("day")).agg(F.count("*").alias("n_sessions"), F.count_if(F.col("s") % DAY < CUT).alias("n_late"), F.countDistinct("title").alias("n_titles"))


def time_of_day_counts(df: DataFrame) -> DataFrame:
    h = F.col("s") % DAY / HOUR
    bucket = F.when(F.col("ad") | F.col("tu"), "allday").when(h < 5, "late").when(h < 12, "morning").when(h < 17, "afternoon").when(h < 21, "evening").otherwise("late")
    return df.filter("not cancelled and not og").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def status(now: int) -> Column:
    """No status without listed hours; the last half hour before a start is soon; a running one without an end is started."""
    return F.when(F.col("tu"), None).when(F.col("s") - now > 1800, "upcoming").when(F.col("s") > now, "soon").when(F.col("e") <= now, "past").when(F.col("eu"), "started").otherwise("live")


def status_board(df: DataFrame, now: int) -> DataFrame:
    rows = df.filter("not cancelled and not og").withColumn("status", status(now)).filter("status is not null")
    n = lambda x: F.count_if(F.col("status") == x).alias(x)
    live = F.col("status") == "live"
    return rows.groupBy("program").agg(*map(n, ("upcoming", "soon", "live", "started", "past")), F.coalesce(F.sum(F.when(live, F.floor((now - F.col("s")) / 60))), F.lit(0)).cast("long").alias("elapsed_min"), F.coalesce(F.sum(F.when(live, F.floor((F.col("e") - F.col("s")) / 60))), F.lit(0)).cast("long").alias("total_min"))


def next_instance(df: DataFrame, now: int) -> DataFrame:
    """Of each listing the instance that is on or comes next, else its last one."""
    coming = F.min(F.when(F.col("e") > now, F.struct("s", "e")))
    return df.groupBy("id").agg(F.coalesce(coming, F.max(F.struct("s", "e"))).alias("x")).select("id", "x.s", "x.e")


def next_up(df: DataFrame, now: int) -> DataFrame:
    """Of each plan the earliest session that has not ended; ongoing ones, whole days and such without hours count as well."""
    return df.filter(~F.col("cancelled") & (F.col("e") > now)).groupBy("user_id").agg(F.min(F.struct("s", "id")).alias("x")).select("user_id", F.col("x.id").alias("id"), F.col("x.s").alias("s"))


def live_count(df: DataFrame, now: int) -> DataFrame:
    return df.filter((F.col("s") <= now) & (F.col("e") > now) & ~F.col("cancelled") & ~F.col("eu") & ~F.col("tu") & ~F.col("ad")).agg(F.countDistinct("id").alias("n_live"))


def when_preset(df: DataFrame, now: int) -> DataFrame:
    """Sessions with hours (ongoing included): on_now (unknown ends not), next (they start within two hours from now on) and
    tonight (from 17:00, not ended, same festival day)."""
    base = ~F.col("cancelled") & ~F.col("tu") & ~F.col("ad")
    on = base & (F.col("s") <= now) & (F.col("e") > now) & ~F.col("eu")
    coming = base & (F.col("s") >= now) & (F.col("s") < now + 2 * HOUR)
    late = (F.col("s") % DAY >= 17 * HOUR) | (F.col("s") % DAY < CUT)
    tonight = base & late & (F.col("e") > now) & (festival_day(F.col("s")) == (now - CUT) // DAY)
    return df.select("id", on.alias("on_now"), coming.alias("next"), tonight.alias("tonight")).filter("on_now or next or tonight")


def at_this_hour(df: DataFrame, now: int, lanes: tuple[str, ...] = (), sizes: tuple[int, int, int, int] = (4, 2, 3, 6)) -> DataFrame:
    """(section, rank, id, n_more): now (timed sessions; an unknown end counts for an hour), open (ongoing ones whose hours
    include now), next (what starts within three hours, else the next start, that of a session before that of an ongoing
    one), tonight (what begins at 17:00 or later today and stands in neither now nor next), and one row on_view with the
    number of ongoing ones of today without hours. Featured ones come first, then the lanes in order, then the rest; next
    and tonight are shown by start. What is beyond a section's size is counted in n_more."""
    today = (now - CUT) // DAY
    end = F.when(F.col("eu"), F.col("s") + HOUR).otherwise(F.col("e"))
    rows = df.filter("not cancelled").select("id", "s", "og", end.alias("e"), "eu", rank_in(lanes).alias("order"), (~F.col("tu") & ~F.col("ad")).alias("hours"), (festival_day(F.col("s")) == today).alias("today"))
    on, later = F.col("hours") & (F.col("s") <= now) & (F.col("e") > now), F.col("hours") & (F.col("s") > now)
    late = F.col("today") & later & ((F.col("s") % DAY >= 17 * HOUR) | (F.col("s") % DAY < CUT))

    def told(rows: DataFrame, sections: dict[str, tuple[Column, int]], by_start: tuple[str, ...] = ()) -> tuple[dict[str, int], dict[str, list]]:
        """How many rows stand in each section, and the first ones: by start and rank in those named, by rank and start in others.
        One job; a row goes on once for each section that it stands in, and at most size rows of one leave a task."""
        each = rows.withColumn("section", F.explode(F.filter(F.array(*(F.when(c, name) for name, (c, _) in sections.items())), lambda x: x.isNotNull())))
        starts = F.col("section").isin(*by_start) if by_start else F.lit(False)
        keys = F.when(starts, F.struct(F.col("s").alias("x"), F.col("order").cast("long").alias("y"), "id")).otherwise(F.struct(F.col("order").cast("long").alias("x"), F.col("s").alias("y"), "id"))
        size = F.coalesce(*(F.when(F.col("section") == name, n) for name, (_, n) in sections.items()))
        rank = F.row_number().over(Window.partitionBy("section").orderBy("key"))
        most = max(n for _, n in sections.values())
        top = each.withColumn("key", keys).withColumn("rank", rank).filter(F.col("rank") <= most).filter(F.col("rank") <= size).select("section", "rank", "id", "s", "order", F.lit(None).cast("long").alias("n"))
        counts = each.groupBy("section").agg(F.count("*").alias("n")).select("section", F.lit(0).alias("rank"), *(F.lit(None).cast(each.schema[c].dataType).alias(c) for c in ("id", "s", "order")), "n")
        got = top.unionByName(counts).collect()  # some dozen rows
        found = {name: sorted((r for r in got if r.section == name and r["rank"]), key=lambda r: r["rank"]) for name in sections}
        return {r.section: r.n for r in got if not r["rank"]}, found

    soon = later & (F.col("s") < now + 3 * HOUR)
    n, found = told(rows, {"now": (on & ~F.col("og"), sizes[0]), "open": (on & F.col("og") & ~F.col("eu"), sizes[1]), "soon": (soon, sizes[2]), "plain": (later & ~F.col("og"), sizes[2]), "any": (later, sizes[2]), "view": (F.col("today") & F.col("og") & ~F.col("hours"), 0)}, ("plain", "any"))
    coming = found["soon"] or [r for r in found["plain"] or found["any"] if r.s == (found["plain"] or found["any"])[0].s]
    shown = sorted({r.id for r in [*found["now"], *coming]})
    n_late, evening = told(rows.filter(late & ~F.col("id").isin(*shown)) if shown else rows.filter(late), {"tonight": (F.lit(True), sizes[3])})

    start = lambda rows: sorted(rows, key=lambda r: (r.s, r.order, r.id))
    parts = {"now": (found["now"], n.get("now", 0) - sizes[0]), "open": (found["open"], n.get("open", 0) - sizes[1]), "next": (start(coming), 0), "tonight": (start(evening["tonight"]), n_late.get("tonight", 0) - sizes[3])}
    out = [(name, i + 1, r.id, max(0, more)) for name, (rows_of, more) in parts.items() for i, r in enumerate(rows_of)] + [("on_view", 1, None, n.get("view", 0))]
    return df.sparkSession.createDataFrame(out, f"section string, rank int, id {df.schema['id'].dataType.simpleString()}, n_more long")


def rank_in(lanes: tuple[str, ...]) -> Column:
    """Featured ones first, then the lanes in order, then the rest."""
    place = F.array_position(F.array(*map(F.lit, lanes)).cast("array<string>"), F.col("program"))
    return F.when(F.col("featured"), 0).otherwise(10) + F.when(place > 0, place - 1).otherwise(9)


def first_up(df: DataFrame, now: int, lanes: tuple[str, ...] = (), left_out: str = "also", most: int = 4) -> DataFrame:
    """(place, id, title, day, s): the first listings with hours that have not ended, running and ongoing ones included, each
    once; not those of the program left out. Whole days are taken in order, inside a day by rank, then start; what is taken is
    shown by start. An unknown end counts for an hour."""
    end = F.when(F.col("eu"), F.col("s") + HOUR).otherwise(F.col("e"))
    rows = df.filter(~F.col("cancelled") & ~F.col("tu") & ~F.col("ad") & (end > now) & ~F.col("program").eqNullSafe(left_out))
    rows = rows.groupBy("id").agg(F.min(F.struct(festival_day(F.col("s")).alias("day"), rank_in(lanes).alias("order"), "s", "title")).alias("x")).select("id", "x.*")
    taken = rows.orderBy("day", "order", "s", "id").limit(most)
    return taken.withColumn("place", F.row_number().over(Window.orderBy("s", "order", "id"))).select("place", "id", "title", "day", "s")  # at most ``most`` rows


def ongoing_band(instances: DataFrame) -> DataFrame:
    """Listings all of whose instances are ongoing, with their spans."""
    return instances.groupBy("id", "program").agg(F.bool_and("og").alias("all_og"), F.min("day").alias("first_day"), F.max("day").alias("last_day")).filter("all_og").drop("all_og")


def time_slots(df: DataFrame) -> DataFrame:
    rows = timed(df).withColumn("day", festival_day(F.col("s")))
    return rows.groupBy("day", "s").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("ids"))


def fold_ended(df: DataFrame, now: int) -> DataFrame:
    """A slot is live if any session is, past if all are, soon if any is; past slots fold away."""
    rows = timed(df).withColumn("status", status(now)).withColumn("day", festival_day(F.col("s")))
    any_of = lambda *x: F.bool_or(F.col("status").isin(*x))
    slot = F.when(any_of("live", "started"), "live").when(F.bool_and(F.col("status") == "past"), "past").when(any_of("soon"), "soon").otherwise("upcoming")
    return rows.groupBy("day", "s").agg(slot.alias("slot_status"), F.max("e").alias("ends"), F.count("*").alias("n")).withColumn("earlier", F.col("slot_status") == "past")


def day_tabs(df: DataFrame, first: int, last: int) -> DataFrame:
    """Every day of the calendar with its sessions and programs, empty days too."""
    days = df.sparkSession.range(first, last + 1).withColumnRenamed("id", "day")
    counts = timed(df).groupBy(festival_day(F.col("s")).alias("day")).agg(F.count("*").alias("n"), F.countDistinct("program").alias("n_programs"))
    return days.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_programs", F.lit(0)).alias("n_programs"), (F.col("day") == first).alias("first_day"), (F.col("day") == last).alias("last_day"))


def full_spans(instances: DataFrame) -> DataFrame:
    return instances.groupBy("id").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("n")).filter("n >= 2")


def lanes_of(instances: DataFrame) -> DataFrame:
    """(program, a, b): the first and the last day of each program."""
    return instances.groupBy("program").agg(F.min("day").alias("a"), F.max("day").alias("b"))


def program_calendar(lanes: DataFrame, now: int, first: int, last: int) -> DataFrame:
    """Program by day of the week [first, last] with how the lane runs on it: start, mid, end, only, thru (it runs past both
    ends of the week), or null; the day's place in the run, the lane's phase (before, running, over) and the days until it
    opens."""
    days = lanes.withColumn("day", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))))
    today = now // DAY
    runs = F.col("day").between(F.col("a"), F.col("b"))
    cell = F.when(~runs, None).when((F.col("a") < first) & (F.col("b") > last), "thru").when(F.col("a") == F.col("b"), "only").when(F.col("day") == F.col("a"), "start").when(F.col("day") == F.col("b"), "end").otherwise("mid")
    phase = F.when(F.col("a") > today, "before").when(F.col("b") < today, "over").otherwise("running")
    return days.select("program", "day", cell.alias("cell"), F.when(runs, F.col("day") - F.col("a") + 1).alias("nth"), (F.col("b") - F.col("a") + 1).alias("of"), phase.alias("phase"), F.greatest(F.col("a") - today, F.lit(0)).alias("days_until"))


def interchange_days(lanes: DataFrame, first: int, last: int) -> DataFrame:
    """Days of the week on which every lane runs that doesn't run past both ends of it; none with fewer than two of these."""
    solid = lanes.filter(~((F.col("a") < first) & (F.col("b") > last)))
    # the lanes' common days: from the last opening to the first closing
    common = solid.agg(F.count("*").alias("n"), F.greatest(F.max("a"), F.lit(first)).alias("a"), F.least(F.min("b"), F.lit(last)).alias("b")).filter("n >= 2 and a <= b")
    return common.select(F.explode(F.sequence("a", "b")).alias("day"), "n")


def nightly_flag(series: DataFrame) -> DataFrame:
    return series.groupBy("program").agg(F.bool_or((F.col("n") > 1) & (F.coalesce("sm", F.lit(0)) >= 17 * 60)).alias("nightly"))


def occurrence_rules(series: DataFrame, closed: int = 1, early: int = 0, early_end: int = 17 * 60) -> DataFrame:
    """Days of a listing without the weekly closed day; on the early day it ends by early_end (weekdays from 0, Sunday)."""
    rows = series.filter("sm is not null").withColumn("day", F.explode(F.sequence(F.col("d"), F.col("d") + F.col("n") - 1)))
    rows = rows.withColumn("weekday", F.pmod(F.col("day") + 4, F.lit(7)))
    end = F.when((F.col("weekday") == early) & (F.col("em") > early_end), early_end).otherwise(F.col("em"))
    return rows.filter(F.col("weekday") != closed).select("id", "day", "sm", end.cast("long").alias("em"))


def collapse_runs(instances: DataFrame) -> DataFrame:
    """Same title, venue and hours on several days become one row with its first and last day; differing hours are counted."""
    rows = instances.withColumn("hours", F.concat_ws("-", F.col("s") % DAY, F.col("e") - F.col("s")))
    return rows.groupBy("title", "venue").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("n"), F.countDistinct("hours").alias("n_hours"))


def gaps_to_occurrences(days: DataFrame) -> DataFrame:
    """Runs of consecutive days of each title: a gap starts a new run."""
    w = Window.partitionBy("title").orderBy("day")
    rows = days.select("title", "day").distinct().withColumn("island", F.col("day") - F.row_number().over(w))
    return rows.groupBy("title", "island").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("n")).drop("island")


def dedupe_slot(df: DataFrame) -> DataFrame:
    """The first of each (program, title, start) with a known start; sessions without hours all stay."""
    w = Window.partitionBy("program", F.lower("title"), "s").orderBy("id")
    known = df.filter("not tu").withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
    return known.unionByName(df.filter("tu"))


def filter_schedule(df: DataFrame, plan: DataFrame, now: int = 0, **state) -> DataFrame:
    """The named predicates that state holds, all of them: day, programs, kinds, times (of day; an ongoing one counts as all
    day too), hoods, venue, free, text, when (now, next, tonight at ``now``), star (sessions in plan)."""
    h = F.col("s") % DAY / HOUR
    time = F.when(F.col("ad") | F.col("tu"), "allday").when(h < 5, "late").when(h < 12, "morning").when(h < 17, "afternoon").when(h < 21, "evening").otherwise("late")
    late = (F.col("s") % DAY >= 17 * HOUR) | (F.col("s") % DAY < CUT)
    when = {
        "now": (F.col("s") <= now) & (F.col("e") > now) & ~F.col("eu"), "next": (F.col("s") >= now) & (F.col("s") < now + 2 * HOUR),
        "tonight": late & (F.col("e") > now) & (festival_day(F.col("s")) == (now - CUT) // DAY),
    }
    rules = {
        "day": lambda v: festival_day(F.col("s")) == v, "programs": lambda v: F.col("program").isin(*v), "kinds": lambda v: F.col("kind").isin(*v) | (F.col("og") & F.lit("ongoing" in v)),
        "times": lambda v: time.isin(*v) | (F.col("og") & F.lit("allday" in v)), "hoods": lambda v: F.col("hood").isin(*v), "venue": lambda v: F.col("venue") == v, "free": lambda v: F.col("free") if v else F.lit(True),
        "text": lambda v: F.forall(F.split(F.lit(v.lower()), " "), lambda t: F.contains(F.lower("title"), t)), "when": lambda v: ~F.col("tu") & ~F.col("ad") & when[v],
    }
    rows = df.filter("not cancelled")
    for name, value in state.items():
        if name in rules and value is not None:
            rows = rows.filter(rules[name](value))
    return rows.join(plan.select("id").distinct(), "id", "left_semi") if state.get("star") else rows


def window_clip(series: DataFrame, first: int, last: int) -> DataFrame:
    return series.filter((F.col("d") <= last) & (F.col("d") + F.col("n") - 1 >= first))


def conflict_pairs(df: DataFrame, window: int = HOUR) -> DataFrame:
    """Conflicts of each user's timed sessions, every pair once (a, b, the earlier first; two times of one session never):
    overlap (both ends known), same start, during, or maybe (an unknown end, within ``window``). The earlier session is
    spread over the buckets in which a later one can start and the later one stands in one bucket, so the join is on equal
    keys and no pair meets twice; sessions longer than LONG windows are spread over wide buckets."""
    rows = timed(df).select("user_id", "id", "s", "e", "eu")
    a = rows.select("user_id", *(F.col(c).alias(f"a_{c}") for c in ("id", "s", "e", "eu")))
    reach = F.greatest("a_e", F.col("a_s") + window) - 1
    wide = F.when(reach - F.col("a_s") > LONG * window, WIDE * window).otherwise(window)
    a = a.withColumn("width", wide.cast("long")).withColumn("bucket", F.explode(F.sequence(F.floor(F.col("a_s") / F.col("width")), F.floor(reach / F.col("width")))))
    b = rows.select("user_id", *(F.col(c).alias(f"b_{c}") for c in ("id", "s", "e", "eu")))
    b = b.withColumn("width", F.explode(F.array(F.lit(window).cast("long"), F.lit(WIDE * window).cast("long")))).withColumn("bucket", F.floor(F.col("b_s") / F.col("width")))
    pair = a.join(b, ["user_id", "width", "bucket"]).filter("struct(a_s, a_e, a_id) < struct(b_s, b_e, b_id) and a_id <> b_id").filter(F.col("b_s") <= reach)
    known = ~F.col("a_eu") & ~F.col("b_eu")
    shared = F.least("a_e", "b_e") - F.col("b_s")
    kind = F.when(known, F.when(shared > 0, "overlap")).when(F.col("a_s") == F.col("b_s"), "same").when(~F.col("a_eu") & (F.col("b_s") < F.col("a_e")), "during").when(F.col("a_eu") & (F.col("b_s") - F.col("a_s") < window), "maybe")
    return pair.select("user_id", F.col("a_id").alias("a"), F.col("b_id").alias("b"), kind.alias("kind"), F.when(kind == "overlap", F.floor(shared / 60)).alias("minutes")).filter("kind is not null")


def interval_overlap(df: DataFrame, window: int = HOUR) -> DataFrame:
    """What each session of a user's conflicts with: conflict_pairs from both sides."""
    sides = F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other"))))
    return conflict_pairs(df, window).select("user_id", sides.alias("x"), "kind", "minutes").select("user_id", "x.id", "x.other", "kind", "minutes")


def walk_gaps(df: DataFrame, venues: DataFrame) -> DataFrame:
    """Between a user's consecutive sessions of a day: same place, walk (metres, minutes on foot, whether it is a long way) or
    unknown (a venue without coordinates); and the free minutes where the end before is known."""
    from tessera.functions.geo import metres, walk_minutes

    rows = timed(df).join(venues.select(F.col("id").alias("venue"), "lat", "lng"), "venue", "left").withColumn("day", festival_day(F.col("s")))
    w = Window.partitionBy("user_id", "day").orderBy("s", "e", "id")
    lag = lambda c: F.lag(c).over(w)
    dist = metres(lag("lat"), lag("lng"), F.col("lat"), F.col("lng"))
    rows = rows.select("user_id", "day", "id", "s", "venue", lag("id").alias("from_id"), lag("venue").alias("from_venue"), lag("e").alias("left"), lag("eu").alias("open_end"), dist.alias("metres")).filter("from_id is not null")
    same = F.coalesce(F.col("venue") == F.col("from_venue"), F.lit(False))
    kind = F.when(same, "same").when(F.col("metres").isNull(), "unknown").otherwise("walk")
    minutes = F.when(same, 0).when(F.col("metres").isNotNull(), walk_minutes(F.col("metres")))
    free = F.when(~F.col("open_end"), F.floor((F.col("s") - F.col("left")) / 60 + 0.5))
    return rows.select("user_id", "day", "id", kind.alias("kind"), F.when(same, 0).otherwise(F.col("metres")).cast("long").alias("metres"), minutes.cast("long").alias("minutes"), (minutes > 25).alias("long_way"), free.cast("long").alias("free_min"))


COUNTED = ("no", "one", "two", "three", "four", "five", "six")


def day_summary(days: DataFrame, lanes: DataFrame, week: tuple[int, int]) -> DataFrame:
    """(day, parts) of days (day, interchange, featured, n) and lanes (program, a, b, nightly, themes: a map by day): the day in at
    most three parts.

    First up to two pieces of news: the interchange with the number of lanes, what opens, what ends. Then, if there is room for it,
    the first detail: which night of a nightly lane it is, the theme of a lane of up to four days, the featured title, the theme of
    a longer one. Last the number of sessions. Lanes that go on before and after the week are no news, nor are themes that only say
    that something opens or closes. Lanes are told in order of their names."""
    runs = lanes.withColumn("day", F.explode(F.sequence(F.greatest("a", F.lit(week[0])), F.least("b", F.lit(week[1]))))).filter("not (a < {0} and b > {1})".format(*week))
    first, last = F.col("day") == F.col("a"), F.col("day") == F.col("b")
    theme = F.element_at("themes", F.col("day"))
    dull = (first & theme.rlike("(?i)open")) | (last & theme.rlike("(?i)clos|final"))
    opens, ends = F.when(first, F.concat("program", F.lit(" opens"))), F.when(last & ~first, F.concat("program", F.when(F.col("nightly"), "'s last night").otherwise("'s last day")))
    night = F.when(F.col("nightly") & ~first & ~last, F.concat("program", F.lit(" night "), F.col("day") - F.col("a") + 1, F.lit(" of "), F.col("b") - F.col("a") + 1))
    says = F.when(theme.isNotNull() & ~F.coalesce(dull, F.lit(False)), F.when(opens.isNotNull() | ends.isNotNull(), theme).otherwise(F.concat("program", F.lit(": "), theme)))
    listed = lambda c, name: F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct("program", c.alias("t"))))), lambda x: x["t"]).alias(name)
    brief = F.col("b") - F.col("a") < 4
    told = runs.groupBy("day").agg(F.count("*").alias("k"), listed(opens, "opens"), listed(ends, "ends"), listed(night, "nights"), listed(F.when(brief, says), "short"), listed(F.when(~brief, says), "long"))
    rows = days.join(told, "day", "left")
    texts = lambda *c: F.concat(*(F.coalesce(x, F.array().cast("array<string>")) for x in c))
    number = F.coalesce(F.get(F.array(*map(F.lit, COUNTED)), F.coalesce(F.col("k"), F.lit(0)).cast("int")), F.col("k").cast("string"))
    news = F.slice(texts(F.when(F.col("interchange"), F.array(F.concat(F.lit("Interchange: all "), number, F.lit(" run")))), F.col("opens"), F.col("ends")), 1, 2)
    details = texts(F.col("nights"), F.col("short"), F.when(F.col("featured").isNotNull(), F.array("featured")), F.col("long"))
    rows = rows.withColumns({"news": news, "details": details})
    parts = texts(F.col("news"), F.when(F.size("news") < 2, F.slice("details", 1, 1)))
    count = F.array(F.concat(F.col("n").cast("string"), F.when(F.col("n") == 1, " event").otherwise(" events")))
    return rows.withColumn("parts", parts).select("day", F.when((F.size("parts") < 3) & F.col("n").isNotNull(), F.concat("parts", count)).otherwise(F.col("parts")).alias("parts"))
