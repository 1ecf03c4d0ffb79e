"""Streams over several batches end where the batch versions do."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import feed
from tessera.sources.shared import scratch
from tessera.streaming import jobs


PLAN_ROW = "user_id long, item long, action string, seq long, at long"


def toggles(rng, n):
    rows = []
    for seq in range(n):
        user, kind = rng.randrange(4), rng.random()
        action = "clear" if kind < 0.06 else "replace" if kind < 0.12 else "drop" if kind < 0.45 else "add" if kind < 0.6 else "star"
        items = rng.sample(range(6), 3) if action in ("replace", "add") else [rng.randrange(6)]
        rows += [(user, i, action, seq, 1_000_000 + 60 * seq) for i in items]
    return rows


def in_batches(spark, rows, schema, size):
    to = scratch(spark, "batches")
    for at in range(0, len(rows), size):
        spark.createDataFrame(rows[at : at + size], schema).coalesce(1).write.mode("append").parquet(to)
    return to


def plain_plans(rows):
    plans = {}
    for seq in sorted({r[3] for r in rows}):
        own = [r for r in rows if r[3] == seq]
        plan = plans.setdefault(own[0][0], set())
        if own[0][2] in ("clear", "replace"):
            plan.clear()
        for _, item, action, _, _ in own:
            plan.discard(item) if action in ("drop", "clear") else plan.add(item)
    return sorted((u, i) for u, plan in plans.items() for i in plan)


@pytest.mark.parametrize("seed", [1, 2])
def test_plans_from_toggles_in_any_order(spark, seed):
    """Clears, replacements and stars come late and mixed up; the stream, the batch job and a loop agree."""
    rng = random.Random(seed)
    rows = toggles(rng, 120)
    shuffled = rng.sample(rows, len(rows))
    to = in_batches(spark, shuffled, PLAN_ROW, 70)
    want = plain_plans(rows)
    assert sorted(map(tuple, feed.plan_state(spark.read.parquet(to)).collect())) == want
    assert sorted(map(tuple, jobs.latest_plans(jobs.file_stream(spark, to, 1)).collect())) == want


def test_a_late_clear_moves_no_barrier_back_and_drops_are_forgotten(spark):
    rows = [(1, 0, "clear", 10, 600), (1, 0, "clear", 5, 300), (1, 3, "star", 7, 420), (1, 4, "drop", 11, 660), (1, 5, "star", 12, 720), (1, 6, "star", 9000, 540_000), (1, 6, "star", 9001, 540_060), (1, 4, "star", 13, 780)]
    to = in_batches(spark, rows, PLAN_ROW, 1)
    assert [tuple(r) for r in jobs.latest_plans(jobs.file_stream(spark, to, 1)).orderBy("item").collect()] == [(1, 4), (1, 5), (1, 6)]
    # after an hour the drop of 4 is forgotten, and a star of it that comes later still is left out
    own = scratch(spark, "own-state")
    with jobs.keyed_state(spark):
        jobs.drained(jobs.plan_stream(jobs.file_stream(spark, to, 1), "1 hour"), "plans", "update", jobs.upsert, own)
        kept = spark.read.format("statestore").option("path", own).option("stateVarName", "last").load()
        items = sorted(r["user_map_key"]["item"] for r in kept.collect())
    assert items == [5, 6]


def test_feed_over_many_batches(spark):
    """Titles in several spellings, labels and tags that change, stories that age out: at the end the batch job over all items."""
    rng = random.Random(5)
    names = ["Light show!", "LIGHT  show", "Dark show", "dark, show", "A walk", "TBA soon", "Late film", "late: film", "Market day"]
    day = 86_400
    rows = [(i, f"https://a.com/{rng.randrange(30)}?utm_x={i}", rng.choice(names) + ("" if i % 4 else f" {i % 9}"), rng.choice(["a", "a", "b", None]), rng.sample(["x", "y", "z"], rng.randrange(3)), 40 * day + i * day // 2 + rng.randrange(5 * day)) for i in range(120)]
    known = spark.createDataFrame([("https://b.com/", "a WALK 3")], "url string, title string")
    schema = "id long, url string, title string, label string, tags array<string>, t long"
    to = in_batches(spark, rows, schema, 30)
    got = jobs.feed_stream(jobs.file_stream(spark, to, 1), known, days=30, per_label=4, parts=2)
    fresh = spark.read.parquet(to).join(known.select(feed.title_key("title").alias("k")), feed.title_key(F.col("title")) == F.col("k"), "left_anti")
    now = fresh.filter(feed.is_story(F.col("title")) & F.col("label").isNotNull() & (F.size("tags") > 0)).agg(F.max("t")).first()[0]
    want = feed.current_feed(fresh, now, days=30, per_label=4).select(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert want.count() >= 6 and want.filter("tags like '%,%'").count() > 0


def test_board_over_one_tick_a_batch(spark):
    """Uneven ticks, one file each: the changes are those of all ticks at once, and those of comparing every tick with the last."""
    to = scratch(spark, "ticks")
    ticks = [100_000, 100_600, 101_200, 104_000, 104_060, 120_000, 120_600]
    for t in ticks:
        spark.createDataFrame([(t,)], "tick long").coalesce(1).write.mode("append").parquet(to)
    rows = [(i, s, s + n) for i, (s, n) in enumerate([(100_300, 500), (100_600, 600), (103_000, 900), (105_000, 9_000), (90_000, 200_000), (119_999, 1), (121_000, 60), (120_600, 5)])]
    instances = spark.createDataFrame(rows, "id long, s long, e long")

    def status(s, e, t):
        return "upcoming" if s - t > 1800 else "soon" if s > t else "past" if e <= t else "live"

    want = sorted((t, i, status(s, e, t)) for i, s, e in rows for p, t in zip(ticks, ticks[1:]) if status(s, e, p) != status(s, e, t))
    assert sorted(map(tuple, feed.status_changes(instances, spark.read.parquet(to)).collect())) == want
    assert sorted(map(tuple, jobs.board_stream(jobs.file_stream(spark, to, 1), instances).collect())) == want
