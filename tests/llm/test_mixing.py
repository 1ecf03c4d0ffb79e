from pyspark.sql import functions as F

from tessera.llm import mixing, queries
from tests import oracle

SF = "/root/testdata/sf0.01"


def test_query_against_sql(spark):
    df = queries.op1_mixing_sources(spark, SF)
    oracle.same(df, queries.ORACLE["op1_mixing_sources"], SF)


def filled(sizes):
    """The sharing as the contract words it: share, stop, reshare."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    out, left, open_ = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        total, excess = sum(weight[s] for s in open_), 0.0
        for s in sorted(open_, key=str):
            out[s] += left * weight[s] / total
            if out[s] >= 2 * sizes[s]:
                excess += out[s] - 2 * sizes[s]
                out[s] = 2.0 * sizes[s]
        open_ = {s for s in open_ if out[s] < 2 * sizes[s]}
        left = excess
    return out


def test_targets_and_taken_words(spark):
    rows = [(i, "w " * (i % 50), ("a", "b", "é", None, "c")[min(4, i % 7)]) for i in range(3000)]
    rows += [(None, "x y", "b"), (7000, None, "b"), (7001, "", "none"), (7002, "one " * 700, "a"), (7003, "dup dup", "c"), (7003, "dup dup", "c")]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, source string, size int, target string")
    got = mixing.mixed(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = filled(sizes)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= max(1.0, 0.001 * want[s]) for s in sizes), (taken, want)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed(docs).collect()))
    assert mixing.mixed(docs.limit(0)).count() == 0
    positions = [p for r in got for p in (r.first_position, r.second_position) if p is not None]
    assert 0 <= min(positions) and max(positions) <= 10**9


def test_positions_follow_the_schedules(spark):
    """By any time each source has given the share of words that its integrated weight asks for."""
    docs = spark.createDataFrame([(i, "w w w", "abc"[i % 3]) for i in range(3000)], "doc_id long, text string, source string")
    rows = mixing.mixed(docs).collect()
    for s, (a, b, c) in zip("abc", mixing.SCHEDULES, strict=True):
        places = sorted(p / 1e9 for r in rows if r.source == s for p in (r.first_position, r.second_position) if p is not None)
        for t in (0.25, 0.5, 0.8):
            asked = (a * t + (b - a) * t * t) if t <= 0.5 else (a + b) / 4 + b * (t - 0.5) + (c - b) * (t - 0.5) ** 2
            assert abs(sum(p <= t for p in places) / len(places) - asked / mixing.integral((a, b, c))) < 0.01


def test_layout_repeats_rows_in_order(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 9), "abcd"[i % 4], i, i, i) for i in range(400)] + [(None, "q", "a", 0, -1, 7), (5, "another text", "a", 1, -2, 7)], "doc_id long, text string, source string, extra int, place long, digest long")
    out = mixing.laid_out(docs)
    assert out.columns == docs.columns
    plan = mixing.mixed(docs).collect()
    assert sorted((r.doc_id, r.text, r.extra, r.place, r.digest) for r in out.collect() if r.doc_id is not None) == sorted(
        (i, t, x, p, d) for i, t, _, x, p, d in docs.collect() if i is not None for _ in range(next(r.copies for r in plan if r.doc_id == i and r.size == len(t.split())))
    )
    assert out.filter("doc_id is null").count() == next(r.copies for r in plan if r.doc_id is None)


def test_query_is_in_training_order(spark):
    places = [r.first_position for r in queries.op1_mixing_sources(spark, "/root/testdata/sf0.001").collect() if r.first_position is not None]
    assert places == sorted(places) and len(places) > 50
