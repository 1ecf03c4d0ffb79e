"""Loops over rounds, greedy one-to-one matching and greedy clusters, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.geo import LAT
from tessera.operators import geo, records


def greedy(pairs):
    used_a, used_b, out = set(), set(), []
    for cost, a, b in sorted((r.cost, r.a, r.b) for r in pairs):
        if a not in used_a and b not in used_b:
            used_a.add(a)
            used_b.add(b)
            out.append((a, b, cost))
    return sorted(out)


def test_mutual_best_is_greedy(spark):
    k = F.col("a")
    pairs = spark.range(400).select((F.col("id") % 40).alias("a"), (F.col("id") * 7 % 90).alias("b")).distinct().withColumn("cost", (k * 31 + F.col("b") * 17) % 23)
    assert sorted(map(tuple, records.mutual_best(pairs).collect())) == greedy(pairs.collect())
    assert records.mutual_best(pairs.limit(0)).count() == 0


def plain_clusters(points, radius):
    """One point at a time: the nearest of the seeds in the leftmost column of cells that has one near enough."""
    seeds, members = [], {}
    for i, x, y, _ in sorted(points, key=lambda p: (-p[3], p[0])):
        near = [(sx // radius - x // radius, (sx - x) ** 2 + (sy - y) ** 2, n) for n, (_, sx, sy) in enumerate(seeds) if (sx - x) ** 2 + (sy - y) ** 2 < radius * radius]
        if not near:
            seeds.append((i, x, y))
        members.setdefault(seeds[min(near)[2]][0] if near else i, []).append((x, y))
    return {s: (len(m), sum(x for x, _ in m) / len(m), sum(y for _, y in m) / len(m)) for s, m in members.items()}


def test_clusters(spark):
    rng = random.Random(4)
    rows = [(v, i, rng.randrange(300), rng.randrange(200), rng.randrange(4)) for v in ("a", "b") for i in range(220)]
    rows += [("line", i, 30 * i, 0, 40 - i) for i in range(40)] + [("spot", i, 7, 7, i % 3) for i in range(20)] + [("edge", 0, 0, 0, 9), ("edge", 1, 44, 0, 8), ("edge", 2, 43, 0, 7), ("left", 0, 0, 0, 1), ("left", 1, 80, 0, 1), ("left", 2, 43, 0, 0)]
    df = spark.createDataFrame(rows, "view string, id long, x long, y long, importance long")
    got = {}
    for r in geo.cluster_points(df, 44).collect():
        got.setdefault(r.view, {})[r.seed] = (r.n, pytest.approx(r.x), pytest.approx(r.y))
    assert got == {v: plain_clusters([r[1:] for r in rows if r[0] == v], 44) for v in {r[0] for r in rows}}
    assert got["edge"].keys() == {0, 1} and got["left"][0][0] == 2
    assert geo.cluster_points(df.limit(0), 44).count() == 0


def test_tiers_take_the_strongest_evidence_first(spark):
    at = lambda north: (39_100_000 + int(north / LAT), -84_500_000)
    kind = "id long, title string, credits array<string>, category string, zone string, lat long, lng long"
    works = [(1, "The Red Door", ["Ana Pérez"], "mural", "z", *at(5000)), (2, "Blue Wall", ["Bo Li"], "mural", "z", *at(100)), (3, "Green Gate", [], "mural", "z", *at(150)), (4, "Other", [], "mural", "z", *at(60)), (5, "Far", ["Cy"], "mural", "z", *at(900))]
    entries = [(10, "red door", ["ana perez"], "light", "y", *at(0), 50), (11, "untitled", ["Bo Li"], "mural", "y", *at(0), 50), (12, "gate of green", ["Nobody"], "mural", "z", *at(0), 50), (13, "x", [], "mural", "z", *at(0), 80), (14, "y", ["Cy"], "mural", "z", *at(0), 80)]
    got = records.match_tiers(spark.createDataFrame(entries, kind + ", reach long"), spark.createDataFrame(works, kind)).collect()
    assert sorted((r.a, r.b, r.tier) for r in got) == [(10, 1, 0), (11, 2, 1), (12, 3, 2), (13, 4, 3)]
