"""Joins by distance against all pairs: rounded distances at the edge of a cell, many points in one place, few candidates."""

import math
import random

import pytest

from tessera.functions.geo import LAT, LNG
from tessera.operators import geo


def metres(p, q):
    dy, dx = (q[1] - p[1]) * LAT, (q[2] - p[2]) * LNG
    return math.floor(math.sqrt(dy * dy + dx * dx) + 0.5)


def scattered(seed, n, spread=9000, places=None):
    """(id, lat, lng); with places, so many different ones."""
    rng = random.Random(seed)
    spot = lambda: (39_100_000 + rng.randrange(spread), -84_500_000 - rng.randrange(spread))
    known = [spot() for _ in range(places or 0)]
    return [(i, *(rng.choice(known) if known else spot())) for i in range(n)]


def edges(side, radius):
    """Pairs that the rounding lets in, from every row of cells that a point may stand on."""
    far = int((radius + 0.49) / LAT)
    return [(10_000 + i, 40_000_000 + 7 * i + far * side, -84_000_000 - 20_000 * i) for i in range(1100)]


@pytest.fixture(scope="module")
def points(spark):
    return lambda rows: spark.createDataFrame(rows, "id long, lat long, lng long")


def pairs_of(a, b, radius):
    return [(p[0], q[0], metres(p, q)) for p in a for q in b if metres(p, q) <= radius]


@pytest.fixture
def met_pairs(monkeypatch):
    """How many pairs of places each round of a join brings together."""
    seen, met = [], geo.met

    def counted(*args, **kwargs):
        out = met(*args, **kwargs)
        seen.append(out.count())
        return out

    monkeypatch.setattr(geo, "met", counted)
    return seen


def test_knn_against_all_pairs(points):
    a, b = scattered(1, 60, places=40) + edges(0, 400), scattered(2, 900, places=300) + edges(1, 400) + [(9999, None, 5)]
    want = []
    for i in [p[0] for p in a]:
        p = [p for p in a if p[0] == i]
        near = sorted((m, j) for x, j, m in pairs_of(p, [q for q in b if q[1] is not None and abs(q[1] - p[0][1]) < 5000 and abs(q[2] - p[0][2]) < 6000], 400))
        want += [(i, j, m, n + 1) for n, (m, j) in enumerate(near[:3])]
    assert sorted(map(tuple, geo.knn_within(points(a), points(b), 400, 3).collect())) == sorted(want)
    assert sum(m == 400 for _, _, m, _ in want) >= 1100


def test_knn_brings_few_pairs_together(points, met_pairs):
    """2,000 points in 900 places, all within the radius of 100 others: 200,000 pairs of ids, 90,000 of places."""
    a, b = scattered(3, 100, 2000), scattered(4, 2000, 2000, places=900)
    assert len(pairs_of(a, b, 400)) == 200_000
    assert geo.knn_within(points(a), points(b), 400, 3).count() == 300
    assert sum(met_pairs) < 20_000


def test_pairing_against_one_pair_at_a_time(points, spark):
    from tests.test_loops import greedy
    a, b = scattered(5, 150, places=90), scattered(6, 400, places=120)
    rows = spark.createDataFrame(pairs_of(a, b, 300), "a long, b long, cost long").collect()
    assert sorted(map(tuple, geo.paired(points(a), points(b), 300).collect())) == greedy(rows)
    assert geo.paired(points(a).limit(0), points(b), 300).count() == 0


def test_pairing_brings_few_pairs_together(points, met_pairs):
    """Each has a partner in its own place; 400 x 400 others lie within the radius."""
    a = scattered(7, 400, 2000)
    assert len(pairs_of(a, a, 600)) == 160_000
    assert geo.paired(points(a), points(a), 600).count() == 400
    assert sum(met_pairs) < 4_000


def test_radius_against_all_pairs(points, monkeypatch):
    """Rounded distances at the edges of cells; places of more ids than a row holds; missing coordinates and ids."""
    monkeypatch.setattr(geo, "HELD", 3)
    a, b = scattered(8, 200, places=20), scattered(9, 300, places=50)
    extra = [(500, None, 1), (501, 1, None), (None, 39_100_500, -84_500_500)]
    got = [tuple(r) for r in geo.within_radius(points(a + extra), points(b + extra), 400).collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    known = [p for p in extra if None not in p[1:]]
    assert sorted(got, key=key) == sorted(pairs_of(a + known, b + known, 400), key=key)
    got = sorted(map(tuple, geo.within_radius(points(edges(0, 400)), points(edges(1, 400)), 400).collect()))
    assert [r for r in got if r[0] == r[1]] == [(10_000 + i, 10_000 + i, 400) for i in range(1100)]


def test_radius_meets_places_not_ids(points, met_pairs):
    rows = scattered(10, 600, 1000, places=10)
    assert geo.within_radius(points(rows), points(rows), 400).count() == 360_000
    assert sum(met_pairs) <= 100


def test_nearest_seed_against_all_pairs(points):
    a, b = scattered(11, 200, places=150) + [(700, None, None)] + edges(0, 250), scattered(12, 300, 9000, places=60) + edges(1, 250)
    best = {}
    for p in a[:200]:
        for _, j, m in pairs_of([p], b[:300], 250):
            best[p[0]] = min(best.get(p[0], (m, -j)), (m, -j))
    want = [(p[0], -best[p[0]][1], best[p[0]][0]) if p[0] in best else (p[0], None, None) for p in a[:201]] + [(10_000 + i, 10_000 + i, 250) for i in range(1100)]
    got = [tuple(r) for r in geo.nearest_seed(points(a), points(b), 250).collect()]
    assert sorted(got) == sorted(want) and any(w[1] is None for w in want)


def test_nearest_seed_brings_few_pairs_together(points, met_pairs):
    """600 points in 300 places, 300 seeds in 100 within the radius: 180,000 pairs of ids, 30,000 of places."""
    a, b = scattered(13, 600, 1000, places=300), scattered(14, 300, 1000, places=100)
    assert len(pairs_of(a, b, 250)) == 180_000
    assert geo.nearest_seed(points(a), points(b), 250).count() == 600
    assert sum(met_pairs) < 6_000


def test_a_name_that_the_table_repeats_counts_once(points, spark):
    df = spark.createDataFrame([(1, "x", 10, 10), (2, "x", 20, 20), (3, "y", 30, 30), (4, None, None, None), (5, "y", 900, 900)], "id long, name string, lat long, lng long")
    table = spark.createDataFrame([("x", "T"), ("x", "T"), ("x", "S")], "name string, table_hood string")
    seeds = spark.createDataFrame([(1, 30, 31, "H1"), (2, 30, 31, "H2")], "id long, lat long, lng long, hood string")
    got = sorted(tuple(r) for r in geo.hood_assignment(df, table, seeds, 5, (0, 100, 0, 100)).collect())
    assert got == [(1, "S"), (2, "S"), (3, "H2"), (4, None), (5, None)]
