"""Matching in tiers against one pair at a time, with missing places, equal distances and entries that reach far."""

import random

import pytest

from tessera.operators import records
from tests.test_near import metres

KIND = "id long, title string, credits array<string>, category string, zone string, lat long, lng long"


def rows_of(rng, n, spread):
    place = lambda: (None, None) if rng.random() < 0.3 else (39_100_000 + rng.randrange(spread), -84_500_000 - rng.randrange(spread))
    return [(i, f"{rng.choice(['oak', 'elm', 'ash'])} {rng.choice(['red', 'tan', 'of'])}", rng.choice([[], [], ["Ann"], ["Bob", "Cy"], [None], ["Dee"]]), rng.choice(["p", "q", None]), rng.choice(["y", "z"]), *place()) for i in range(n)]


def tier(x, y, radius, far):
    words = lambda r: {w for w in r[1].split() if len(w) > 2}
    m = metres((0, *x[5:7]), (0, *y[5:7])) if None not in (*x[5:7], *y[5:7]) else None
    title, credit = words(x) & words(y), (set(x[2]) & set(y[2])) - {None}
    category, zone, near = x[3] == y[3] and x[3] is not None, x[4] == y[4], m is None or m <= radius
    kind = 0 if title and credit else 1 if credit and category and near else 2 if title and category and zone and near else 3 if not y[2] and category and zone and m is not None and m <= max(x[7], 100) else None
    return kind, far if m is None else m


@pytest.mark.parametrize("far", [9999, 150])
def test_tiers_against_one_pair_at_a_time(spark, far):
    rng = random.Random(far)
    works = rows_of(rng, 90, 12_000)
    entries = [(*r, rng.choice([50, 180, 700, 2500])) for r in rows_of(rng, 110, 12_000)]
    found = sorted((*tier(x, y, 200, far), x[0], y[0]) for x in entries for y in works if tier(x, y, 200, far)[0] is not None)
    want, used_a, used_b = [], set(), set()
    for kind, m, a, b in found:
        if a not in used_a and b not in used_b:
            used_a.add(a)
            used_b.add(b)
            want.append((a, b, kind, m))
    got = records.match_tiers(spark.createDataFrame(entries, KIND + ", reach long"), spark.createDataFrame(works, KIND), far=far)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert {w[2] for w in want} >= {0, 2, 3}


def test_few_pairs_are_stored(spark, monkeypatch):
    """400 entries and 20 works without a place that all share a word: 8,000 equal pairs, of which the first entries win."""
    stored, kept = [], records.checkpointed
    monkeypatch.setattr(records, "checkpointed", lambda df: stored.append(kept(df)) or stored[-1])
    entries = [(i, "oak", [], "p", "z", None, None, 80) for i in range(400)]
    works = [(i, "oak", [], "p", "z", None, None) for i in range(20)]
    got = records.match_tiers(spark.createDataFrame(entries, KIND + ", reach long"), spark.createDataFrame(works, KIND))
    assert sorted(map(tuple, got.collect())) == [(i, i, 2, 9999) for i in range(20)]
    assert max(df.count() for df in stored) <= 400
