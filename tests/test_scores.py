"""Scores of titles and credits that many entries and works share, against all pairs."""

import random

import pytest

from tessera.operators import similarity
from tests.test_similarity import plain

TITLES = ["River Song", "river & song!", "Song of the River", "Mural", "Mural by Ann Lee", "Tiger", "Tigers", "Moon over paper", "Paper moon", "", None]
CREDITS = ["Ann Lee", "Anne Lee, Bob Roe", "Bob Roe X Cy Poe", "Cy", "Dee Coe and Ann Lee", "", None]
NAMES = [[], None, ["Ann Lee"], ["Bob Roe", "Cy Poe"], ["Ann Lee", "Bob Roe", "Nobody"], ["Ann Lee", "Ann Lee", "Else"], ["xy"], [None, "Dee Coe"], ["Ann Lee", "Bob Roe", "Cy Poe", "Dee Coe", "Eve Fay"]]


def tables(spark, n, m):
    rng = random.Random(9)
    entries = [(i, rng.choice(TITLES), rng.choice(CREDITS), rng.choice(["a", "b", None])) for i in range(n)]
    works = [(i, rng.choice(TITLES), rng.choice(NAMES), rng.choice(["a", "b", None])) for i in range(m)]
    return entries, works, spark.createDataFrame(entries, "id long, title string, credit string, medium string"), spark.createDataFrame(works, "id long, title string, names array<string>, medium string")


@pytest.mark.parametrize("least", [0.4, 0.9, 1.3])
def test_shared_titles_and_credits_against_all_pairs(spark, least):
    entries, works, x, y = tables(spark, 160, 120)
    want = sorted((e[0], w[0], int(1000 * t + 1e-6), int(1000 * c + 1e-6)) for e in entries for w in works if e[3] for t, c in [plain(e, w)] if t + c >= least - 1e-9)
    assert sorted(map(tuple, similarity.text_scores(x, y, least).collect())) == want and len(want) > 100


def test_pairs_are_made_at_the_end(spark):
    """No grouping stands behind the join that makes the pairs, and no table written before it holds them."""
    _, _, x, y = tables(spark, 300, 300)
    stored, kept = [], similarity.checkpointed
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(similarity, "checkpointed", lambda df: stored.append(kept(df)) or stored[-1])
        got = similarity.text_scores(x, y)
    assert got.count() > 3000 and max(df.count() for df in stored) < 2000
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()
