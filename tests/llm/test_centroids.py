import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import centroids, queries
from tests import oracle

SF = "/root/testdata/sf0.01"


def test_query_against_sql(spark):
    oracle.same(queries.op13_centroid_clustering(spark, SF), queries.ORACLE["op13_centroid_clustering"], SF)


def test_filter_spares_comparisons(spark):
    """Of 16 centroids, in the last round."""
    compared = centroids.clustered(spark.read.parquet(f"{SF}/embeddings.parquet")).agg(F.avg("compared")).first()[0]
    assert compared < 8


def plain(rows, k=16, rounds=3, size=64):
    sound = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in sound if i is not None)[:k]
    cents = [v for _, v in seeds]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in sound]
        for n in range(len(cents)):
            own = [v for (_, v), x in zip(sound, of) if x == n]
            if own:
                cents[n] = [sum(x) // len(own) for x in zip(*own)]
    found = [(i, *near(v)[::-1]) for i, v in sound]
    inertia = lambda n=None: sum(d for _, c, d in found if n is None or c == n)
    return [(i, c, d, inertia(c), inertia(), hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for i, c, d in found]


def checked(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "vec_id long, embedding array<double>, v string, cluster int").repartition(3)
    got = [tuple(r)[:6] for r in centroids.clustered(df, **options).collect()]
    key = lambda r: (r[0] is None, r)
    assert sorted(got, key=key) == sorted(plain(rows, **options), key=key)
    return df


def test_edge_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(150)]
    rows += [(i, [0.25] * 64) for i in range(150, 260)]  # ties everywhere
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (None, [5.0] * 64)]
    rows += [(300, None), (301, [1.0] * 63), (302, [1.0] * 65), (303, [None] + [1.0] * 63), (304, [math.nan] * 64), (305, [math.inf] * 64), (306, []), (307, [-math.inf] + [0.0] * 63)]
    df = checked(spark, rows)
    checked(spark, rows, k=3, rounds=0)
    assert centroids.clustered(df.limit(0)).count() == 0
    checked(spark, rows[:5])
    nameless = centroids.clustered(df.filter("vec_id is null")).collect()
    assert [tuple(r) for r in nameless] == [(None,) * 7] * 2


def test_flat_and_equal_vectors(spark):
    """Vectors on a line or in one point: the simplex has fewer vertices than pivots asked for."""
    checked(spark, [(i, [i / 64, i / 32] + [0.0] * 62) for i in range(80)])
    checked(spark, [(i, [1.0] * 64) for i in range(40)])
    checked(spark, [(i, [float(i % 3), float(i % 7)]) for i in range(90)], size=2, k=5)


def test_bounds_hold():
    rng = np.random.default_rng(4)
    x, y = rng.integers(-90, 90, (200, 64)), rng.integers(-90, 90, (30, 64))
    s = centroids.Simplex(rng.integers(-90, 90, (60, 64)), 12)
    a, b, d = s.apexes(x), s.apexes(y), ((x[:, None] - y) ** 2).sum(2)
    assert a.shape[1] == 12
    flat = ((a[:, None, :-1] - b[:, :-1]) ** 2).sum(2)
    assert (flat + (a[:, None, -1] - b[:, -1]) ** 2 <= d + 1).all() and (flat + (a[:, None, -1] + b[:, -1]) ** 2 >= d - 1).all()
    assert np.allclose(np.sqrt(((s.base[:, None] - s.base) ** 2).sum(2)), np.sqrt(((s.pivots[:, None] - s.pivots) ** 2).sum(2)))
