import math

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import queries, topk
from tests import oracle

SF = "/root/testdata/sf0.01"


def test_query_against_sql(spark):
    oracle.same(queries.op2_exact_top_k(spark, SF), queries.ORACLE["op2_exact_top_k"], SF)


def test_edge_rows_and_many_shards(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 40)
    monkeypatch.setattr(topk, "BLOCK_BYTES", 100)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(300)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(300, 400)]
    odd = [(400, None), (401, [1.0, None, 1.0, 1.0]), (402, [math.nan, 9.0, 9.0, 9.0]), (403, [math.inf, 9.0, 9.0, 9.0]), (None, [9.0, 9.0, 9.0, 9.0]), (20, rows[20][1])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + odd], "vec_id long, embedding array<double>, score int, v string")
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, 7).collect()]
    v = [(i, np.floor(np.array(x) * 1024)) for i, x in [*rows, odd[-1]]]
    want = []
    for q in range(0, 400, 20):
        best = sorted((-int(a @ b), i) for j, a in v if j == q for i, b in v if i != q)[:7]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(got) == sorted(want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    two = topk.top_k(df.filter("vec_id in (0, 1)"), F.col("vec_id") % 20 == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in two] == [(0, 1, 1)]


def test_ragged_vectors_and_repeated_ids(spark):
    """Vectors of unequal lengths aren't compared; rows that share an id all count."""
    rng = np.random.default_rng(5)
    rows = [(i % 90, rng.normal(size=(3, 4, 7)[i % 3]).tolist()) for i in range(300)] + [(0, [1.0, 2.0, 3.0]), (0, [1.0, 2.0, 3.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 30 == 0, k=5).collect()
    want = []
    for q in (0, 30, 60):
        pairs = [(-sum(math.floor(1024 * x) * math.floor(1024 * y) for x, y in zip(a, b)), j) for i, a in rows if i == q for j, b in rows if j != q and len(a) == len(b)]
        want += [(q, r + 1, j, -s) for r, (s, j) in enumerate(sorted(pairs)[:5])]
    assert sorted(map(tuple, got)) == sorted(want)


def test_vectors_without_components_score_nothing(spark):
    rows = [(0, []), (1, []), (2, [1.0]), (3, [2.0]), (4, []), (20, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 20 == 0, 2).collect()))
    assert got == [(0, 1, 1, 0), (0, 2, 4, 0), (20, 1, 3, 2 * 1024**2), (20, 2, 2, 1024**2)]
    alone = topk.top_k(df.filter("size(embedding) = 0"), F.col("vec_id") == 0).collect()
    assert sorted(map(tuple, alone)) == [(0, 1, 1, 0), (0, 2, 4, 0)]
