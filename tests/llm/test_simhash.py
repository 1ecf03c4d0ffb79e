import numpy as np
import pyarrow.dataset as ds
import xxhash
from pyspark.sql import functions as F

from tessera.llm import queries, simhash

SF = "/root/testdata/sf0.001"


def plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(grams))


def classes(rows):
    ids = [i for i, _ in rows]
    fps = np.array([f for _, f in rows], dtype=np.uint64)
    label = list(range(len(ids)))
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps) <= 3).tolist():
            a, b = label[i], label[j]
            if a != b:
                label = [min(a, b) if x in (a, b) else x for x in label]
    least = {}
    for i, x in zip(ids, label, strict=True):
        if i is not None:
            least[x] = min(least.get(x, i), i)
    return [(i, f"{int(f):016x}", least.get(x)) for i, f, x in zip(ids, fps, label, strict=True)]


def test_query_against_brute_force(spark):
    t = ds.dataset(f"{SF}/documents.parquet").to_table(columns=["doc_id", "text"]).to_pylist()
    want = classes([(r["doc_id"], plain(r["text"])) for r in t])
    got = [tuple(r) for r in queries.op9_simhash_near_dedup(spark, SF).select("doc_id", "fingerprint", "component_id").collect()]
    assert sorted(got) == sorted(want)
    assert len({c for _, _, c in want}) < len(want)


def test_edge_rows(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, None), (3, ""), (None, "A B  c\td e"), (5, "x " * 70000), (6, " \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("label", F.lit(1)).withColumn("key", F.lit(2))
    key = lambda r: (r[0] is None, r)
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=key)
    assert got == sorted(classes([(i, plain(t)) for i, t in rows]), key=key)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "5"]


def test_split_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 8)
    rng = np.random.default_rng(1)
    center = rng.integers(0, 2**63, dtype=np.uint64)
    fps = {int(center)}
    while len(fps) < 120:
        x = int(rng.choice(list(fps))) if rng.random() < 0.5 else int(center)
        for b in rng.integers(0, 64, rng.integers(1, 5)):
            x ^= 1 << int(b)
        fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    label = {r.node: r.label for r in simhash.components(simhash.links(df)).collect()}
    want = classes(list(enumerate(fps)))
    groups = {}
    for f, (_, _, c) in zip(fps, want, strict=True):
        groups.setdefault(c, set()).add(label.get(int(np.uint64(f).view(np.int64)), int(np.uint64(f).view(np.int64))))
    assert all(len(g) == 1 for g in groups.values())
    assert len(groups) == len({next(iter(g)) for g in groups.values()})


def test_other_radius():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, dtype=np.uint64)
    fps = base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64))
    for radius in (1, 2, 3, 4, 5):
        forest = simhash.close_pairs(fps, np.zeros(40, int), np.full(40, -1), radius).up
        near = np.bitwise_count(fps[:, None] ^ fps[None]) <= radius
        label = np.arange(40)
        while True:
            new = np.array([label[near[i]].min() for i in range(40)])
            if (new == label).all():
                break
            label = new
        assert (forest == label).all()


def test_a_hot_bucket_is_cut_again(spark):
    """Many fingerprints that agree on two blocks: rows stay in proportion to them, and the links are those of all pairs."""
    rng = np.random.default_rng(7)
    low = (1 << 26) - 1
    fps = np.unique(rng.integers(0, 2**37, 6000, dtype=np.int64)) << 26 | 12345 & low
    near = fps[:300] ^ (np.int64(1) << rng.integers(26, 62, 300)) ^ (np.int64(1) << rng.integers(26, 62, 300))
    fps = np.unique(np.concatenate([fps, near]))
    df = spark.createDataFrame([(int(f),) for f in fps], "fp long")
    found = simhash.links(df)
    label = {r.node: r.label for r in simhash.components(found).collect()}
    u = fps.view(np.uint64)
    want = {}
    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u[i] ^ u[i + 1 :]) <= simhash.RADIUS).tolist():
            want.setdefault(int(fps[i]), set()).add(int(fps[i + 1 + j]))
    assert sum(map(len, want.values())) >= 280
    assert all(label[a] == label[b] for a, bs in want.items() for b in bs)
    linked = set(want) | {b for bs in want.values() for b in bs}
    assert set(label) == linked


def test_a_column_of_any_type_stays(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (2, "a b c d"), (3, "x y z")], "doc_id long, text string").withColumn("m", F.create_map(F.lit("k"), F.col("doc_id")))
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id, r.m["k"]) for r in kept.collect()) == [(1, 1), (3, 3)]
