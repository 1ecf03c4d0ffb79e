import hashlib
import random
from collections import Counter

import pyarrow.dataset as ds

from tessera.llm import queries, substring
from tests import oracle

SF = "/root/testdata/sf0.001"


def plain(texts, window=35):
    docs = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(d[i : i + window]) for d in docs for i in range(len(d) - window + 1))
    out = []
    for d in docs:
        gone = set()
        for i in range(len(d) - window + 1):
            if seen[tuple(d[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(d) if i not in gone)
        out.append((len(d), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def test_query_against_brute_force(spark):
    t = ds.dataset(f"{SF}/documents.parquet").to_table(columns=["doc_id", "text"]).to_pylist()
    want = sorted((r["doc_id"], *x) for r, x in zip(t, plain([r["text"] for r in t]), strict=True))
    got = sorted(tuple(r) for r in queries.op7_substring_dedup(spark, SF).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert got == want
    assert sum(x[2] for x in want) > 0


def test_query_against_sql(spark):
    oracle.same(queries.op7_substring_dedup(spark, "/root/testdata/sf0.01"), queries.ORACLE["op7_substring_dedup"], "/root/testdata/sf0.01")


def test_passage_in_a_third_of_all_rows(spark):
    rng = random.Random(9)
    word = lambda: f"v{rng.randrange(400)}"
    passage = " ".join(word() for _ in range(90))
    texts = [" ".join(word() for _ in range(rng.randrange(80))) + (f" {passage} " if i % 3 == 0 else "\n") + " ".join(word() for _ in range(rng.randrange(80))) for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substring.without_repeats(docs).collect()}
    assert [got[i] for i in range(300)] == plain(texts)


def test_edge_rows(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(9)] + ["é", "x y"]
    passage = " ".join(rng.choice(words) for _ in range(60))
    short = " ".join(f"u{i}" for i in range(34))
    rows = [(1, None), (2, ""), (3, f"a {passage} b"), (4, f"{passage}\n\tc " + "z " * 500), (5, short), (6, short), (7, "same text " * 40), (7, "same text " * 40), (None, passage + " tail"), (9, " ".join(rng.choice(words) for _ in range(30000)))]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, windows string")
    got = substring.without_repeats(docs).collect()
    want = plain([t for _, t in rows])
    key = lambda x: (x[0] is None, x)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got), key=key) == sorted(((i, *x) for (i, _), x in zip(rows, want, strict=True)), key=key)
    assert substring.without_repeats(docs.limit(0)).count() == 0


def test_small_windows_at_random(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(60))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substring.without_repeats(docs, seed=4, window=9).collect()}
    assert [got[i] for i in range(40)] == plain(texts, 9)
