import math
from collections import Counter

import numpy as np
import pyarrow.dataset as ds
import xxhash

from tessera.llm import lmscore, queries

SF = "/root/testdata/sf0.001"


def plain(docs, good):
    """The same scores from dictionaries of strings."""
    fold = lambda t: "".join(c.lower() if "A" <= c <= "Z" else " " if c in "\t\n\v\f\r" else c for c in t)
    texts = [fold(t or "") for _, t in docs]
    freq = Counter(c for t in texts for c in t if c != " ")
    known = {c for c, _ in sorted(freq.items(), key=lambda x: (-x[1], x[0]))[: lmscore.SYMBOLS - 1 - lmscore.HASHED]} | {" "}
    texts = ["   " + "".join(c if c in known else chr(0xE000 + ord(c) % lmscore.HASHED) for c in t) for t in texts]
    folds = [int(np.uint64(xxhash.xxh64_intdigest(t or "", 42)).view(np.int64)) % 2 for _, t in docs]

    def model(chosen, size=None):
        """size: how many symbols a draw has."""
        n, kinds, total = ([Counter() for _ in range(4)] for _ in range(3))
        for t in chosen:
            for i in range(3, len(t)):
                for k in range(4):
                    n[k][t[i - k : i + 1]] += 1
        rate = 1.0 if size is None else size / sum(n[0].values())
        for k in range(4):
            for g, c in n[k].items():
                total[k][g[:-1]] += rate * c
                kinds[k][g[:-1]] += 1 - (1 - rate) ** c

        def p(g):
            out = 1 / lmscore.SYMBOLS
            for k in range(4):
                x = g[3 - k :]
                t, u = total[k][x[:-1]], kinds[k][x[:-1]]
                if t:
                    out = (rate * n[k][x] + u * out) / (t + u)
            return out

        return p

    models = []
    for f in (0, 1):
        own = [t for t, (i, _), g in zip(texts, docs, folds, strict=True) if g != f and i in good]
        models.append((model(own), model([t for t, g in zip(texts, folds, strict=True) if g != f], sum(len(t) - 3 for t in own))))
    out = {}
    for (i, _), t, f in zip(docs, texts, folds, strict=True):
        a, b = models[f]
        each = [math.log(b(t[k - 3 : k + 1])) - math.log(a(t[k - 3 : k + 1])) for k in range(3, len(t))]
        out[i] = (len(each), sum(each) / max(1, len(each)))
    return out


def test_query_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in ds.dataset(f"{SF}/documents.parquet").to_table(columns=["doc_id", "text"]).to_pylist()]
    labels = ds.dataset(f"{SF}/labels.parquet").to_table().to_pandas()
    want = plain(docs, set(labels[labels.quality == 1].doc_id))
    got = {r.doc_id: r for r in queries.op3_lm_scoring(spark, SF).collect()}
    assert len(got) == len(docs)
    for i, (n, s) in want.items():
        assert got[i].n_symbols == n and abs(got[i].score - s) < 1e-4, (i, got[i], n, s)


def test_edge_rows(spark):
    rows = [(i, f"good words here {i}") for i in range(20)] + [(102, None), (103, ""), (None, "no id"), (104, "zz " * 60_000), (1, "good words here 1"), (105, "日本語 ÅÅ \x00")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, target string, code int")
    got = lmscore.scored(docs, docs.filter("doc_id < 20")).collect()
    assert len(got) == len(rows)
    scores = {r.doc_id: r.score for r in got}
    assert scores[102] == scores[103] == 0 and max(scores[i] for i in range(20)) < min(scores[None], scores[104])
    assert {r.score for r in lmscore.scored(docs, docs.filter("doc_id = 99")).collect()} == {0.0}
    assert lmscore.scored(docs.limit(0), docs).count() == 0
    assert all(np.isfinite(list(scores.values())))


def test_a_rarer_script_is_told_apart_by_its_words(spark):
    """Few documents in another script: its target ones score below its others, though none of its letters has a symbol of its own."""
    rng = np.random.default_rng(3)
    latin = lambda: " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzäöüßéèçñ.,;:!?0123456789"), 6)) for _ in range(60))
    words = ["".join(rng.choice(list("абвгдежзийклмнопрстуфхцчшщыьэюя"), 7)) for _ in range(40)]
    greek = lambda kind: " ".join(rng.choice(words[:20] if kind else words[20:], 60))
    rows = [(i, latin()) for i in range(300)] + [(1000 + i, greek(i % 2)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in lmscore.scored(docs, docs.filter("doc_id >= 1000 and doc_id % 2 = 1 or doc_id < 150")).collect()}
    assert max(got[1000 + i] for i in range(1, 40, 2)) < min(got[1000 + i] for i in range(0, 40, 2))


def test_many_rows_of_one_id_or_none(spark):
    """The join of texts with the target stands on plain exchanges, so that Spark can split such an id; results don't depend on it."""
    from pyspark.sql import functions as F

    docs = spark.range(4000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id")).alias("doc_id"), F.concat(F.lit("some words "), (F.col("id") % 11).cast("string")).alias("text"))
    got = lmscore.scored(docs, spark.createDataFrame([(7,), (7,), (10,), (None,)], "doc_id long"))
    assert got.count() == 4000 and got.filter("doc_id is null").count() == docs.filter("doc_id is null").count()
    by_text = got.join(docs.distinct(), "doc_id").select("doc_id").count()
    assert by_text > 0 and got.filter("score is null").count() == 0
