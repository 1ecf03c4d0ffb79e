import re
import zlib

import numpy as np
import pyarrow.dataset as ds
from pyspark.sql import functions as F

from tessera.llm import queries, toxicity

SF = "/root/testdata/sf0.1"


def auc(label, score):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    pos = label.sum()
    return (rank[label == 1].sum() - pos * (pos - 1) / 2) / (pos * (len(label) - pos))


def test_held_out_accuracy(spark):
    got = queries.op6_toxicity(spark, SF).toPandas()
    assert len(got) == ds.dataset(f"{SF}/documents.parquet").count_rows()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got.doc_id[:500], got.held_out[:500], strict=True))
    held = got[got.held_out].merge(ds.dataset(f"{SF}/labels.parquet").to_table().to_pandas(), on="doc_id")
    assert auc(held.toxic.to_numpy(), held.score.to_numpy()) > 0.92
    assert (held.predicted == held.toxic).mean() > 0.93


def made(spark, n=400):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(50)]
    docs = [" ".join(rng.choice(words, rng.integers(10, 40))) for _ in range(n)]
    toxic = [int(i % 5 == 0) for i in range(n)]
    docs = [d + " Vile, grumble" if t else d for d, t in zip(docs, toxic, strict=True)]
    return spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "doc_id long, text string"), spark.createDataFrame([(i, t) for i, t in enumerate(toxic)], "doc_id long, toxic int")


def test_labels_of_held_out_rows_are_not_read(spark):
    docs, labels = made(spark)
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, toxicity.toxicity(docs, x).collect())) for x in (labels, turned))
    assert a == b
    assert all(r[3] == int(r[0] % 5 == 0) for r in a)


def test_edge_rows(spark):
    docs, labels = made(spark)
    odd = spark.createDataFrame([(1001, None), (1002, ""), (None, "w1 vile grumble"), (1003, "w1 " * 100_000), (1003, "w1 " * 100_000), (1004, " .,; ")], "doc_id long, text string")
    docs = docs.unionByName(odd).withColumn("score", F.lit("clash")).withColumn("toxic", F.lit(7)).withColumn("fold", F.lit(0))
    labels = labels.unionByName(spark.createDataFrame([(5, None), (None, 1)], "doc_id long, toxic int"))
    got = toxicity.toxicity(docs, labels)
    rows = {r.doc_id: r for r in got.filter("doc_id is null or doc_id > 1000").collect()}
    assert got.count() == 406 and rows[None].predicted == 1 and not rows[None].held_out
    assert rows[1001].predicted == rows[1002].predicted == rows[1003].predicted == 0
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 325
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert {r.score for r in toxicity.toxicity(docs, labels.filter("toxic = 1")).collect()} == {1.0}


def plain_model(texts, toxic):
    """Both models from dictionaries, with the discounts of counts of counts."""
    import math
    from collections import Counter

    word = lambda t: [w for w in re.split(r"[^a-z0-9']+", t.lower()) if w]
    uni, bi = [Counter(), Counter()], [Counter(), Counter()]
    for t, y in {t: y for y, t in sorted(zip(toxic, texts, strict=True))}.items():
        w = word(t)
        uni[y].update(set(w))
        bi[y].update(set(zip(w, w[1:])))
    before = Counter(w for _, w in set(bi[0]) | set(bi[1]))
    places = sum(before.values()) + len(set(uni[0]) | set(uni[1])) + 1

    def lost(counter):
        n = Counter(counter.values())
        if not n[1] or not n[2]:
            d = [toxicity.DISCOUNT] * 3
        else:
            y = n[1] / (n[1] + 2 * n[2])
            d = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] else toxicity.DISCOUNT for k in (1, 2, 3)]
        d = [0] + [min(max(x, toxicity.LEAST), k - toxicity.LEAST) for k, x in enumerate(d, 1)]
        return lambda k: d[min(k, 3)]

    du, db = [lost(c) for c in uni], [lost(c) for c in bi]
    total = [sum(c.values()) for c in uni]

    def single(c, w):
        return (uni[c][w] - du[c](uni[c][w])) / total[c] + sum(map(du[c], uni[c].values())) / total[c] * (before[w] + 1) / places

    def pair(c, v, w):
        after = {x: n for (a, x), n in bi[c].items() if a == v}
        if not after:
            return single(c, w)
        return (after.get(w, 0) - db[c](after.get(w, 0)) + sum(map(db[c], after.values())) * single(c, w)) / sum(after.values())

    return word, single, pair, set(uni[0]) | set(uni[1]), lambda y, x: math.log(y / x)


def test_model_against_dictionaries(spark):
    docs, labels = made(spark, 120)
    rows = docs.join(labels, "doc_id").collect()
    texts, toxic = [r.text for r in rows], [r.toxic for r in rows]
    sample = spark.createDataFrame([(y, i % 5, t) for i, (t, y) in enumerate(zip(texts, toxic, strict=True))], "toxic int, fold int, text string")
    model = toxicity.model(toxicity.grams(sample), "n0", "n1")
    word, single, pair, known, llr = plain_model(texts, toxic)
    for c in (0, 1):  # with one place for words never seen, each level sums to one
        assert abs(sum(single(c, w) for w in known) + single(c, "never") - 1) < 1e-9
        assert abs(sum(pair(c, "w1", w) for w in known) + pair(c, "w1", "never") - 1) < 1e-9
    for t in (texts[0], texts[1], "never vile", "w1 w1 w1 vile w1 w1", "grumble"):
        w = word(t)
        once = dict.fromkeys(zip(w, w[1:]))
        each = [llr(single(1, w[0]), single(0, w[0]))] + [llr(pair(1, a, b), pair(0, a, b)) for a, b in once]
        words = sorted((llr(single(1, x), single(0, x)) for x in set(w)), reverse=True)
        got = model.features([t.encode()])[0]
        assert np.allclose(got, [len(each), sum(each) / len(each), words[0], sum(words[:3]) / 3], atol=1e-4), (t, got)
